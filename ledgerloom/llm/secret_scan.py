"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models for what these do not name.

Two first-order models of characters are compared by their log-likelihood ratio: one of random strings, one of ordinary
identifiers.  Their labelled samples come from about ``sample`` documents, chosen by a hash of id and text: label 1 are the
values that the fixed patterns find there and, so that every alphabet is known, one base64 digest a document; label 0 are the
runs of eight characters or more that lie outside of these patterns.  The sample bounds the fit alone; every text is scored
whole.  Weights are rounded to thousandths, so sums are exact and do not depend on their order.  The model is one row of
128 x 128 numbers, and that row is what is broadcast.

A run of 16 characters or more that overlaps no fixed span is a secret if its ratio reaches ``threshold``.

Spans are offsets in code points.  No function of Spark gives a match's place, so it is summed up from the lengths of matches
and of the pieces between them, in two levels, so that a text of very many matches stays cheap.

Defined results: null texts count as empty and have no spans; null or repeated ids do not matter but for the sample (a null
id hashes as the word ``null``); rows that repeat give rows that repeat; an empty table gives an empty result; without
labelled rows all weights are nought; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns (values that must be as they are)
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGNED = 12
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the models look at, and those that they learn from
RUN, LEARNT = r"[A-Za-z0-9+/_=-]{16,}", r"[A-Za-z0-9+/_=-]{8,}"
SYMBOLS, SAMPLE, THRESHOLD, BLOCK = 67, 4000, 12_000, 256


def _running(x: Column) -> Column:
    """0, x1, x1 + x2, ... of an array: one element more than it has."""
    return F.aggregate(x, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def _before(df: DataFrame, name: str, steps: str) -> DataFrame:
    """Adds ``name``: for each element of ``steps`` the sum of those before it.  Blocks first, then their offsets."""
    n = F.size(steps)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: _running(F.slice(F.col(steps), k * BLOCK + 1, F.lit(BLOCK))))
    df = df.withColumn("__blocks", F.when(n > 0, blocks))
    df = df.withColumn("__offsets", _running(F.transform("__blocks", lambda b: F.element_at(b, -1))))
    whole = F.flatten(F.transform("__blocks", lambda b, i: F.transform(F.slice(b, 1, F.size(b) - 1), lambda v: v + F.get(F.col("__offsets"), i))))
    return df.withColumn(name, F.when(n > 0, whole)).drop("__blocks", "__offsets")


def _spans(df: DataFrame, name: str, pattern: str, text: str, group: int = 0) -> DataFrame:
    """Adds ``name``: array of (start, end, value) of a pattern's matches; value: what the group holds."""
    none, n = F.array().cast("array<long>"), F.size("__m")
    df = df.withColumn("__m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("__v", F.when(n > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("__m"))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), n), lambda g: F.length(g).cast("long"))
    df = df.withColumn("__gaps", F.when(n > 0, gaps).otherwise(none))
    df = df.withColumn("__steps", F.zip_with("__gaps", "__m", lambda g, m: g + F.length(m)))
    df = _before(df, "__at", "__steps")

    def span(i: Column) -> Column:
        start = F.get("__at", i) + F.get("__gaps", i)
        return F.struct(start.alias("start"), (start + F.length(F.get("__m", i))).alias("end"), F.get("__v", i).alias("value"))

    found = F.transform(F.sequence(F.lit(0), n - 1), span)
    df = df.withColumn(name, F.when(n > 0, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")))
    return df.drop("__m", "__v", "__gaps", "__steps", "__at")


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__base``: array of (start, kind, end, value), kinds counted from 1, in order."""
    df = _spans(_spans(_spans(df, "__assign", ASSIGN, text, 2), "__access", ACCESS, text), "__hex", HEX, text)
    df = df.withColumn("__assign", F.filter("__assign", lambda s: F.length(s["value"]) >= ASSIGNED))

    def of(name: str, kind: int) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return df.withColumn("__base", F.array_sort(F.concat(of("__assign", 1), of("__access", 2), of("__hex", 3)))).drop("__assign", "__access", "__hex")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """label, token: distinct random strings (1) and ordinary identifiers (0) of about ``sample`` documents."""
    name, text = F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))
    every = max(1, docs.count() // sample)
    digest = F.sha2(F.concat_ws(":", name, text).cast("binary"), 256)
    some = docs.select(text.alias("__text"), digest.alias("__digest")).where(
        F.pmod(F.conv(F.substring("__digest", 1, 13), 16, 10).cast("long"), F.lit(every)) == 0)
    bare = F.col("__text")
    for pattern in (ASSIGN[:-2] + f"{{{ASSIGNED},}})", ACCESS, HEX):
        bare = F.regexp_replace(bare, F.lit(pattern), F.lit(" "))
    held = F.concat(
        F.transform(F.filter(F.regexp_extract_all("__text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGNED), lambda v: F.struct(F.lit(1).alias("label"), v.alias("token"))),
        F.transform(F.concat(F.regexp_extract_all("__text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("__text", F.lit(HEX), F.lit(0)),
                             F.array(F.regexp_replace(F.base64(F.unhex("__digest")), "\\s", ""))), lambda v: F.struct(F.lit(1).alias("label"), v.alias("token"))),
        F.transform(F.regexp_extract_all(bare, F.lit(LEARNT), F.lit(0)), lambda v: F.struct(F.lit(0).alias("label"), v.alias("token"))))
    return some.select(F.explode(held).alias("x")).select("x.label", "x.token").distinct()


def model(tokens: DataFrame) -> DataFrame:
    """One row ``w``: at place 128 a + b the weight of character b after a (0: start), in thousandths of a nat."""
    chars = tokens.select("label", F.split("token", "").alias("c"))
    pairs = chars.select("label", F.explode(F.zip_with(F.concat(F.array(F.lit("")), F.slice("c", F.lit(1), F.size("c") - 1)), "c", lambda a, b: F.struct(
        F.ascii(a).alias("a"), F.ascii(b).alias("b")))).alias("p")).groupBy("p.a", "p.b").pivot("label", [0, 1]).count()
    codes = tokens.sparkSession.range(128 * 128).select((F.col("id") / 128).cast("int").alias("a"), (F.col("id") % 128).cast("int").alias("b"))
    counts = codes.join(pairs, ["a", "b"], "left").select("a", "b", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"n{k}") for k in (0, 1)])
    total = counts.groupBy("a").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    seen = F.log((F.col("n1") + 1) / (F.col("t1") + SYMBOLS)) - F.log((F.col("n0") + 1) / (F.col("t0") + SYMBOLS))
    weights = counts.join(total, "a").select(F.struct((F.col("a") * 128 + F.col("b")).alias("i"), F.round(1000 * seen).cast("long").alias("w")).alias("x"))
    return weights.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]).alias("w"))


def ratio(token: Column, w: Column) -> Column:
    """Log-likelihood ratio of a string under the weights."""
    start = F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("s"))
    whole = F.aggregate(F.split(token, ""), start, lambda acc, c: F.struct(F.ascii(c).alias("a"), (acc["s"] + F.get(w, acc["a"] * 128 + F.ascii(c))).alias("s")))
    return whole["s"]


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"] - 1), s["start"], s["end"])), ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row a document."""
    weights = model(labelled(docs, id_col, text_col, sample))
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    held = _spans(base_spans(held, "__text"), "__runs", RUN, "__text").drop("__text")
    free = F.filter("__runs", lambda r: ~F.exists("__base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    held = held.withColumn("__free", free).drop("__runs").join(F.broadcast(weights))  # a single row
    random = F.filter("__free", lambda r: ratio(r["value"], F.col("w")) >= threshold)
    held = held.withColumn("__random", F.transform(random, lambda r: F.struct(r["start"].alias("start"), F.lit(4).alias("kind"), r["end"].alias("end"), r["value"].alias("value"))))
    held = held.withColumn("__all", F.array_sort(F.concat("__base", "__random"))).withColumn("__joined", _joined("__base"))
    counts = [_count("__all", k).alias(f"n_{name}") for k, name in enumerate(KINDS, 1)]
    return held.select("doc_id", *counts[:3], F.sha2(F.col("__joined").cast("binary"), 256).alias("base_sha256"), _joined("__all").alias("spans"), counts[3])


#: The query's rows; the kinds' patterns once more, in the words of another regular-expression library.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                  sha256(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS digest FROM documents),
k(kind, name, pattern) AS (VALUES
  (1, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (2, 'access', 'AKIA[A-Z0-9]{14,}'), (3, 'hex', '[0-9a-f]{16,}'), (4, 'markov', '[A-Za-z0-9+/_=-]{16,}')),
hit AS (SELECT rid, kind, name, pattern, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS g FROM d, k),
one AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit),
span AS (
  SELECT rid, kind, name, m[i] AS v, CASE WHEN kind = 1 THEN regexp_extract(m[i], pattern, 2) ELSE m[i] END AS value,
         (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM one),
base AS (SELECT rid, kind, name, value, s, s + length(v) AS e FROM span WHERE kind < 4 AND (kind > 1 OR length(value) >= 12)),
free AS (
  SELECT rid, v, s, s + length(v) AS e FROM span r WHERE kind = 4
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.s + length(r.v) AND r.s < b.e)),
sampled AS (SELECT * FROM d WHERE ('0x' || substr(digest, 1, 13))::BIGINT % greatest(1, (SELECT count(*) // 4000 FROM documents)) = 0),
bare AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]{12,})', ' ', 'g'),
         'AKIA[A-Z0-9]{14,}', ' ', 'g'), '[0-9a-f]{16,}', ' ', 'g') AS t FROM sampled),
labelled AS (
  SELECT 1 AS label, value AS token FROM base WHERE rid IN (SELECT rid FROM sampled)
  UNION SELECT 1, to_base64(unhex(digest)) FROM sampled
  UNION SELECT 0, unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{8,}')) FROM bare),
steps AS (SELECT label, token, unnest(range(1, length(token) + 1)) AS i FROM labelled),
pairs AS (
  SELECT CASE WHEN i = 1 THEN 0 ELSE ascii(token[i - 1]) END AS a, ascii(token[i]) AS b,
         count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM steps GROUP BY 1, 2),
total AS (SELECT a, sum(n0) AS t0, sum(n1) AS t1 FROM pairs GROUP BY a),
walk AS (SELECT rid, v, s, e, unnest(range(1, length(v) + 1)) AS i FROM free),
random AS (
  SELECT rid, s, e FROM (
    SELECT w.rid, w.s, w.e, CASE WHEN i = 1 THEN 0 ELSE ascii(v[i - 1]) END AS a, ascii(v[i]) AS b FROM walk w) x
  LEFT JOIN pairs p ON p.a = x.a AND p.b = x.b LEFT JOIN total t ON t.a = x.a
  GROUP BY rid, s, e
  HAVING sum(round(1000 * (ln((coalesce(n1, 0) + 1)::DOUBLE / (coalesce(t1, 0) + 67)) - ln((coalesce(n0, 0) + 1)::DOUBLE / (coalesce(t0, 0) + 67))))::BIGINT) >= 12000),
spans AS (SELECT rid, kind, name, s, e FROM base UNION ALL SELECT rid, 4, 'markov', s, e FROM random)
SELECT doc_id, count(*) FILTER (kind = 1) AS n_assign, count(*) FILTER (kind = 2) AS n_access, count(*) FILTER (kind = 3) AS n_hex,
       sha256(coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 4), '')) AS base_sha256,
       coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind), '') AS spans, count(*) FILTER (kind = 4) AS n_markov
FROM d LEFT JOIN spans USING (rid) GROUP BY rid, doc_id
"""
