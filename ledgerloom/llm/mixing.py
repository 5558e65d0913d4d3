"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n rows and target share w of ``total`` output rows has the mean repetition rate
``w * total / n``.  Each row takes a uniform number from a hash of seed and id, inverts its source's
Poisson distribution at it, and appears as often as that count says; so the count is reproducible, needs
no state and is independent between rows.  The copies are dealt by a hash of seed, id and copy and sorted
by it inside each partition, which is a global shuffle.

Only the sources' rates (one short table row a source) are joined to the rows.  That table is broadcast
after its sources and the steps of their distributions are counted (``broadcast_sources``, ``broadcast_steps``: a source
of few rows has a high rate and a long table); beyond either, rows are salted so that a source with a third of all rows is
dealt over many tasks.

Defined results: a null source is a source of its own; a null id hashes as the word "null"; rows that
repeat an id get the same count; sources with no weight get none (and so no rows) if weights are
given, and weights for sources that have no rows are ignored (the remaining weights are not rescaled);
an empty table gives an empty result; texts are carried untouched, null or empty ones too; input columns
with the names of the copy and key columns are replaced by these.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MASK = float(1 << 52)


def unit_hash(*parts: Column) -> Column:
    """Uniform in [0, 1): the first 52 bits of a SHA-256."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("double") / F.lit(MASK)


def _log_factorial(k: Column) -> Column:
    """Exact below 21, Stirling's series above (error under 1e-13)."""
    x = k.cast("double")
    series = (x * F.log(x) - x + 0.5 * F.log(2.0 * math.pi * x) + 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x))
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None,
          total: int | None = None) -> DataFrame:
    """One row a source: source, rows, rate.  Equal weights and as many rows as now, unless given."""
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row a source stands here, not one a document
    if weights is None:
        w = F.lit(1.0) / F.count("*").over(everything)
    else:
        scale = sum(weights.values())
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, v / scale)]
        w = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    out = F.lit(float(total)) if total is not None else F.sum("n").over(everything).cast("double")
    return per.select("source", "n", (w * out / F.col("n")).alias("rate"))


def distribution(rate_table: DataFrame) -> DataFrame:
    """source, rate, low, cdf: P(X <= low), P(X <= low + 1), ... as far as a double tells them from 1."""
    spread = 12.0 * F.sqrt("rate") + 30.0
    low = F.greatest(F.lit(0.0), F.floor(F.col("rate") - spread)).cast("long")
    k = rate_table.where("rate > 0").select(
        "source", "rate", low.alias("low"), F.explode(F.sequence(low, F.ceil(F.col("rate") + spread).cast("long"))).alias("k"))
    mass = F.exp(F.col("k") * F.log("rate") - F.col("rate") - _log_factorial(F.col("k")))
    upto = Window.partitionBy("source", "rate", "low").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = k.select("source", "rate", "low", "k", F.sum(mass).over(upto).alias("p"))
    return steps.groupBy("source", "rate", "low").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 7,
                id_col: str = "doc_id", source_col: str = "source", broadcast_sources: int = 10_000, broadcast_steps: int = 500_000,
                copy_col: str = "copy", key_col: str = "mix_key") -> DataFrame:
    """All columns of the rows, each row repeated by its count, with the copy's number and shuffle key."""
    dist = distribution(rates(docs, source_col, weights, total)).select(
        F.col("source").alias("__source"), F.col("low").alias("__low"), F.col("cdf").alias("__cdf"))
    names = [c for c in docs.columns if c not in (copy_col, key_col)]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("__row"), F.col(id_col).cast("string").alias("__id"),
                        F.col(source_col).alias("__src"), unit_hash(F.lit(seed), F.col(id_col)).alias("__u"))
    same = F.col("__src").eqNullSafe(F.col("__source"))
    held = dist.agg(F.count("*"), F.coalesce(F.sum(F.size("__cdf")), F.lit(0))).first()
    if held[0] <= broadcast_sources and held[1] <= broadcast_steps:
        joined = keyed.join(F.broadcast(dist), same)
    else:
        salts = 64
        spread = dist.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn("__mine", F.pmod(F.xxhash64(F.col("__u")), F.lit(salts)).cast("int")).join(
            spread, same & (F.col("__mine") == F.col("__salt")))
    count = F.col("__low") + F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    copies = joined.withColumn("__n", count).where("__n > 0")
    out = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce("__id", F.lit("null")), F.col("__copy")).cast("binary"), 256)
    out = out.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)], F.col("__copy").alias(copy_col), key.alias(key_col))
    return out.repartition(F.col(key_col)).sortWithinPartitions(key_col)
