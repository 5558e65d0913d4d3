"""Comparison of two systems: keyed differences, multisets, positions, files, and verdicts.

All joins are hash or sort-merge joins on keys; AQE splits skewed ones.  Verdicts are single rows that come
from aggregates, never from collected rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import MOST, running

from .ledger import is_snapshot
from .scans import MOST, running


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JON-1: keys of left that right lacks."""
    return left.select(*keys).join(right.select(*keys), keys, "left_anti")


def keyed_diff(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """JON-3: one row per difference: keys, kind (missing, extra, field), field, expected, actual (text)."""
    e = expected.select(*keys, F.struct(*fields).alias("__e"))
    a = actual.select(*keys, F.struct(*fields).alias("__a"))
    both = e.join(a, keys, "full_outer")
    kinds = F.when(F.col("__a").isNull(), F.array(F.struct(F.lit("missing").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))))
    kinds = kinds.when(F.col("__e").isNull(), F.array(F.struct(F.lit("extra").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))))
    each = [F.when(~F.col(f"__e.{f}").eqNullSafe(F.col(f"__a.{f}")),
                   F.struct(F.lit("field").alias("kind"), F.lit(f).alias("field"), F.col(f"__e.{f}").cast("string").alias("expected"), F.col(f"__a.{f}").cast("string").alias("actual"))) for f in fields]
    kinds = kinds.otherwise(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return both.select(*keys, F.explode(kinds).alias("d")).select(*keys, "d.*")


def diff_summary(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """AGG-25: compared rows, missing, extra, compared cells, differing and null cells; one pass."""
    e, a = expected.select(*keys, F.struct(*fields).alias("__e")), actual.select(*keys, F.struct(*fields).alias("__a"))
    both = e.join(a, keys, "full_outer")
    paired = F.col("__e").isNotNull() & F.col("__a").isNotNull()
    differing, nulls = F.lit(0), F.lit(0)
    for f in fields:
        differing = differing + F.when(paired & ~F.col(f"__e.{f}").eqNullSafe(F.col(f"__a.{f}")), 1).otherwise(0)
        nulls = nulls + F.when(paired & F.col(f"__a.{f}").isNull(), 1).otherwise(0)
    n = F.count_if(paired)
    return both.agg(n.alias("compared"), F.count_if(F.col("__a").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("extra"),
                    (n * len(fields)).alias("cells"), F.coalesce(F.sum(differing), F.lit(0)).alias("differing"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_cells"))


def nearest_sequence(a: DataFrame, b: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """JON-8: for every row of a the row of b with its key and the nearest sequence, and the difference; ties to the
    smaller one; rows of a whose key b lacks are left out.  Both sides are one sort by sequence: the neighbours
    are the last b before and the first b after a row.  A key is dealt over ranges of ``width`` positions, and each range
    carries its neighbours' nearest b, so a hot key is many tasks and no pairs are made."""
    place = F.floor(F.col("sequence") / width).alias("__range")
    none = F.lit(None).cast("long")
    rows = (a.select(key, "sequence", place, F.col("n").alias("a_n"), none.alias("b_seq"), F.lit(1).alias("o"))
            .unionByName(b.select(key, "sequence", place, F.lit(None).cast(a.schema["n"].dataType).alias("a_n"), F.col("sequence").cast("long").alias("b_seq"), F.lit(0).alias("o"))))
    # one row a key and range
    ranges = Window.partitionBy(key).orderBy("__range")
    edges = rows.groupBy(key, "__range").agg(F.min("b_seq").alias("lo"), F.max("b_seq").alias("hi")).select(
        key, "__range", F.last("hi", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("lo", ignorenulls=True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    inside = Window.partitionBy(key, "__range").orderBy("sequence", "o")
    low = F.coalesce(F.last("b_seq", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "before")
    high = F.coalesce(F.first("b_seq", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)), "after")
    near = rows.join(edges, [key, "__range"]).withColumns({"low": low, "high": high}).where("o = 1")
    best = F.when(F.col("low").isNull() | (F.col("high") - F.col("sequence") < F.col("sequence") - F.col("low")), F.col("high")).otherwise(F.col("low"))
    return (near.withColumn("b_seq", best).where("b_seq is not null")
            .select(key, "a_n", F.col("sequence").alias("a_seq"), "b_seq", (F.col("b_seq") - F.col("sequence")).alias("delta")))


def delta_profile(nearest: DataFrame) -> DataFrame:
    return nearest.agg(F.count("*").alias("n"), F.min("delta").alias("least"), F.max("delta").alias("most"), F.count_distinct("delta").alias("different"),
                       (F.count_distinct("delta") == 1).alias("constant"), F.count_if(F.col("delta") == 0).alias("exact"))


def files_against_receipts(declared: DataFrame, loaded: DataFrame) -> DataFrame:
    """JON-9: per file: state (matched, missing, short, over, unreceipted, pending)."""
    both = declared.join(loaded, "source_file", "full_outer").withColumn("known", F.lit(True))
    has_d = declared.select("source_file", F.lit(True).alias("has_receipt"))
    both = both.join(has_d, "source_file", "left")
    state = (F.when(F.col("has_receipt").isNull(), "unreceipted").when(F.col("declared").isNull(), "pending").when(F.col("loaded").isNull(), "missing")
             .when(F.col("loaded") < F.col("declared"), "short").when(F.col("loaded") > F.col("declared"), "over").otherwise("matched"))
    return both.select("source_file", "declared", "loaded", state.alias("state"))


def replay_proof(winners: DataFrame, stored: DataFrame) -> DataFrame:
    """JON-10: expected winner against stored row of every key: conform, divergent, missing, unexpected."""
    w = winners.where("kind = 'upsert'").select("k", F.col("event_id").alias("expected"))
    s = stored.select("k", F.col("event_id").alias("stored"))
    both = w.join(s, "k", "full_outer")
    return both.agg(F.count_if(F.col("expected") == F.col("stored")).alias("conform"), F.count_if(F.col("expected") != F.col("stored")).alias("divergent"),
                    F.count_if(F.col("stored").isNull()).alias("missing"), F.count_if(F.col("expected").isNull()).alias("unexpected"))


# -- multisets and offsets -------------------------------------------------------------------------

def multiset_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET-3: overlap, missing and extra with multiplicity, in one pass over both sides."""
    n = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = n.groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return per.agg(F.sum(F.least("x", "y")).alias("overlap"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("extra"))


def set_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET-4: the same over distinct keys."""
    per = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy(*keys).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return per.agg(F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("overlap"), F.count_if(F.col("y") == 0).alias("missing"), F.count_if(F.col("x") == 0).alias("extra"))


def best_offset(a: DataFrame, b: DataFrame, hours: list[int]) -> DataFrame:
    """JON-13 and SET-6: overlap of a with b shifted by each of a few hours, most overlap first, ties to the
    smaller offset; ``best`` is null if nothing overlaps.  Whole hours leave the place in the hour as it is, so rows are dealt
    by it once, sorted and counted there; an offset is a range of the window that the sort gives, so no task multiplies or hashes its rows."""
    side = lambda df, x: df.select("at_ms", "op", F.lit(x).alias("x"), F.lit(1 - x).alias("y"))
    dealt = side(a, 1).unionByName(side(b, 0)).withColumn("place", F.pmod("at_ms", F.lit(3600000))).repartition("op", "place")
    place = Window.partitionBy("op", "place").orderBy("at_ms")
    same, before = place.rangeBetween(0, 0), place.rowsBetween(-1, -1)
    counted = dealt.select("op", "place", "at_ms", F.sum("x").over(same).alias("x"), F.sum("y").over(same).alias("y"), F.max("at_ms").over(before).alias("__before"),
                           *[F.sum("y").over(place.rangeBetween(h * 3600000, h * 3600000)).alias(f"y{i}") for i, h in enumerate(hours)])
    once = counted.where("__before is null or __before <> at_ms")  # one row a moment
    there = F.col("at_ms").isNotNull() & F.col("op").isNotNull()
    overlap = lambda i: F.sum(F.when(there, F.least("x", F.coalesce(f"y{i}", F.lit(0)))).otherwise(0))
    sums = once.agg(F.count("*").alias("n"), *[overlap(i).alias(f"o{i}") for i in range(len(hours))]).where("n > 0")
    got = sums.select(F.explode(F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"o{i}").alias("overlap")) for i, h in enumerate(hours)])).alias("m")).select("m.*")
    first = F.max(F.struct("overlap", -F.col("hours"))).over(Window.partitionBy(F.lit(0)))  # one row an offset
    return got.select("hours", "overlap", ((F.col("overlap") > 0) & (F.struct("overlap", -F.col("hours")) == first)).alias("best"))


def classify_matrix(events: DataFrame, captured: DataFrame, coverage: DataFrame, band_ms: int) -> DataFrame:
    """SET-5: per source table and band of time PASS, FAIL or NOT_COMPARABLE, and why; a matrix of several source tables is
    refused.  events, captured: table_name, at_ms, op; coverage: low, high (one row)."""
    tag = lambda df, x, y: df.select("table_name", "at_ms", "op", F.lit(x).alias("x"), F.lit(y).alias("y"))
    per = tag(events, 1, 0).unionByName(tag(captured, 0, 1)).groupBy("table_name", "at_ms", "op").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    band = per.groupBy("table_name", F.floor(F.col("at_ms") / band_ms).alias("band")).agg(
        F.sum(F.least("x", "y")).alias("overlap"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("extra"))
    tables = band.agg(F.count_distinct("table_name").alias("tables"))
    x = band.crossJoin(tables).crossJoin(coverage.select(F.col("low").alias("c_low"), F.col("high").alias("c_high")))  # one row each
    low, high = F.col("band") * band_ms, F.col("band") * band_ms + band_ms - 1
    why = (F.when(F.col("tables") > 1, "several_tables").when(F.col("c_low").isNull(), "no_coverage").when(low < F.col("c_low"), "before_coverage").when(high > F.col("c_high"), "after_coverage"))
    verdict = F.when(why.isNotNull(), "NOT_COMPARABLE").when((F.col("missing") == 0) & (F.col("extra") == 0), "PASS").otherwise("FAIL")
    return x.select("table_name", "band", "overlap", "missing", "extra", verdict.alias("verdict"), why.alias("reason"))


def band_comparability(bands: DataFrame, coverage: DataFrame) -> DataFrame:
    """SET-5: PASS, FAIL or NOT_COMPARABLE: a band only compares inside both systems' coverage.
    bands: band, low, high, overlap, missing, extra; coverage: one row (low, high)."""
    c = coverage.select(F.col("low").alias("__l"), F.col("high").alias("__h"))
    inside = (F.col("low") >= F.col("__l")) & (F.col("high") <= F.col("__h"))
    verdict = F.when(~inside, "NOT_COMPARABLE").when((F.col("missing") == 0) & (F.col("extra") == 0), "PASS").otherwise("FAIL")
    return bands.join(F.broadcast(c)).select("band", verdict.alias("verdict"))  # coverage is one row


def position_diff(captured: DataFrame, source: DataFrame) -> DataFrame:
    """SET-7: (receiver, sequence) pairs missing, unexpected or captured more than once."""
    k = ["receiver", "sequence"]
    per = captured.select(*k, F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(source.select(*k, F.lit(0).alias("c"), F.lit(1).alias("s"))).groupBy(*k).agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    kind = F.when(F.col("c") == 0, "missing").when(F.col("s") == 0, "unexpected").when(F.col("c") > 1, "duplicate")
    return per.withColumn("kind", kind).where("kind is not null").select(*k, "kind")


# -- history and replay checks -----------------------------------------------------------------------

def duplicate_identities(history: DataFrame) -> DataFrame:
    """AGG-17: ids that history holds more than once, and how often."""
    return history.groupBy("event_id").agg(F.count("*").alias("copies")).where("copies > 1")


def replay_check(raw: DataFrame, content: list[str]) -> DataFrame:
    """AGG-18: repeats that are identical and that diverge; identical ones must account for all repeats."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    per = raw.groupBy("event_id").agg(F.count("*").alias("n"), F.min(digest).alias("a"), F.max(digest).alias("b"))
    same, more = F.col("a") == F.col("b"), F.col("n") - 1
    return per.agg(F.sum("n").alias("raw_rows"), F.count("*").alias("distinct_ids"), F.sum(F.when(same, more).otherwise(0)).alias("identical_repeats"), F.sum(F.when(same, 0).otherwise(more)).alias("divergent_repeats"))


def before_image_mismatch(events: DataFrame, ranks: DataFrame, most: int = MOST) -> DataFrame:
    """WIN-9: before-images that differ from the state just before, and deletes of absent keys; a key of more than ``most``
    events is scanned in ranges.  events: k, receiver, sequence, operation, before_value, after_value."""
    ranked = events.join(F.broadcast(ranks.select("receiver", F.col("receiver_rank").alias("__r"))), "receiver", "left").withColumn("__r", F.coalesce("__r", F.lit(-1)))
    post = F.when(F.col("operation") == "d", F.struct(F.lit(False).alias("there"), F.lit(None).cast("long").alias("v"))).otherwise(F.struct(F.lit(True).alias("there"), F.col("after_value").alias("v")))
    seen = running(ranked, ["k"], ["__r", "sequence"], last={"__b": F.when(F.col("operation") != "u_before", post)}, most=most)
    there = F.coalesce(F.col("__b.there"), F.lit(False))
    why = (F.when(F.col("operation").isin("d") & ~there, "delete_of_absent_key")
           .when(F.col("operation").isin("d", "u", "u_before") & there & F.col("before_value").isNotNull() & ~F.col("before_value").eqNullSafe(F.col("__b.v")), "before_image_differs"))
    return seen.withColumn("reason", why).where("reason is not null").select("k", "receiver", "sequence", "reason")


def reconcile_run(oracle: DataFrame, source: DataFrame, destination: DataFrame, mirror: DataFrame, key: str, fields: list[str], events: DataFrame, ranks: DataFrame, bootstrap: tuple[str, int],
                  source_positions: DataFrame, raw: DataFrame, content: list[str], history_ids: DataFrame, deleted: DataFrame) -> DataFrame:
    """REC-2: one row with a counter for every part of a run's proof, and PASS only if all that must be 0 are.
    oracle, source, destination, mirror: key and fields (destination is the replayed state, mirror the stored rows);
    events: the ledger, with k, before_value and after_value for the images; ranks: receiver, receiver_rank; bootstrap: the
    position (receiver, sequence) before which the journal may hold nothing; source_positions: receiver, sequence;
    history_ids: one id a stored row; deleted: keys that must be gone.  Unknown parts count as wrong."""
    journal = events.where(~is_snapshot())
    three = reconcile3(oracle, source, destination, mirror, key, fields)
    parts = [three.agg(*[F.coalesce(F.sum(F.when(F.col("pair") == p, F.col("missing") + F.col("extra") + F.col("different"))), F.lit(0)).alias(p.replace("-", "_vs_"))
                         for p in ("oracle-source", "oracle-destination", "source-destination", "destination-mirror", "oracle-mirror")]),
             mirror.groupBy(key).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("duplicate_mirror_keys"))]
    edge = ranks.where(F.col("receiver") == bootstrap[0]).agg(F.max("receiver_rank").alias("edge"))
    ranked = journal.join(F.broadcast(ranks.select("receiver", "receiver_rank")), "receiver", "left").crossJoin(edge)  # one row
    before = (F.col("receiver_rank") < F.col("edge")) | ((F.col("receiver_rank") == F.col("edge")) & (F.col("sequence") < bootstrap[1]))
    parts.append(ranked.agg(F.count_if(before | F.col("receiver_rank").isNull() | F.col("edge").isNull()).alias("before_bootstrap")))
    parts.append(position_diff(journal, source_positions).agg(F.count("*").alias("position_differences")))
    parts.append(replay_check(raw, content).select(F.col("divergent_repeats").alias("divergent_repeats"), (F.col("raw_rows") - F.col("distinct_ids") - F.col("identical_repeats") - F.col("divergent_repeats")).alias("unexplained_repeats")))
    parts.append(before_image_mismatch(journal, ranks).agg(F.count("*").alias("before_image_mismatches")))
    parts.append(destination.join(deleted.select(key), key, "left_semi").agg(F.count("*").alias("deleted_present")))
    ids = history_ids.groupBy("event_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("h"), F.count("*").alias("d"))
    parts.append(ids.crossJoin(events.agg(F.count("*").alias("e"))).select((F.col("h") - F.col("d")).alias("history_repeats"), F.abs(F.col("h") - F.col("e")).alias("history_off_by")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    bad = F.lit(0)
    for c in out.columns:
        bad = bad + F.coalesce(F.col(c), F.lit(1))
    return out.withColumn("verdict", F.when(bad == 0, "PASS").otherwise("FAIL"))


def boundary_check(events: DataFrame, bootstrap_ts: str) -> DataFrame:
    """REC-3: rows of the snapshot, positions of the journal, and journal events before the bootstrap."""
    j = ~is_snapshot()
    return events.agg(F.count_if(~j).alias("snapshot_rows"), F.min(F.when(j, F.col("sequence"))).alias("least"), F.max(F.when(j, F.col("sequence"))).alias("most"),
                      F.count_if(j & (F.col("commit_ts") < F.lit(bootstrap_ts).cast("timestamp_ntz"))).alias("before_bootstrap"))


def history_equality(actual: DataFrame, expected: DataFrame, content: list[str]) -> DataFrame:
    """REC-4: same ids, same contents, no repeated id or position."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    per = (actual.select("event_id", digest.alias("d"), F.lit(1).alias("a"), F.lit(0).alias("e")).unionByName(expected.select("event_id", digest.alias("d"), F.lit(0).alias("a"), F.lit(1).alias("e")))
           .groupBy("event_id").agg(F.sum("a").alias("a"), F.sum("e").alias("e"), (F.min("d") == F.max("d")).alias("same")))
    ids = per.agg(F.count_if(F.col("a") == 0).alias("missing"), F.count_if(F.col("e") == 0).alias("unexpected"), F.count_if((F.col("a") > 0) & (F.col("e") > 0) & ~F.col("same")).alias("different"), F.count_if(F.col("a") > 1).alias("repeated_ids"))
    places = actual.groupBy("receiver", "sequence").agg(F.count_distinct("event_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_positions"))
    both = ids.crossJoin(places)  # one row each
    bad = F.lit(0)
    for c in both.columns:
        bad = bad + F.col(c)
    return both.withColumn("verdict", F.when(bad == 0, "PASS").otherwise("FAIL"))


def reconcile_events(source: DataFrame, dest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """REC-1: volumes, identities and values of two systems, and a verdict."""
    d = diff_summary(source, dest, [key], fields)
    sizes = source.agg(F.count("*").alias("source_rows")).crossJoin(dest.agg(F.count("*").alias("dest_rows")))  # one row each
    return sizes.crossJoin(d).withColumn("verdict", F.when((F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("differing") == 0), "PASS").otherwise("FAIL"))


def reconcile3(oracle: DataFrame, source: DataFrame, destination: DataFrame, mirror: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JON-12: five pairwise differences in one pass: every system is tagged and grouped once by key.  A key that a system holds
    with several contents differs from any other; copies of one content do not."""
    systems = {"oracle": oracle, "source": source, "destination": destination, "mirror": mirror}
    pairs = [("oracle", "source"), ("oracle", "destination"), ("source", "destination"), ("destination", "mirror"), ("oracle", "mirror")]
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    tagged = None
    for name, df in systems.items():
        one = df.select(F.col(key).alias("key"), F.lit(name).alias("system"), digest.alias("d"))
        tagged = one if tagged is None else tagged.unionByName(one)
    per = tagged.groupBy("key").agg(*[pick(F.when(F.col("system") == s, F.col("d"))).alias(s + end) for s in systems for pick, end in ((F.max, ""), (F.min, "_least"))])
    several = {s: F.col(s) != F.col(f"{s}_least") for s in systems}
    rows = [F.struct(F.lit(f"{a}-{b}").alias("pair"), F.when(F.col(a).isNull() & F.col(b).isNull(), None).when(F.col(b).isNull(), "missing").when(F.col(a).isNull(), "extra").when((F.col(a) != F.col(b)) | several[a] | several[b], "different").otherwise("same").alias("kind")) for a, b in pairs]
    return (per.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("kind is not null").groupBy("pair")
            .agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("same", "missing", "extra", "different")]))


def reconcile_files(raw: DataFrame, ledger: DataFrame, files: DataFrame, expected: int) -> DataFrame:
    """REC-7: of listed files: rows = distinct = ledger = expected and all files seen is PASS; short but clean is
    pending; anything else fails."""
    subset = raw.join(files, "source_file", "left_semi")
    r = subset.agg(F.count("*").alias("raw_rows"), F.count_distinct("event_id").alias("distinct_ids"), F.count_distinct("source_file").alias("files_seen"))
    led = ledger.join(subset.select("event_id"), "event_id", "left_semi").agg(F.count("*").alias("ledger_rows"))
    both = r.crossJoin(led).crossJoin(files.agg(F.count_distinct("source_file").alias("files_listed")))  # one row each
    clean = (F.col("raw_rows") == F.col("distinct_ids")) & (F.col("distinct_ids") == F.col("ledger_rows"))
    verdict = F.when(clean & (F.col("raw_rows") == expected) & (F.col("files_seen") == F.col("files_listed")), "PASS").when(clean & (F.col("raw_rows") < expected), "pending").otherwise("FAIL")
    return both.withColumn("verdict", verdict)


def window_delivery(windows: DataFrame, events: DataFrame, ledger: DataFrame, width: int = 100_000) -> DataFrame:
    """REC-9: per closed window: not_tested without events, matched, or invalid.
    windows: window_id, receiver, start_seq, end_seq, event_count; they do not overlap, so an event's window is
    the last one of its receiver that starts at or before it: one sort, no range join.  A receiver is dealt over ranges
    of ``width`` positions; a window has a row in every range that it reaches into, so one receiver is many tasks."""
    place = lambda c: F.floor(F.col(c) / width)
    w = (windows.where("end_seq >= start_seq").withColumn("range", F.explode(F.sequence(place("start_seq"), place("end_seq"))))
         .select("receiver", "range", F.greatest(F.col("start_seq"), F.col("range") * width).alias("sequence"), F.struct("window_id", "end_seq").alias("w")))
    e = events.select("receiver", place("sequence").alias("range"), "sequence", "event_id")
    both = (w.select("*", F.lit(None).cast("string").alias("event_id"), F.lit(0).alias("o"))
            .unionByName(e.select("*", F.lit(None).cast(w.schema["w"].dataType).alias("w"), F.lit(1).alias("o"))))
    inside = F.last("w", ignorenulls=True).over(Window.partitionBy("receiver", "range").orderBy("sequence", "o").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("in", inside).where("event_id is not null and sequence <= in.end_seq").select("in.window_id", "event_id")
    held = placed.join(ledger.select("event_id", F.lit(1).alias("there")), "event_id", "left")
    per = held.groupBy("window_id").agg(F.count("*").alias("raw_rows"), F.count_distinct("event_id").alias("distinct_ids"), F.count("there").alias("ledger_rows"))
    out = windows.join(per, "window_id", "left")
    whole = (F.col("raw_rows") == F.col("event_count")) & (F.col("distinct_ids") == F.col("raw_rows")) & (F.col("ledger_rows") == F.col("raw_rows"))
    state = F.when(F.col("event_count") == 0, "not_tested").when(whole, "matched").otherwise("invalid")
    return out.select("window_id", "event_count", F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"), state.alias("state"))


def chain_verdict(delivered: DataFrame) -> DataFrame:
    """REC-9: complete only if every window matched; one with no events to test leaves the chain untested."""
    n = lambda s: F.count_if(F.col("state") == s)
    verdict = F.when(F.count("*") == 0, "empty").when(n("invalid") > 0, "broken").when(n("not_tested") > 0, "untested").otherwise("complete")
    return delivered.agg(F.count("*").alias("windows"), n("matched").alias("matched"), n("not_tested").alias("not_tested"), n("invalid").alias("invalid"), verdict.alias("verdict"))


def write_latency(writes: DataFrame, visible: DataFrame) -> DataFrame:
    """REC-11: acknowledgement to first visibility per marker; inconsistent clocks have no latency."""
    first = visible.groupBy("marker").agg(F.min("visible_us").alias("visible_us"))
    both = writes.join(first, "marker", "left")
    bad = F.col("visible_us") < F.col("acked_us")
    return both.select("marker", F.when(~bad, F.col("visible_us") - F.col("acked_us")).alias("latency_us"), F.when(F.col("visible_us").isNull(), "not_visible").when(bad, "clock").alias("reason"))


def find_published(events: DataFrame, markers: DataFrame) -> DataFrame:
    """REC-12: the first publication of every marker; a tie for the first place is an error."""
    found = events.join(markers, "marker", "left_semi").groupBy("marker").agg(F.min(F.struct("published_us", "event_id")).alias("first"), F.count("*").alias("publications"))
    ties = events.join(found.select("marker", F.col("first.published_us").alias("published_us")), ["marker", "published_us"], "left_semi").groupBy("marker").agg(F.count_distinct("event_id").alias("ties"))
    return found.join(ties, "marker").select("marker", F.col("first.event_id").alias("event_id"), "publications", (F.col("ties") > 1).alias("ambiguous"))


def resume_progress(positions: DataFrame, ranks: DataFrame) -> DataFrame:
    """REC-13: forward, backward, same or unmeasured, across receivers.
    positions: id, before_receiver, before_seq, after_receiver, after_seq."""
    b = ranks.select(F.col("receiver").alias("before_receiver"), F.col("receiver_rank").alias("b"))
    a = ranks.select(F.col("receiver").alias("after_receiver"), F.col("receiver_rank").alias("a"))
    x = positions.join(F.broadcast(b), "before_receiver", "left").join(F.broadcast(a), "after_receiver", "left")
    here, there = F.struct(F.col("b"), F.col("before_seq")), F.struct(F.col("a"), F.col("after_seq"))
    unknown = F.col("a").isNull() | F.col("b").isNull() | F.col("before_seq").isNull() | F.col("after_seq").isNull()
    return x.select("id", F.when(unknown, "unmeasured").when(there > here, "forward").when(there < here, "backward").otherwise("same").alias("progress"))


def state_when(conditions: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The first condition that holds names the state."""
    out = None
    for c, name in conditions:
        out = F.when(c, name) if out is None else out.when(c, name)
    assert out is not None
    return out.otherwise(F.lit(otherwise))


def column_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """REC-1 and AGG-25: columns that only one side has, one row each; known from the schemas."""
    spark = left.sparkSession
    rows = [(c, "missing") for c in left.columns if c not in right.columns] + [(c, "extra") for c in right.columns if c not in left.columns]
    return spark.createDataFrame(sorted(rows), "column string, kind string")


def cell_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-25: per column its cells, nulls and cells that are numbers, as text says it."""
    number = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    return cells.groupBy("column").agg(F.count("*").alias("cells"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v").rlike(number)).alias("numeric"))


def duplicate_totals(history: DataFrame) -> DataFrame:
    """AGG-17: rows, distinct ids, rows too many, and ids that repeat."""
    per = history.groupBy("event_id").agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_ids"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("surplus"), F.count_if(F.col("c") > 1).alias("repeated_ids"))


def multiset_digests(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET-3: order-free digests of overlap, missing and extra with multiplicity: the sum of 60 bits of each key's
    SHA-256, as often as the key counts."""
    n = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = n.groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    parts = {"overlap": F.least("x", "y"), "missing": F.greatest(F.col("x") - F.col("y"), F.lit(0)), "extra": F.greatest(F.col("y") - F.col("x"), F.lit(0))}
    return per.agg(*[F.coalesce(F.sum((h * c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"{k}_digest") for k, c in parts.items()])


def write_bounds(writes: DataFrame, published: DataFrame, visible: DataFrame) -> DataFrame:
    """REC-11: per marker the times from acknowledgement to raw and to visible; what became visible between two looks lies
    between a lower and an upper bound.  writes: marker, acked_us; published: marker, raw_us; visible: marker, absent_us (last look
    without it, null: none), visible_us (first look with it)."""
    raw = published.groupBy("marker").agg(F.min("raw_us").alias("raw_us"))
    seen = visible.groupBy("marker").agg(F.max("absent_us").alias("absent_us"), F.min("visible_us").alias("visible_us"))
    x = writes.join(raw, "marker", "left").join(seen, "marker", "left")
    bad = (F.col("raw_us") < F.col("acked_us")) | (F.col("visible_us") < F.col("acked_us")) | (F.col("visible_us") < F.col("absent_us"))
    why = F.when(F.col("visible_us").isNull(), "not_visible").when(F.coalesce(bad, F.lit(False)), "clock")
    ok = why.isNull()
    return x.select("marker", F.when(ok, F.col("raw_us") - F.col("acked_us")).alias("to_raw_us"), F.when(ok, F.greatest(F.coalesce("absent_us", "acked_us") - F.col("acked_us"), F.lit(0))).alias("at_least_us"),
                    F.when(ok, F.col("visible_us") - F.col("acked_us")).alias("at_most_us"), why.alias("reason"))
