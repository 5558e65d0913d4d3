"""Window operators over receipts, receivers, polls, buckets and checks.

Windows are partitioned by the stream they order (table, pipeline, run); where one stream may be the whole
input (receipts of one table), what is ordered is one short row a window of events, not the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def receipt_gaps(receipts: DataFrame, ranks: DataFrame) -> DataFrame:
    """WIN-6: receipts in (receiver rank, start) order with what is wrong: a gap, an overlap, a duplicate, or a
    rotation that does not start at the receiver's first sequence.  ranks: receiver, receiver_rank,
    first_seq, last_seq (one row a receiver)."""
    r = receipts.join(F.broadcast(ranks), "receiver", "left")
    w = Window.partitionBy("table_name").orderBy(F.col("receiver_rank").asc_nulls_last(), "start_seq", "end_seq")
    x = r.withColumns({"p_end": F.lag("end_seq").over(w), "p_recv": F.lag("receiver").over(w), "p_start": F.lag("start_seq").over(w), "p_last": F.lag("last_seq").over(w)})
    same = F.col("p_recv") == F.col("receiver")
    expected = F.when(same, F.col("p_end") + 1).when(F.col("p_recv").isNotNull(), F.col("first_seq"))
    kind = (F.when(F.col("receiver_rank").isNull(), "receiver_unknown").when(F.col("p_recv").isNull(), None).when(same & (F.col("start_seq") == F.col("p_start")) & (F.col("end_seq") == F.col("p_end")), "duplicate")
            .when(F.col("start_seq") > expected, "gap").when(F.col("start_seq") < expected, "overlap").when(~same & (F.col("p_end") < F.col("p_last")), "gap_before_rotation"))
    return x.select("table_name", "receiver", "start_seq", "end_seq", expected.alias("expected"), kind.alias("kind"))


def receipt_verdict(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("table_name").agg(F.count("*").alias("receipts"), F.count_if(F.col("kind") == "gap").alias("gaps"), F.count_if(F.col("kind") == "duplicate").alias("duplicates"),
                                          F.when(F.count("kind") == 0, "continuous").otherwise("broken").alias("verdict"))


def receipt_counts(receipts: DataFrame, events: DataFrame, width: int = 500) -> DataFrame:
    """WIN-6: per receipt the declared count against the events present in its range.  Both sides meet by ranges of ``width``
    positions.  receipts: table_name, receiver, start_seq, end_seq, event_count; events: receiver, sequence."""
    place = lambda c: F.floor(F.col(c) / width)
    once = receipts.distinct()
    r = once.withColumn("__range", F.explode(F.sequence(place("start_seq"), place("end_seq"))))
    found = r.join(events.select("receiver", "sequence", place("sequence").alias("__range")), ["receiver", "__range"]).where("sequence between start_seq and end_seq")
    key = ["table_name", "receiver", "start_seq", "end_seq"]
    present = found.groupBy(*key).agg(F.count("*").alias("present"))
    x = once.join(present, key, "left").withColumn("present", F.coalesce("present", F.lit(0)))
    return x.select(*key, F.col("event_count").alias("declared"), "present", F.when(F.col("present") < F.col("event_count"), "short").when(F.col("present") > F.col("event_count"), "over").otherwise("matched").alias("state"))


def receiver_chain(catalogue: DataFrame) -> DataFrame:
    """WIN-7: each receiver's link to the one before it: start, reset, continued, gap, or broken.
    catalogue: journal, receiver, ordinal, first_seq, last_seq, previous."""
    w = Window.partitionBy("journal").orderBy("ordinal")
    x = catalogue.withColumns({"p": F.lag("receiver").over(w), "p_last": F.lag("last_seq").over(w), "twice": F.count("*").over(Window.partitionBy("journal", "receiver")) > 1})
    kind = (F.when(F.col("twice"), "duplicate").when(F.col("first_seq").isNull() | F.col("last_seq").isNull(), "uncertain").when(F.col("p").isNull(), "start")
            .when(~F.col("previous").eqNullSafe(F.col("p")), "broken").when(F.col("first_seq") == F.col("p_last") + 1, "continued").when(F.col("first_seq") == 1, "reset").otherwise("gap"))
    return x.select("journal", "receiver", "ordinal", kind.alias("link"))


def chain_lag(cursors: DataFrame, catalogue: DataFrame) -> DataFrame:
    """WIN-8: entries from a cursor to the end of the chain: the rest of its receiver and all later ones; null
    if its receiver is unknown or a later bound is missing.  cursors: id, receiver, sequence."""
    w = Window.partitionBy("journal").orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, -1)
    span = F.col("last_seq") - F.col("first_seq") + 1
    c = catalogue.withColumns({"later": F.coalesce(F.sum(span).over(w), F.lit(0)), "holes": F.coalesce(F.count_if(span.isNull()).over(w), F.lit(0))})
    x = cursors.join(F.broadcast(c.select("receiver", "first_seq", "last_seq", "later", "holes")), "receiver", "left")  # one row a receiver
    fine = F.col("last_seq").isNotNull() & (F.col("holes") == 0) & (F.col("sequence") >= F.col("first_seq") - 1) & (F.col("sequence") <= F.col("last_seq"))
    return x.select("id", F.when(fine, F.col("last_seq") - F.col("sequence") + F.col("later")).alias("lag"))


def image_order(events: DataFrame) -> DataFrame:
    """WIN-10: per window the running balance of before over after images is never negative and ends at 0."""
    image = F.when(F.col("operation") == "u_before", 1).when(F.col("operation") == "u_after", -1).otherwise(0)
    w = Window.partitionBy("window").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("window", F.sum(image).over(w).alias("b"), image.alias("i")).groupBy("window").agg(F.min("b").alias("least"), F.sum("i").alias("final"), ((F.min("b") >= 0) & (F.sum("i") == 0)).alias("ordered"))


def position_order(events: DataFrame) -> DataFrame:
    """WIN-11: per window: one receiver and strictly rising sequences in arrival order."""
    w = Window.partitionBy("window").orderBy("arrival")
    x = events.withColumn("p", F.lag("sequence").over(w))
    return x.groupBy("window").agg(F.count_distinct("receiver").alias("receivers"), F.count_if(F.col("sequence") <= F.col("p")).alias("backwards"))


def delivery_rate(deliveries: DataFrame) -> DataFrame:
    """WIN-12: rows per 1,000 seconds since the delivery before; null for the first; activity by age of an hour
    or a day."""
    w = Window.partitionBy("pipeline").orderBy("at_us")
    gap = F.col("at_us") - F.lag("at_us").over(w)
    x = deliveries.withColumn("gap_us", gap)
    return x.select("pipeline", "at_us", F.when(F.col("gap_us") > 0, F.floor(F.col("n") * 1000000000 / F.col("gap_us"))).alias("per_1000_s"),
                    F.when(F.col("gap_us").isNull(), "first").when(F.col("gap_us") <= 3600000000, "active").when(F.col("gap_us") <= 86400000000, "slow").otherwise("idle").alias("activity"))


def cursor_throughput(samples: DataFrame) -> DataFrame:
    """WIN-13: positions per second between samples; null with a reason on the first sample, a rotation, a
    step back or no time between; the last arrival is carried on."""
    w = Window.partitionBy("pipeline").orderBy("at_us", "sequence")
    x = samples.withColumns({"ps": F.lag("sequence").over(w), "pr": F.lag("receiver").over(w), "pt": F.lag("at_us").over(w)})
    d, t = F.col("sequence") - F.col("ps"), F.col("at_us") - F.col("pt")
    why = F.when(F.col("pr").isNull(), "first").when(F.col("pr") != F.col("receiver"), "rotation").when(d < 0, "step_back").when(t <= 0, "no_time")
    arrival = F.last(F.when(d > 0, F.col("at_us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.select("pipeline", "at_us", "sequence", F.when(why.isNull(), F.floor(d * 1000000 / t)).alias("per_s"), why.alias("reason"), arrival.alias("last_arrival_us"))


def counter_delta(polls: DataFrame) -> DataFrame:
    """WIN-14: errors since the poll before; a counter that went back has no delta."""
    w = Window.partitionBy("run").orderBy("at_us", "n")
    p = F.lag("errors_total").over(w)
    return polls.withColumn("p", p).select("run", "n", F.when(F.col("p").isNull(), F.col("errors_total")).when(F.col("errors_total") >= F.col("p"), F.col("errors_total") - F.col("p")).alias("delta"), (F.col("errors_total") < F.coalesce("p", F.lit(0))).alias("went_back"))


def temporal_gaps(buckets: DataFrame, width_s: int) -> DataFrame:
    """WIN-15: the buckets and a synthetic gap row between neighbours that do not touch."""
    w = Window.partitionBy("pipeline").orderBy("start_s")
    p = F.lag("start_s").over(w) + width_s
    own = buckets.select("pipeline", "start_s", (F.col("start_s") + width_s).alias("end_s"), F.lit("bucket").alias("kind"), p.alias("p"))
    gaps = own.where("start_s > p").select("pipeline", F.col("p").alias("start_s"), F.col("start_s").alias("end_s"), F.lit("gap").alias("kind"))
    return own.drop("p").unionByName(gaps)


def coverage_verdict(rows: DataFrame) -> DataFrame:
    """WIN-15: per pipeline what its buckets and gap rows cover: complete, or with gaps."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return rows.groupBy("pipeline").agg(n("bucket").alias("buckets"), n("gap").alias("gaps"), F.coalesce(F.sum(F.when(F.col("kind") == "gap", F.col("end_s") - F.col("start_s"))), F.lit(0)).alias("gap_s"),
                                        F.when(n("gap") == 0, "complete").otherwise("gap").alias("coverage"))


def alert_changes(checks: DataFrame) -> DataFrame:
    """WIN-16: firing checks whose observed value has changed since the report before, while they go on firing."""
    w = Window.partitionBy("pipeline", "check").orderBy("at")
    seen = checks.where("status in ('breach', 'pass')").withColumns({"p": F.lag("status").over(w), "before": F.lag("observed").over(w)})
    return seen.where("status = 'breach' and p = 'breach' and not (observed <=> before)").select("pipeline", "check", "at", F.lit("changed").alias("event"), "before", "observed")


def alert_lifecycle(checks: DataFrame) -> DataFrame:
    """WIN-16: opened, resolved and reopened transitions of every (pipeline, check), with the occurrence's number
    and its evaluations so far; an unobserved check neither opens nor resolves."""
    w = Window.partitionBy("pipeline", "check").orderBy("at")
    seen = checks.where("status in ('breach', 'pass')").withColumn("p", F.lag("status").over(w))
    firing = F.col("status") == "breach"
    opens = firing & (F.col("p").isNull() | (F.col("p") == "pass"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = seen.withColumns({"occurrence": F.sum(F.when(opens, 1).otherwise(0)).over(upto), "breaches": F.sum(F.when(firing, 1).otherwise(0)).over(upto)})
    event = F.when(opens & (F.col("occurrence") == 1), "opened").when(opens, "reopened").when(~firing & (F.col("p") == "breach"), "resolved")
    return x.withColumn("event", event).where("event is not null").select("pipeline", "check", "at", "event", "occurrence", F.col("breaches").alias("evaluations"))


def choose_key(candidates: DataFrame) -> DataFrame:
    """WIN-17: the best identity of every table: images *BEFORE block it, *AFTER leaves the record number, else
    primary, unique, unique index by (rank, width, name), else the record number.
    candidates: table_name, images, kind (primary, unique, index, none), width, name."""
    order = F.struct(F.when(F.col("kind") == "primary", 1).when(F.col("kind") == "unique", 2).when(F.col("kind") == "index", 3).otherwise(9).alias("r"), "width", "name", "kind")
    best = candidates.groupBy("table_name").agg(F.max("images").alias("images"), F.min(order).alias("b"))
    return best.select("table_name", F.when(F.col("images") == "*BEFORE", "blocked").when((F.col("images") == "*AFTER") | (F.col("b.r") == 9), "rrn").otherwise(F.col("b.kind")).alias("identity"),
                       F.when((F.col("images") == "*BOTH") & (F.col("b.r") < 9), F.col("b.name")).alias("name"))


# -- top -------------------------------------------------------------------------------------------

def mismatch_sample(differences: DataFrame, order: list[str], k: int) -> DataFrame:
    """TOP-1: the true number of differences beside the first k of them."""
    total = differences.agg(F.count("*").alias("total"))
    return differences.orderBy(*order).limit(k).crossJoin(total)  # one row


def latest_per(facts: DataFrame, entity: str, order: list[str], value: list[str]) -> DataFrame:
    """TOP-2: newest fact of every entity."""
    return facts.groupBy(entity).agg(F.max(F.struct(*order, *value)).alias("x")).select(entity, *[F.col(f"x.{c}").alias(c) for c in (*order, *value)])


def _export(rows: DataFrame, order: list[str], bound: int) -> DataFrame:
    over = rows.agg((F.count("*") > bound).alias("exceeded"))
    return rows.crossJoin(over).orderBy(*order)  # one row


def ordered_export(mirror: DataFrame, key: str, bound: int) -> DataFrame:
    """TOP-3: all rows by key, dealt by ranges of it, and whether there are more than the bound."""
    return _export(mirror, [key], bound)


def history_export(history: DataFrame, bound: int) -> DataFrame:
    """TOP-3: all of history by ingest time and id, and whether there is more than the bound."""
    return _export(history, ["ingested_at", "event_id"], bound)


def coalesce_measures(first: DataFrame, second: DataFrame, key: str, columns: list[str], reasons: str) -> DataFrame:
    """PRJ-16: a measure from the first provider that knows it; reasons (maps) are merged."""
    b = second.select(key, *[F.col(c).alias(f"__{c}") for c in (*columns, reasons)], F.lit(True).alias("__there"))
    empty = F.create_map().cast("map<string,string>")
    x = first.join(b, key, "full_outer")
    mine, other = F.coalesce(reasons, empty), F.coalesce(f"__{reasons}", empty)
    return x.select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in columns], F.map_concat(F.map_filter(other, lambda k, v: ~F.map_contains_key(mine, k)), mine).alias(reasons))


def anchor_series(buckets: DataFrame, observed_us: int) -> DataFrame:
    """PRJ-17: relative offsets to absolute time: observed moment - (last end - end)."""
    last = F.max("end_s").over(Window.partitionBy("pipeline"))
    return buckets.select("pipeline", "start_s", (F.lit(observed_us) - (last - F.col("end_s")) * 1000000).alias("end_us"))


def table_readiness(catalogue: DataFrame) -> DataFrame:
    """REC-14: not_journaled, images_incomplete, no_key or ready; and whether a selection spans journals.
    catalogue: selection, table_name, journal, images, key_columns."""
    state = F.when(F.col("journal").isNull(), "not_journaled").when(F.col("images") != "*BOTH", "images_incomplete").when(F.col("key_columns").isNull(), "no_key").otherwise("ready")
    spans = catalogue.groupBy("selection").agg((F.count_distinct("journal") > 1).alias("several_journals"))
    return catalogue.join(spans, "selection").select("selection", "table_name", state.alias("state"), "several_journals")


def catalogue_join(tables: DataFrame, stats: DataFrame, journaled: DataFrame, keys: DataFrame) -> DataFrame:
    """JON-11: tables with their statistics, journal and key columns in order."""
    listed = keys.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "column"))), lambda x: x["column"]), ",").alias("key_columns"))
    return tables.join(stats, "table_name", "left").join(journaled, "table_name", "left").join(listed, "table_name", "left")
