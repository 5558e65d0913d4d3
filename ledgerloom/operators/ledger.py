"""Deduplication, ordering across receivers, and replay of a change ledger.

Events: event_id, receiver, sequence, operation, commit_ts, ingested_at, source_file, before_key, after_key
and image columns.  Where only a winner is asked for, it is a maximum of a struct: partial aggregation
combines on the map side, so a hot key sends one row a task, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.forms import key_fingerprint
from ..sources.raw import cut

SNAPSHOT = "SNAPSHOT:"


def is_snapshot(receiver: str = "receiver") -> Column:
    return F.col(receiver).startswith(SNAPSHOT)


def _best(df: DataFrame, keys: list[str], order: list[Column], least: bool = False) -> DataFrame:
    """The first (``least``) or last row of each key in a total order, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(rest)])
    pick = (F.min if least else F.max)(packed).alias("__row")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"__row.v{i}").alias(c) for i, c in enumerate(rest)])


def dedupe_first(raw: DataFrame) -> DataFrame:
    """WIN-1: the first delivered copy of every event (ingest time, then file)."""
    return _best(raw, ["event_id"], [F.col("ingested_at"), F.col("source_file")], least=True)


def canonical_view(raw: DataFrame) -> DataFrame:
    """WIN-2: the latest copy of every event (sequence, ingest time, file)."""
    return _best(raw, ["event_id"], [F.col("sequence"), F.col("ingested_at"), F.col("source_file")])


def receiver_ranks(ledger: DataFrame) -> DataFrame:
    """WIN-3: receiver, first_ts, receiver_rank by the receivers' first commit; snapshots have none.
    One row a receiver stands in the window, whatever the ledger's size."""
    first = ledger.where(~is_snapshot()).groupBy("receiver").agg(F.min("commit_ts").alias("first_ts"))
    return first.withColumn("receiver_rank", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("first_ts")).cast("long"))


def operations(ledger: DataFrame) -> DataFrame:
    """SET-2: upserts and deletes by key, several from one event, in one scan."""
    op, before, after = F.col("operation"), F.col("before_key"), F.col("after_key")
    up = F.when(op.isin("c", "u", "u_after") & after.isNotNull(), F.struct(after.alias("k"), F.lit("upsert").alias("kind")))
    down = F.when((op.isin("d", "u_before") & before.isNotNull()) | ((op == "u") & before.isNotNull() & ~before.eqNullSafe(after)),
                  F.struct(before.alias("k"), F.lit("delete").alias("kind")))
    both = F.filter(F.array(up, down), lambda x: x.isNotNull())
    return ledger.select("*", F.explode(both).alias("__o")).select(*ledger.columns, F.col("__o.k").alias("k"), F.col("__o.kind").alias("kind"))


def latest_operation(ops: DataFrame, ranks: DataFrame) -> DataFrame:
    """WIN-4: the winning operation of every key: journal before snapshot, later receiver, higher sequence,
    upsert before delete, then commit time, event id and file."""
    ranked = ops.join(F.broadcast(ranks.select("receiver", "receiver_rank")), "receiver", "left")  # one row a receiver
    order = [~is_snapshot(), F.coalesce("receiver_rank", F.lit(-1)), F.col("sequence"), F.col("kind") == "upsert", F.col("commit_ts"), F.col("event_id"), F.col("source_file")]
    return _best(ranked, ["k"], order)


def mirror_winner(history: DataFrame, ranks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """WIN-5: per key the row a batch applies: latest copy of each id, before-images dropped, highest
    (receiver rank, sequence); the rank makes it hold across batches as well."""
    rows = history.join(ids, "event_id", "left_semi") if ids is not None else history
    latest = _best(rows, ["event_id"], [F.col("ingested_at")]).where("operation <> 'u_before'")
    keyed = latest.withColumn("k", F.coalesce("after_key", "before_key")).where("k is not null")
    ranked = keyed.join(F.broadcast(ranks.select("receiver", "receiver_rank")), "receiver", "left")
    return _best(ranked, ["k"], [F.coalesce("receiver_rank", F.lit(-1)), F.col("sequence"), F.col("event_id")])


def replay_full(ledger: DataFrame) -> DataFrame:
    """REP-1: the current state from the whole ledger."""
    won = latest_operation(operations(ledger), receiver_ranks(ledger))
    return won.where("kind = 'upsert'").select("k", "cents", "event_type", "event_id", "receiver", "sequence", "commit_ts")


def touched_keys(changed: DataFrame) -> DataFrame:
    """SET-1: the keys that events touch, by either image."""
    return changed.select(F.explode(F.array("before_key", "after_key")).alias("k")).where("k is not null").distinct()


def scope(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """JON-5: events that touch any of the keys by either image: two hash semi joins, not one OR join."""
    k = keys.select(F.col("k").alias("__k"))
    by_after = ledger.join(k, F.col("after_key") == F.col("__k"), "left_semi")
    rest = ledger.where("before_key is not null and not (before_key <=> after_key)")
    return by_after.unionByName(rest.join(k, F.col("before_key") == F.col("__k"), "left_semi")).dropDuplicates(["event_id"])


def replay_incremental(ledger: DataFrame, mirror: DataFrame, watermark) -> DataFrame:
    """REP-2: the mirror after events ingested past ``watermark``.  Only keys they touch are replayed, over
    those keys' whole history; ranks come from the whole ledger, and operations on other keys, which a
    key-moving event brings along, are left out."""
    keys = touched_keys(ledger.where(F.col("ingested_at") > F.lit(watermark).cast("timestamp_ntz")))
    ops = operations(scope(ledger, keys)).join(keys, "k", "left_semi")
    won = latest_operation(ops, receiver_ranks(ledger)).where("kind = 'upsert'").select(*mirror.columns)
    return mirror.join(keys, "k", "left_anti").unionByName(won)


#: An operation with all that operations are compared by, deletes included.
STATE = "k long, kind string, cents long, event_type string, event_id string, receiver string, sequence long, commit_ts timestamp_ntz, source_file string"
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def advance(state: DataFrame, events: DataFrame) -> DataFrame:
    """REP-2 on stored winners (``STATE``, one row a key and receiver): the winners of the keys in state and events after these
    events.  Inside one receiver order is fixed for good, so a stored winner stands for all its key's events there, which
    are not read, and nothing is made anew when the receivers turn out to stand in another order: ``resolve`` settles that."""
    rows = state.unionByName(operations(events).select(*STATE_COLUMNS))
    return _best(rows, ["k", "receiver"], [F.col("sequence"), F.col("kind") == "upsert", F.col("commit_ts"), F.col("event_id"), F.col("source_file")]).select(*STATE_COLUMNS)


def resolve(state: DataFrame, ranks: DataFrame) -> DataFrame:
    """The winner of every key among its winners by receiver."""
    return latest_operation(state, ranks).select(*STATE_COLUMNS)


def winners_by_receiver(events: DataFrame) -> DataFrame:
    """The streaming form of ``advance``: per key and receiver the winning operation (``won``), and, under a null key, per
    receiver the first commit (``first_ts``).  Partial aggregation sends one row a task for a hot key or receiver."""
    ops = operations(events).select(*STATE_COLUMNS)
    seen = events.select(*[F.col(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in STATE.split(", "))])
    won = F.struct("sequence", (F.col("kind") == "upsert").alias("up"), "commit_ts", "event_id", "source_file", "kind", "cents", "event_type")
    return ops.unionByName(seen).groupBy("k", "receiver").agg(F.max(won).alias("won"), F.min("commit_ts").alias("first_ts"))


def project_events(ledger: DataFrame, images: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """PRJ-6: what full and incremental replay share: lower-case operation, snapshot flag, both keys and their fingerprints
    (null where the image is absent), and both images as JSON (name: before and after column)."""
    side = lambda i: F.to_json(F.struct(*[F.col(c[i]).alias(n) for n, c in images.items()]), {"ignoreNullFields": "false"}) if images else F.lit(None).cast("string")
    there = {s: F.col(f"{s}_key").isNotNull() for s in ("before", "after")}
    return ledger.select("event_id", "receiver", "sequence", F.lower("operation").alias("op"), is_snapshot().alias("is_snapshot"), "before_key", "after_key",
                         *[key_fingerprint(there[s], f"{s}_key").alias(f"{s}_fp") for s in there], *[F.when(there[s], side(i)).alias(f"{s}_image") for i, s in enumerate(there)])


def idempotence_check(raw: DataFrame, history: DataFrame) -> DataFrame:
    """REP-3: loading the same deliveries twice: raw rows, distinct ids, history after the first load, and what the second
    load would insert; stable only if that is nothing and history holds every id once."""
    first = history.unionByName(append_history(raw, history).select(*history.columns))
    again = append_history(raw, first)
    x = (raw.agg(F.count("*").alias("raw_rows"), F.count_distinct("event_id").alias("distinct_ids")).crossJoin(first.agg(F.count("*").alias("ledger_rows"), F.count_distinct("event_id").alias("ids")))
         .crossJoin(again.agg(F.count("*").alias("inserted_again"))))  # one row each
    return x.select("raw_rows", "distinct_ids", "ledger_rows", "inserted_again", ((F.col("inserted_again") == 0) & (F.col("ledger_rows") == F.col("ids"))).alias("stable"))


def snapshot_complete(mirror: DataFrame, rows_copied: int) -> DataFrame:
    """SRC-13: whether the mirror holds as many rows as the snapshot says it copied, and each key once."""
    a = mirror.agg(F.count("*").alias("rows"), F.count_distinct("k").alias("keys"))
    return a.select("rows", "keys", F.lit(rows_copied).cast("long").alias("rows_copied"), ((F.col("rows") == rows_copied) & (F.col("rows") == F.col("keys"))).alias("complete"))


def append_history(events: DataFrame, history: DataFrame, content: list[str] | None = None) -> DataFrame:
    """SRC-11: the events that history does not hold yet, once each.  With ``content``, ids that come with another content
    than they have, in history or among themselves, are an error; it names how many there are."""
    if content is not None:
        held = history.join(events.select("event_id").distinct(), "event_id", "left_semi")
        bad = conflicts(held.select("event_id", *content).unionByName(events.select("event_id", *content)), content).count()
        if bad:
            raise ValueError(f"{bad} ids come with more than one content")
    return dedupe_first(events).join(history.select("event_id"), "event_id", "left_anti")


def conflicts(events: DataFrame, content: list[str]) -> DataFrame:
    """Ids that arrive with more than one content: event_id, contents."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    found = events.groupBy("event_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b"), F.count("*").alias("copies"))
    return found.where("a <> b").select("event_id", "copies")


def apply_mirror(mirror: DataFrame, winners: DataFrame) -> DataFrame:
    """SRC-12: delete, update or insert by key; an unmatched delete inserts nothing."""
    kept = mirror.join(winners.select("k"), "k", "left_anti")
    return kept.unionByName(winners.where("kind <> 'delete'").select(*mirror.columns))


def replace_from_snapshot(ledger: DataFrame, run: str) -> DataFrame:
    """SRC-13: the mirror that a new snapshot run leaves."""
    s = ledger.where(F.col("receiver") == f"{SNAPSHOT}{run}")
    return s.select(F.col("after_key").alias("k"), "cents", "event_type", "event_id", "receiver", "sequence", "commit_ts")


def snapshot_as_events(table: DataFrame, key: str, run: str, schema_table: str, first: int = 1) -> DataFrame:
    """SRC-6: a table as create events; the ordinal follows the key (range partitions, no global sort in
    one task), and ``first`` is the base of a chunk's range.  The image holds the ordinal as ``_rrn``, a reserved name."""
    if "_rrn" in table.columns:
        raise ValueError("_rrn is reserved")
    spark = table.sparkSession
    # cut: ranges are sampled anew by every run of the plan, and rows and sizes must come from the same ones
    dealt = cut(table.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()))
    inside = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(key)))
    sizes = dealt.groupBy("__p").count()  # one row a partition
    base = sizes.select("__p", (F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__b"))
    numbered = inside.join(F.broadcast(base), "__p").withColumn("sequence", F.col("__b") + F.col("__i") + (first - 1))
    receiver = f"{SNAPSHOT}{run}"
    return numbered.select(
        F.sha2(F.concat_ws("|", F.lit("ibmi"), F.lit(f"{SNAPSHOT}{schema_table}"), F.lit(receiver), "sequence"), 256).alias("event_id"), F.lit(receiver).alias("receiver"), "sequence",
        F.lit("c").alias("operation"), F.to_json(F.struct(*table.columns, F.col("sequence").alias("_rrn")), {"ignoreNullFields": "false"}).alias("after"))
