"""Queries over the derived change ledger: order, replay, sets of operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources import fixtures as X
from ..sources import raw as W
from ..streaming.streams import IncrementalReplay
from .registry import query

COLUMNS = "event_id, receiver, sequence, operation, cents, source_file"


def ledger(spark, sf_dir):
    return L.dedupe_first(X.raw_events(spark, sf_dir))


def mirror(spark, sf_dir):
    return L.replay_full(ledger(spark, sf_dir))


@query("rep_1_replay_full", "SELECT k, cents, event_type, event_id, receiver, sequence, epoch_us(commit_ts) AS commit_us FROM mirror")
def _(spark, sf_dir):
    return mirror(spark, sf_dir).select("k", "cents", "event_type", "event_id", "receiver", "sequence", X.micros("commit_ts").alias("commit_us"))


@query("win_1_dedupe_first", f"SELECT {COLUMNS} FROM ledger")
def _(spark, sf_dir):
    return ledger(spark, sf_dir).selectExpr(*COLUMNS.split(", "))


@query("win_2_canonical_view", f"""SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sequence DESC, ingested_at DESC, source_file DESC) AS i FROM raw_events) WHERE i = 1""")
def _(spark, sf_dir):
    return L.canonical_view(X.raw_events(spark, sf_dir)).selectExpr(*COLUMNS.split(", "))


@query("win_3_receiver_rank", "SELECT receiver, epoch_us(first_ts) AS first_us, receiver_rank FROM receiver_ranks")
def _(spark, sf_dir):
    return L.receiver_ranks(ledger(spark, sf_dir)).select("receiver", X.micros("first_ts").alias("first_us"), "receiver_rank")


@query("win_4_latest_operation", "SELECT k, kind, event_id, receiver, sequence, receiver_rank FROM winners")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return L.latest_operation(L.operations(led), L.receiver_ranks(led)).select("k", "kind", "event_id", "receiver", "sequence", "receiver_rank")


@query("win_5_mirror_winner", """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC) AS i FROM raw_events) WHERE i = 1 AND operation <> 'u_before'),
x AS (SELECT l.*, coalesce(after_key, before_key) AS k, r.receiver_rank FROM latest l LEFT JOIN receiver_ranks r ON l.receiver = r.receiver)
SELECT k, event_id, operation, sequence FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(receiver_rank, -1) DESC, sequence DESC, event_id DESC) AS place FROM x WHERE k IS NOT NULL) WHERE place = 1""")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir)
    return L.mirror_winner(raw, L.receiver_ranks(L.dedupe_first(raw))).select("k", "event_id", "operation", "sequence")


@query("set_1_touched_keys", """SELECT DISTINCT k FROM (SELECT before_key AS k FROM ledger WHERE ingested_at > TIMESTAMP '2024-01-28 00:00:00' UNION ALL
SELECT after_key FROM ledger WHERE ingested_at > TIMESTAMP '2024-01-28 00:00:00') WHERE k IS NOT NULL""")
def _(spark, sf_dir):
    return L.touched_keys(ledger(spark, sf_dir).where("ingested_at > timestamp_ntz'2024-01-28 00:00:00'"))


@query("set_2_operations", "SELECT k, kind, event_id FROM operations")
def _(spark, sf_dir):
    return L.operations(ledger(spark, sf_dir)).select("k", "kind", "event_id")


@query("jon_5_touched_scope", """WITH t AS (SELECT DISTINCT k FROM (SELECT before_key AS k FROM ledger WHERE ingested_at > TIMESTAMP '2024-01-28 00:00:00' UNION ALL
SELECT after_key FROM ledger WHERE ingested_at > TIMESTAMP '2024-01-28 00:00:00') WHERE k IS NOT NULL)
SELECT event_id, before_key, after_key FROM ledger WHERE before_key IN (SELECT k FROM t) OR after_key IN (SELECT k FROM t)""")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return L.scope(led, L.touched_keys(led.where("ingested_at > timestamp_ntz'2024-01-28 00:00:00'"))).select("event_id", "before_key", "after_key")


@query("jon_6_attach_rank", "SELECT l.event_id, l.receiver, r.receiver_rank FROM ledger l LEFT JOIN receiver_ranks r ON l.receiver = r.receiver")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return led.join(F.broadcast(L.receiver_ranks(led)), "receiver", "left").select("event_id", "receiver", "receiver_rank")


@query("rep_2_replay_incremental", "SELECT k, cents, event_id, sequence FROM mirror")
def _(spark, sf_dir):
    """The winners at a watermark, moved on by the events past it, equal the full replay."""
    led = ledger(spark, sf_dir)
    past = F.col("ingested_at") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    ranks = L.receiver_ranks(led)
    before = L.advance(spark.createDataFrame([], L.STATE), led.where(~past))
    return L.resolve(L.advance(before, led.where(past)), ranks).where("kind = 'upsert'").select("k", "cents", "event_id", "sequence")


@query("rep_2_replay_by_history", "SELECT k, cents, event_id, sequence FROM mirror")
def _(spark, sf_dir):
    """Without stored winners: touched keys are replayed over their whole history."""
    led = ledger(spark, sf_dir)
    at = "2024-01-20 00:00:00"
    before = L.replay_full(led.where(F.col("ingested_at") <= F.lit(at).cast("timestamp_ntz")))
    return L.replay_incremental(led, before, at).select("k", "cents", "event_id", "sequence")


@query("rep_2_replay_with_watermark", "SELECT k, cents, event_id, sequence FROM mirror")
def _(spark, sf_dir):
    """Three runs on stored winners, each past the watermark of the one before."""
    led = W.stored(ledger(spark, sf_dir), "ledger")  # three runs read it
    r = IncrementalReplay(spark, W.scratch(spark, "replay"))
    for day in ("2024-01-08", "2024-01-21"):
        r.run(led.where(F.col("ingested_at") <= F.lit(f"{day} 00:00:00").cast("timestamp_ntz")))
    return r.run(led).select("k", "cents", "event_id", "sequence")


@query("rep_2_receiver_order_changes", "SELECT k, cents, event_id, sequence FROM mirror")
def _(spark, sf_dir):
    """The earliest receiver comes after the others, and its first events last of all: stored winners are ranked anew, not replayed."""
    led = W.stored(ledger(spark, sf_dir), "ledger")  # three runs read it
    r = IncrementalReplay(spark, W.scratch(spark, "order"))
    late = (F.col("receiver") == "JRN9") & (F.col("sequence") <= 3)
    r.run(led.where(~late & (F.col("receiver") != "JRN9")))
    r.run(led.where(~late).withColumn("ingested_at", F.when(F.col("receiver") == "JRN9", F.col("ingested_at") + F.expr("INTERVAL 100 DAYS")).otherwise(F.col("ingested_at"))))
    return r.run(led.withColumn("ingested_at", F.when(late, F.col("ingested_at") + F.expr("INTERVAL 200 DAYS")).when(
        F.col("receiver") == "JRN9", F.col("ingested_at") + F.expr("INTERVAL 100 DAYS")).otherwise(F.col("ingested_at")))).select("k", "cents", "event_id", "sequence")


@query("rep_3_idempotence", """SELECT count(*) AS raw_rows, count(DISTINCT event_id) AS distinct_ids, count(DISTINCT event_id) AS ledger_rows, 0::BIGINT AS inserted_again, true AS stable FROM raw_events""")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir)
    return L.idempotence_check(raw, raw.limit(0))


@query("src_6_snapshot_as_events", """SELECT row_number() OVER (ORDER BY c_custkey) AS sequence, sha256('ibmi|SNAPSHOT:TPCH.CUSTOMER|SNAPSHOT:S2|' || row_number() OVER (ORDER BY c_custkey)) AS event_id, 'c' AS operation, row_number() OVER (ORDER BY c_custkey) AS rrn, c_name FROM customer""")
def _(spark, sf_dir):
    s = L.snapshot_as_events(X.table(spark, sf_dir, "customer"), "c_custkey", "S2", "TPCH.CUSTOMER")
    return s.select("sequence", "event_id", "operation", F.get_json_object("after", "$._rrn").cast("long").alias("rrn"), F.get_json_object("after", "$.c_name").alias("c_name"))


@query("src_11_append_history", """SELECT event_id, operation FROM ledger WHERE event_id NOT IN (SELECT event_id FROM ledger WHERE sequence % 3 = 0)""")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir)
    return L.append_history(raw, raw.where("sequence % 3 = 0")).select("event_id", "operation")


@query("src_12_apply_mirror", """WITH w AS (SELECT * FROM winners WHERE k % 5 = 0)
SELECT k, cents, event_id FROM mirror_broken WHERE k % 83 <> 0 AND k % 5 <> 0 UNION ALL SELECT k, cents, event_id FROM w WHERE kind = 'upsert'""")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir)
    won = L.latest_operation(L.operations(led), L.receiver_ranks(led))
    stale = X.broken_mirror(L.replay_full(led)).where("k % 83 <> 0").select("k", "cents", "event_id")
    return L.apply_mirror(stale, won.where("k % 5 = 0"))


@query("src_13_replace_from_snapshot", "SELECT after_key AS k, cents, event_id FROM ledger WHERE receiver = 'SNAPSHOT:S1'")
def _(spark, sf_dir):
    return L.replace_from_snapshot(ledger(spark, sf_dir), "S1").select("k", "cents", "event_id")


@query("src_13_snapshot_complete", "SELECT count(*) AS rows, count(DISTINCT after_key) AS keys, (SELECT count(*) FROM customer) AS rows_copied, true AS complete FROM ledger WHERE receiver = 'SNAPSHOT:S1'")
def _(spark, sf_dir):
    return L.snapshot_complete(L.replace_from_snapshot(ledger(spark, sf_dir), "S1"), X.table(spark, sf_dir, "customer").count())


@query("agg_conflicting_ids", """SELECT event_id, count(*) AS copies FROM raw_events GROUP BY event_id HAVING count(DISTINCT CASE WHEN n % 20 = 0 THEN attempt ELSE 0 END) > 1""")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir).withColumn("cents", F.when(F.col("n") % 20 == 0, F.col("cents") + F.col("attempt")).otherwise(F.col("cents")))
    return L.conflicts(raw, ["operation", "before_key", "after_key", "cents"])
