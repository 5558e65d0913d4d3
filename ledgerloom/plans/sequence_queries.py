"""Queries for window operators, top-k, states and service levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as R
from ..operators import metrics as M
from ..operators import sequences as S
from ..operators import slo as O
from ..sources import fixtures as X
from .compare_queries import FIELDS
from .ledger_queries import ledger, mirror
from .metric_queries import BUCKETS, NOW
from .registry import query


def ranked_catalogue(spark, sf_dir):
    return X.receiver_catalogue(spark, sf_dir).withColumn("receiver_rank", F.col("ordinal"))


GAPS = """SELECT table_name, receiver, start_seq, end_seq, CASE WHEN p_recv = receiver THEN p_end + 1 WHEN p_recv IS NOT NULL THEN first_seq END AS expected,
CASE WHEN p_recv IS NULL THEN NULL WHEN p_recv = receiver AND start_seq = p_start AND end_seq = p_end THEN 'duplicate' WHEN start_seq > CASE WHEN p_recv = receiver THEN p_end + 1 ELSE first_seq END THEN 'gap'
WHEN start_seq < CASE WHEN p_recv = receiver THEN p_end + 1 ELSE first_seq END THEN 'overlap' WHEN p_recv <> receiver AND p_end < p_last THEN 'gap_before_rotation' END AS kind FROM (
SELECT r.*, c.first_seq, lag(end_seq) OVER w AS p_end, lag(r.receiver) OVER w AS p_recv, lag(start_seq) OVER w AS p_start, lag(c.last_seq) OVER w AS p_last FROM receipts_broken r LEFT JOIN receiver_catalogue c ON r.receiver = c.receiver
WINDOW w AS (PARTITION BY table_name ORDER BY ordinal, start_seq, end_seq))"""


@query("win_6_receipt_gaps", GAPS)
def _(spark, sf_dir):
    return S.receipt_gaps(X.receipts_broken(spark, sf_dir), ranked_catalogue(spark, sf_dir).select("receiver", "receiver_rank", "first_seq", "last_seq"))


@query("win_6_receipt_verdict", f"WITH g AS ({GAPS}) SELECT table_name, count(*) AS receipts, count(CASE WHEN kind = 'gap' THEN 1 END) AS gaps, count(CASE WHEN kind = 'duplicate' THEN 1 END) AS duplicates, CASE WHEN count(kind) = 0 THEN 'continuous' ELSE 'broken' END AS verdict FROM g GROUP BY 1")
def _(spark, sf_dir):
    return S.receipt_verdict(S.receipt_gaps(X.receipts_broken(spark, sf_dir), ranked_catalogue(spark, sf_dir).select("receiver", "receiver_rank", "first_seq", "last_seq")))


@query("win_6_receipt_counts", """WITH r AS (SELECT DISTINCT table_name, receiver, start_seq, end_seq, event_count + CASE WHEN start_seq = 1001 THEN 2 ELSE 0 END AS declared FROM receipts), p AS (SELECT r.*, (SELECT count(*) FROM journal_events j WHERE j.receiver = r.receiver AND j.sequence BETWEEN start_seq AND end_seq AND j.n % 97 <> 0) AS present FROM r)
SELECT *, CASE WHEN present < declared THEN 'short' WHEN present > declared THEN 'over' ELSE 'matched' END AS state FROM p""")
def _(spark, sf_dir):
    r = X.receipts(spark, sf_dir).withColumn("event_count", F.col("event_count") + F.when(F.col("start_seq") == 1001, 2).otherwise(0))
    return S.receipt_counts(r, X.journal_events(spark, sf_dir).where("n % 97 <> 0"))


@query("win_7_receiver_chain", "SELECT 'JRN' AS journal, receiver, ordinal, CASE WHEN previous IS NULL THEN 'start' WHEN first_seq = lag(last_seq) OVER (ORDER BY ordinal) + 1 THEN 'continued' WHEN first_seq = 1 THEN 'reset' ELSE 'gap' END AS link FROM catalogue_chain")
def _(spark, sf_dir):
    return S.receiver_chain(X.receiver_catalogue(spark, sf_dir).withColumn("journal", F.lit("JRN")))


@query("win_8_chain_lag", """WITH c AS (SELECT *, coalesce(sum(last_seq - first_seq + 1) OVER (ORDER BY ordinal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM receiver_catalogue)
SELECT event_id AS id, (last_seq - j.sequence + later)::BIGINT AS lag FROM ledger j LEFT JOIN c ON c.receiver = j.receiver""")
def _(spark, sf_dir):
    cat = X.receiver_catalogue(spark, sf_dir).withColumn("journal", F.lit("JRN"))
    return S.chain_lag(ledger(spark, sf_dir).select(F.col("event_id").alias("id"), "receiver", "sequence"), cat)


@query("win_10_image_order", """WITH e AS (SELECT receiver || '-' || (sequence // 100) AS w, sequence, CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN -1 ELSE 0 END AS i FROM journal_events), b AS (SELECT w, i, sum(i) OVER (PARTITION BY w ORDER BY sequence) AS b FROM e)
SELECT w AS "window", min(b)::BIGINT AS least, sum(i)::BIGINT AS final, min(b) >= 0 AND sum(i) = 0 AS ordered FROM b GROUP BY w""")
def _(spark, sf_dir):
    j = X.journal_events(spark, sf_dir)
    op = F.when(F.col("event_type") == "view", "u_before").when(F.col("event_type") == "click", "u_after").otherwise("c")
    return S.image_order(j.select(F.concat("receiver", F.lit("-"), F.floor(F.col("sequence") / 100)).alias("window"), "sequence", op.alias("operation")))


@query("win_11_position_order", """WITH x AS (SELECT before_key AS w, receiver, sequence, lag(sequence) OVER (PARTITION BY before_key ORDER BY ingested_at, n) AS p FROM journal_events WHERE before_key IS NOT NULL)
SELECT w AS "window", count(DISTINCT receiver) AS receivers, count(CASE WHEN sequence <= p THEN 1 END) AS backwards FROM x GROUP BY w""")
def _(spark, sf_dir):
    j = X.journal_events(spark, sf_dir).where("before_key is not null")
    return S.position_order(j.select(F.col("before_key").alias("window"), "receiver", "sequence", F.struct("ingested_at", "n").alias("arrival")))


@query("win_12_delivery_rate", """WITH x AS (SELECT pipeline, at_us, n, at_us - lag(at_us) OVER (PARTITION BY pipeline ORDER BY at_us) AS gap FROM deliveries)
SELECT pipeline, at_us, CASE WHEN gap > 0 THEN floor(n * 1000000000 / gap::DOUBLE)::BIGINT END AS per_1000_s, CASE WHEN gap IS NULL THEN 'first' WHEN gap <= 3600000000 THEN 'active' WHEN gap <= 86400000000 THEN 'slow' ELSE 'idle' END AS activity FROM x""")
def _(spark, sf_dir):
    return S.delivery_rate(X.deliveries(spark, sf_dir))


@query("win_13_cursor_throughput", """WITH x AS (SELECT operation AS pipeline, receiver, epoch_us(commit_ts) AS at_us, sequence, lag(sequence) OVER w AS ps, lag(receiver) OVER w AS pr, lag(epoch_us(commit_ts)) OVER w AS pt FROM journal_events WINDOW w AS (PARTITION BY operation ORDER BY epoch_us(commit_ts), sequence)),
y AS (SELECT *, CASE WHEN pr IS NULL THEN 'first' WHEN pr <> receiver THEN 'rotation' WHEN sequence < ps THEN 'step_back' WHEN at_us <= pt THEN 'no_time' END AS reason FROM x)
SELECT pipeline, at_us, sequence, CASE WHEN reason IS NULL THEN floor((sequence - ps) * 1000000 / (at_us - pt)::DOUBLE)::BIGINT END AS per_s, reason,
last_value(CASE WHEN sequence - ps > 0 THEN at_us END IGNORE NULLS) OVER (PARTITION BY pipeline ORDER BY at_us, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_arrival_us FROM y""")
def _(spark, sf_dir):
    return S.cursor_throughput(X.journal_events(spark, sf_dir).select(F.col("operation").alias("pipeline"), "receiver", X.micros("commit_ts").alias("at_us"), "sequence"))


@query("win_14_counter_delta", """WITH x AS (SELECT run, n, CASE WHEN n % 97 = 0 THEN 0 ELSE errors_total END AS e, at_us FROM capture_polls), y AS (SELECT *, lag(e) OVER (PARTITION BY run ORDER BY at_us, n) AS p FROM x)
SELECT run, n, CASE WHEN p IS NULL THEN e WHEN e >= p THEN e - p END AS delta, e < coalesce(p, 0) AS went_back FROM y""")
def _(spark, sf_dir):
    return S.counter_delta(X.capture_polls(spark, sf_dir).withColumn("errors_total", F.when(F.col("n") % 97 == 0, 0).otherwise(F.col("errors_total"))))


HOURS = BUCKETS.replace("86400", "3600")


@query("win_15_temporal_gaps", f"""WITH b AS ({HOURS}), p AS (SELECT pipeline, start_s, lag(start_s) OVER (PARTITION BY pipeline ORDER BY start_s) + 3600 AS p FROM b)
SELECT pipeline, start_s, start_s + 3600 AS end_s, 'bucket' AS kind FROM p UNION ALL SELECT pipeline, p, start_s, 'gap' FROM p WHERE start_s > p""")
def _(spark, sf_dir):
    return S.temporal_gaps(M.lag_buckets(X.lag_samples(spark, sf_dir), 3600), 3600)


@query("win_15_coverage_verdict", f"""WITH b AS ({HOURS}), p AS (SELECT pipeline, start_s, lag(start_s) OVER (PARTITION BY pipeline ORDER BY start_s) + 3600 AS p FROM b)
SELECT pipeline, count(*) AS buckets, count(CASE WHEN start_s > p THEN 1 END) AS gaps, coalesce(sum(CASE WHEN start_s > p THEN start_s - p END), 0)::BIGINT AS gap_s, CASE WHEN count(CASE WHEN start_s > p THEN 1 END) = 0 THEN 'complete' ELSE 'gap' END AS coverage FROM p GROUP BY pipeline""")
def _(spark, sf_dir):
    return S.coverage_verdict(S.temporal_gaps(M.lag_buckets(X.lag_samples(spark, sf_dir), 3600), 3600))


CHECKS = "SELECT pipeline, hour, m AS \"check\", o::DOUBLE AS observed, t::DOUBLE AS threshold, CASE WHEN o IS NULL OR o < 0 THEN 'unobserved' WHEN o > t THEN 'breach' ELSE 'pass' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT pipeline, hour, '{m}' AS m, {m}::BIGINT AS o, {t} AS t FROM slo_telemetry" for m, t in O.POLICY.items()) + ")"


@query("slo_1_evaluate", f"SELECT pipeline, epoch_us(hour) AS hour_us, \"check\", observed, threshold, status FROM ({CHECKS})")
def _(spark, sf_dir):
    return O.evaluate_slo(X.slo_telemetry(spark, sf_dir), ["pipeline", "hour"]).withColumn("hour_us", X.micros("hour")).drop("hour")


@query("slo_1_report", f"WITH c AS ({CHECKS}) SELECT pipeline, epoch_us(hour) AS hour_us, count(*) AS checks, CASE WHEN count(CASE WHEN status = 'breach' THEN 1 END) > 0 THEN 'breach' WHEN count(CASE WHEN status = 'unobserved' THEN 1 END) > 0 THEN 'unobserved' ELSE 'pass' END AS status FROM c GROUP BY pipeline, hour")
def _(spark, sf_dir):
    t = X.slo_telemetry(spark, sf_dir).withColumn("hour_us", X.micros("hour"))
    return O.report_status(O.evaluate_slo(t, ["pipeline", "hour_us"]), ["pipeline", "hour_us"])


FULL = """WITH t AS (SELECT s.*, CASE n % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'idle' WHEN 2 THEN 'failed' WHEN 3 THEN 'odd' WHEN 4 THEN NULL ELSE 'running' END AS capture_state, CASE WHEN n % 9 = 0 THEN NULL ELSE top % 3 END AS capture_errors,
CASE WHEN top % 4 = 0 THEN 'B' ELSE 'A' END AS receiver, top % 700 AS sequence, CASE WHEN n % 8 = 0 THEN NULL ELSE 'A' END AS source_receiver, top % 2100 AS source_sequence, CASE n % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'running' END AS state,
top % 2 AS deviation, CASE WHEN n % 5 = 0 THEN 23 ELSE 24 END AS metered_hours, top % 1300 - 30 AS report_age_s FROM slo_telemetry s JOIN hourly h ON s.pipeline = h.pipeline AND s.hour = h.hour),
m AS (SELECT pipeline, hour, unnest([{'c': 'capture_freshness', 'g': 'capture', 'o': capture_age_s, 't': 120, 'a': 'age'}, {'c': 'capture_errors', 'g': 'capture', 'o': capture_errors, 't': 0, 'a': 'most'},
{'c': 'raw_freshness', 'g': 'raw', 'o': raw_age_s, 't': 180, 'a': 'age'}, {'c': 'raw_requests', 'g': 'cost', 'o': requests_24h, 't': 500000, 'a': 'most'}, {'c': 'load_queue', 'g': 'load', 'o': pending_files, 't': 10, 'a': 'most'},
{'c': 'ledger_freshness', 'g': 'ledger', 'o': destination_age_s, 't': 300, 'a': 'age'}, {'c': 'delivery_p95', 'g': 'delivery', 'o': p95_s, 't': 60, 'a': 'most'}, {'c': 'delivery_p99', 'g': 'delivery', 'o': p99_s, 't': 180, 'a': 'most'},
{'c': 'observability', 'g': 'observability', 'o': report_age_s, 't': 600, 'a': 'age'}]) AS x FROM t),
r AS (SELECT pipeline, hour, x.c AS c, x.g AS g, x.o AS o, x.t AS t, CASE WHEN x.o IS NULL THEN 'measurement_missing' WHEN x.o < 0 AND x.a = 'age' THEN 'clock_in_future' WHEN x.o < 0 THEN 'negative_measurement' END AS w, x.o > x.t AS over FROM m UNION ALL
SELECT pipeline, hour, 'checkpoint_lag', 'capture', CASE WHEN receiver = source_receiver THEN source_sequence - sequence END, 1000, CASE WHEN source_receiver IS NULL THEN 'measurement_missing' WHEN receiver <> source_receiver THEN 'different_receivers' WHEN source_sequence < sequence THEN 'checkpoint_ahead' END, source_sequence - sequence > 1000 FROM t UNION ALL
SELECT pipeline, hour, 'reconciliation', 'reconciliation', deviation, 0, CASE WHEN state IS NULL THEN 'measurement_missing' WHEN state = 'running' THEN 'not_settled' END, deviation > 0 OR state <> 'matched' FROM t UNION ALL
SELECT pipeline, hour, 'credits', 'cost', credits_cents, 100, CASE WHEN metered_hours <> 24 THEN 'window_missing' WHEN credits_cents IS NULL THEN 'measurement_missing' WHEN credits_cents < 0 THEN 'negative_measurement' END, credits_cents > 100 FROM t)
SELECT pipeline, epoch_us(hour) AS hour_us, c AS "check", g AS stage, o::DOUBLE AS observed, t::DOUBLE AS threshold, CASE WHEN w IS NOT NULL THEN 'unobserved' WHEN over THEN 'breach' ELSE 'pass' END AS status, coalesce(w, CASE WHEN over THEN 'beyond_threshold' END) AS reason FROM r UNION ALL
SELECT pipeline, epoch_us(hour), 'capture_state', 'capture', NULL, NULL, CASE WHEN capture_state IN ('running', 'idle') THEN 'pass' WHEN capture_state = 'failed' THEN 'breach' ELSE 'unobserved' END, CASE WHEN capture_state IS NULL THEN 'measurement_missing' WHEN capture_state = 'odd' THEN 'unknown_state' WHEN capture_state = 'failed' THEN 'failed' END FROM t"""


@query("slo_1_report_in_full", FULL)
def _(spark, sf_dir):
    """All thirteen checks of every report, with reasons."""
    h = X.hourly(spark, sf_dir).select("pipeline", "hour", "n", "top")
    n, top = F.col("n"), F.col("top")
    states = F.element_at(F.array(*[F.lit(s) for s in ("running", "idle", "failed", "odd", None, "running")]), (n % 6 + 1).cast("int"))
    t = X.slo_telemetry(spark, sf_dir).join(h, ["pipeline", "hour"]).select(
        "*", X.micros("hour").alias("hour_us"), states.alias("capture_state"), F.when(n % 9 != 0, top % 3).alias("capture_errors"), F.when(top % 4 == 0, "B").otherwise("A").alias("receiver"), (top % 700).alias("sequence"),
        F.when(n % 8 != 0, "A").alias("source_receiver"), (top % 2100).alias("source_sequence"), F.element_at(F.array(*[F.lit(s) for s in ("matched", "mismatch", "running", None)]), (n % 4 + 1).cast("int")).alias("state"),
        (top % 2).alias("deviation"), F.when(n % 5 == 0, 23).otherwise(24).alias("metered_hours"), (top % 1300 - 30).alias("report_age_s"))
    return O.evaluate_report(t, ["pipeline", "hour_us"])


LIFECYCLE = f"""WITH c AS ({CHECKS}), s AS (SELECT *, lag(status) OVER (PARTITION BY pipeline, "check" ORDER BY hour) AS p FROM c WHERE status <> 'unobserved'),
o AS (SELECT *, sum(CASE WHEN status = 'breach' AND (p IS NULL OR p = 'pass') THEN 1 ELSE 0 END) OVER w AS occurrence, sum(CASE WHEN status = 'breach' THEN 1 ELSE 0 END) OVER w AS evaluations FROM s WINDOW w AS (PARTITION BY pipeline, "check" ORDER BY hour))
SELECT pipeline, "check", epoch_us(hour) AS at_us, CASE WHEN status = 'pass' THEN 'resolved' WHEN occurrence = 1 THEN 'opened' ELSE 'reopened' END AS event, occurrence::BIGINT AS occurrence, evaluations::BIGINT AS evaluations
FROM o WHERE (status = 'breach' AND (p IS NULL OR p = 'pass')) OR (status = 'pass' AND p = 'breach')"""


@query("win_16_alert_lifecycle", LIFECYCLE)
def _(spark, sf_dir):
    c = O.evaluate_slo(X.slo_telemetry(spark, sf_dir), ["pipeline", "hour"]).withColumnRenamed("hour", "at")
    return S.alert_lifecycle(c).withColumn("at_us", X.micros("at")).drop("at")


@query("win_16_alert_changes", f"""WITH c AS ({CHECKS}), s AS (SELECT *, lag(status) OVER w AS p, lag(observed) OVER w AS before FROM c WHERE status <> 'unobserved' WINDOW w AS (PARTITION BY pipeline, "check" ORDER BY hour))
SELECT pipeline, "check", epoch_us(hour) AS at_us, 'changed' AS event, before, observed FROM s WHERE status = 'breach' AND p = 'breach' AND observed IS DISTINCT FROM before""")
def _(spark, sf_dir):
    c = O.evaluate_slo(X.slo_telemetry(spark, sf_dir), ["pipeline", "hour"]).withColumnRenamed("hour", "at")
    return S.alert_changes(c).withColumn("at_us", X.micros("at")).drop("at")


@query("win_17_choose_key", """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '*BEFORE' WHEN c_custkey % 7 = 0 THEN '*AFTER' ELSE '*BOTH' END AS images FROM customer)
SELECT 'T' || c_custkey AS table_name, CASE WHEN images = '*BEFORE' THEN 'blocked' WHEN images = '*AFTER' OR c_custkey % 5 = 0 THEN 'rrn' WHEN c_custkey % 3 = 0 THEN 'primary' WHEN c_custkey % 2 = 0 THEN 'unique' ELSE 'index' END AS identity,
CASE WHEN images = '*BOTH' AND c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'pk' WHEN c_custkey % 2 = 0 THEN 'uq_a' ELSE 'ix_a' END END AS name FROM t""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    images = F.when(k % 11 == 0, "*BEFORE").when(k % 7 == 0, "*AFTER").otherwise("*BOTH")
    s = lambda kind, width, name: F.struct(F.lit(kind).alias("kind"), F.lit(width).alias("width"), F.lit(name).alias("name"))
    cand = F.when(k % 5 == 0, F.array(s("none", 0, ""))).when(k % 3 == 0, F.array(s("index", 1, "ix_a"), s("primary", 2, "pk"))).when(k % 2 == 0, F.array(s("unique", 2, "uq_b"), s("unique", 1, "uq_a"))).otherwise(F.array(s("index", 1, "ix_b"), s("index", 1, "ix_a")))
    return S.choose_key(X.table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), k).alias("table_name"), images.alias("images"), F.explode(cand).alias("c")).select("table_name", "images", "c.*"))


@query("top_1_mismatch_sample", """WITH d AS (SELECT s.o_orderkey, s.cents AS expected, d.cents AS actual FROM orders_source s JOIN orders_dest d ON s.o_orderkey = d.o_orderkey WHERE s.cents IS DISTINCT FROM d.cents)
SELECT o_orderkey, expected::VARCHAR AS expected, actual::VARCHAR AS actual, (SELECT count(*) FROM d) AS total FROM d ORDER BY o_orderkey LIMIT 12""")
def _(spark, sf_dir):
    d = R.keyed_diff(X.orders_source(spark, sf_dir), X.orders_dest(spark, sf_dir), ["o_orderkey"], FIELDS).where("field = 'cents'")
    return S.mismatch_sample(d.select("o_orderkey", "expected", "actual"), ["o_orderkey"], 12)


@query("top_2_latest_per", "SELECT pipeline, max(at_us) AS at_us, max_by(n, at_us) AS n FROM deliveries GROUP BY pipeline")
def _(spark, sf_dir):
    return S.latest_per(X.deliveries(spark, sf_dir), "pipeline", ["at_us"], ["n"])


@query("top_3_ordered_export", "SELECT k, cents, event_id, (SELECT count(*) > 1000 FROM mirror) AS exceeded FROM mirror")
def _(spark, sf_dir):
    """The whole mirror in key order, and whether it has more than a thousand rows."""
    return S.ordered_export(mirror(spark, sf_dir).select("k", "cents", "event_id"), "k", 1000)


@query("top_3_history_export", "SELECT event_id, epoch_us(ingested_at) AS ingested_us, cents, (SELECT count(*) > 1000 FROM ledger) AS exceeded FROM ledger")
def _(spark, sf_dir):
    return S.history_export(ledger(spark, sf_dir), 1000).select("event_id", X.micros("ingested_at").alias("ingested_us"), "cents", "exceeded")


@query("prj_16_coalesce_measures", """WITH a AS (SELECT DISTINCT pipeline FROM hourly WHERE pipeline <> 'view'), b AS (SELECT pipeline, sum(n)::BIGINT AS rows FROM hourly WHERE pipeline <> 'click' GROUP BY 1)
SELECT coalesce(a.pipeline, b.pipeline) AS pipeline, CASE WHEN a.pipeline = 'error' THEN -1 ELSE b.rows END AS rows, CASE WHEN a.pipeline IS NOT NULL THEN 'first' ELSE 'second' END AS why FROM a FULL JOIN b ON a.pipeline = b.pipeline""")
def _(spark, sf_dir):
    h = X.hourly(spark, sf_dir).groupBy("pipeline").agg(F.sum("n").alias("n"))
    a = h.where("pipeline <> 'view'").select("pipeline", F.when(F.col("pipeline") == "error", F.lit(-1).cast("long")).alias("rows"), F.create_map(F.lit("why"), F.lit("first")).alias("reasons"))
    b = h.where("pipeline <> 'click'").select("pipeline", F.col("n").alias("rows"), F.create_map(F.lit("why"), F.lit("second")).alias("reasons"))
    return S.coalesce_measures(a, b, "pipeline", ["rows"], "reasons").select("pipeline", "rows", F.col("reasons")["why"].alias("why"))


@query("prj_17_anchor_series", f"WITH b AS ({BUCKETS}) SELECT pipeline, start_s, {NOW} - (max(start_s + 86400) OVER (PARTITION BY pipeline) - (start_s + 86400)) * 1000000 AS end_us FROM b")
def _(spark, sf_dir):
    return S.anchor_series(M.lag_buckets(X.lag_samples(spark, sf_dir), 86400).withColumn("end_s", F.col("start_s") + 86400), NOW)


CATALOGUE = """WITH t AS (SELECT p_partkey AS k, 'T' || p_partkey AS table_name FROM part)
SELECT table_name, k % 5 AS selection, k * 10 AS rows, CASE WHEN k % 6 <> 0 THEN 'JRN' || (k % 5 % 2 * (k % 2)) END AS journal, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 7 = 0 THEN '*AFTER' ELSE '*BOTH' END AS images, CASE WHEN k % 4 <> 0 THEN 'B,A' END AS key_columns FROM t"""


def catalogue(spark, sf_dir):
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("T"), F.col("p_partkey")).alias("table_name"))
    k = F.col("k")
    journaled = p.where("k % 6 <> 0").select("table_name", F.concat(F.lit("JRN"), k % 5 % 2 * (k % 2)).alias("journal"), F.when(k % 7 == 0, "*AFTER").otherwise("*BOTH").alias("images"))
    keys = p.where("k % 4 <> 0").select("table_name", F.explode(F.array(F.struct(F.lit(2).alias("place"), F.lit("A").alias("column")), F.struct(F.lit(1).alias("place"), F.lit("B").alias("column")))).alias("x")).select("table_name", "x.*")
    return S.catalogue_join(p.select("table_name", (k % 5).alias("selection")), p.select("table_name", (k * 10).alias("rows")), journaled, keys)


@query("jon_11_catalogue", CATALOGUE)
def _(spark, sf_dir):
    return catalogue(spark, sf_dir)


@query("rec_14_table_readiness", f"""WITH c AS ({CATALOGUE}) SELECT selection, table_name, CASE WHEN journal IS NULL THEN 'not_journaled' WHEN images <> '*BOTH' THEN 'images_incomplete' WHEN key_columns IS NULL THEN 'no_key' ELSE 'ready' END AS state,
(SELECT count(DISTINCT d.journal) > 1 FROM c d WHERE d.selection = c.selection) AS several_journals FROM c""")
def _(spark, sf_dir):
    return S.table_readiness(catalogue(spark, sf_dir))


@query("slo_2_reconciliation", """WITH x AS (SELECT receiver, count(*) AS raw_rows, count(DISTINCT event_id) AS ledger_rows, CASE WHEN receiver = 'JRN5' THEN NULL ELSE count(*) END AS mirror_rows FROM raw_events WHERE attempt = 0 OR receiver = 'JRN9' GROUP BY 1),
d AS (SELECT receiver, CASE WHEN mirror_rows IS NULL THEN NULL ELSE greatest(abs(raw_rows - ledger_rows), abs(raw_rows - mirror_rows)) END AS deviation FROM x)
SELECT receiver, deviation, CASE WHEN deviation IS NULL THEN 'unobserved' WHEN deviation = 0 THEN 'pass' ELSE 'breach' END AS status FROM d""")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir).where("attempt = 0 or receiver = 'JRN9'")
    x = raw.groupBy("receiver").agg(F.count("*").alias("raw_rows"), F.count_distinct("event_id").alias("ledger_rows")).withColumns({"mirror_rows": F.when(F.col("receiver") != "JRN5", F.col("raw_rows")), "state": F.lit("matched")})
    return O.reconciliation_check(x, [("raw_rows", "ledger_rows"), ("raw_rows", "mirror_rows")]).select("receiver", "deviation", "status")


@query("slo_3_capture_and_checkpoint", """WITH j AS (SELECT event_id, sequence, receiver, CASE n % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'idle' END AS s FROM journal_events)
SELECT event_id, CASE WHEN s IN ('running', 'idle') THEN 'pass' WHEN s = 'failed' THEN 'breach' ELSE 'unobserved' END AS capture, CASE WHEN receiver = 'JRN2' THEN 2000 - sequence END AS lag,
CASE WHEN receiver <> 'JRN2' OR 2000 - sequence < 0 THEN 'unobserved' WHEN 2000 - sequence > 1000 THEN 'breach' ELSE 'pass' END AS checkpoint FROM j""")
def _(spark, sf_dir):
    n = F.col("n") % 4
    lag, status = O.checkpoint_lag_check(F.col("receiver"), F.col("sequence"), F.lit("JRN2"), F.lit(2000), 1000)
    return X.journal_events(spark, sf_dir).select("event_id", O.capture_state_check(F.when(n == 0, "running").when(n == 1, "failed").when(n == 2, "idle")).alias("capture"), lag.alias("lag"), status.alias("checkpoint"))


@query("slo_4_freshness", """SELECT pipeline, epoch_us(hour) AS hour_us, CASE WHEN capture_age_s IS NULL THEN 'unknown' WHEN capture_age_s * 5 - 200 < -60 THEN 'clock_untrusted' WHEN capture_age_s * 5 - 200 <= 300 THEN 'fresh' ELSE 'stale' END AS freshness FROM slo_telemetry""")
def _(spark, sf_dir):
    return X.slo_telemetry(spark, sf_dir).select("pipeline", X.micros("hour").alias("hour_us"), O.freshness(F.col("capture_age_s") * 5 - 200).alias("freshness"))


@query("slo_5_pipeline_status", """WITH s AS (SELECT user_id AS pipeline, CASE WHEN event_id % 901 = 0 THEN 'incident' WHEN event_id % 701 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 'degraded' WHEN event_id % 51 = 0 THEN 'planned_stop' ELSE 'healthy' END AS state FROM events)
SELECT pipeline, CASE WHEN bool_or(coalesce(state = 'incident', false)) THEN 'incident' WHEN bool_or(state IS NULL) THEN 'unknown' WHEN bool_or(state = 'degraded') THEN 'degraded' WHEN bool_or(state = 'planned_stop') THEN 'planned_stop' ELSE 'healthy' END AS status FROM s GROUP BY 1""")
def _(spark, sf_dir):
    i = F.col("event_id")
    state = F.when(i % 901 == 0, "incident").when(i % 701 == 0, None).when(i % 101 == 0, "degraded").when(i % 51 == 0, "planned_stop").otherwise("healthy")
    return O.pipeline_status(X.table(spark, sf_dir, "events").select(F.col("user_id").alias("pipeline"), state.alias("state")))


@query("slo_6_checkpoint_relation", """SELECT n, CASE WHEN n % 13 = 0 OR receiver <> 'JRN9' THEN 'unknown' WHEN sequence = 1500 THEN 'equal' WHEN sequence < 1500 THEN 'behind' ELSE 'ahead' END AS relation FROM journal_events""")
def _(spark, sf_dir):
    down = F.when(F.col("n") % 13 != 0, F.col("sequence"))
    return X.journal_events(spark, sf_dir).select("n", O.checkpoint_relation(F.col("receiver"), down, F.lit("JRN9"), F.lit(1500)).alias("relation"))


@query("slo_7_coverage_complete", """SELECT receiver, start_seq, coalesce(CASE WHEN start_seq % 1000 = 1 THEN end_seq END = end_seq AND start_seq <> 1, false) AS complete FROM receipts""")
def _(spark, sf_dir):
    r = X.receipts(spark, sf_dir)
    load = F.when(F.col("start_seq") % 1000 == 1, F.col("end_seq"))
    return r.select("receiver", "start_seq", O.coverage_complete(F.col("end_seq"), load, F.col("end_seq"), F.col("end_seq"), F.col("start_seq") != 1).alias("complete"))


MEASURES = """SELECT user_id AS id, CASE WHEN count(*) % 11 <> 0 THEN count(*) END AS source_rows, count(*) - max(event_id) % 3 % 2 AS raw_rows, count(*) - max(event_id) % 3 % 2 + CASE WHEN min(event_id) % 17 = 0 THEN 1 ELSE 0 END AS ledger_rows,
count(*) AS mirror_rows, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 2 AS missing, min(event_id) % 13 // 12 AS extra, max(event_id) % 7 // 6 AS duplicates, max(event_id) % 3 % 2 AS pending FROM events GROUP BY user_id"""


@query("rec_6_destination_status", f"""SELECT id, CASE WHEN source_rows IS NULL THEN 'unknown' WHEN missing > 0 AND pending = 0 OR extra > 0 OR duplicates > 0 OR ledger_rows > raw_rows THEN 'mismatch'
WHEN source_rows = raw_rows AND raw_rows = ledger_rows AND missing = 0 AND pending = 0 THEN 'matched' ELSE 'running' END AS state FROM ({MEASURES})""")
def _(spark, sf_dir):
    """Counters that follow from the events; the rule is what the SQL says again."""
    n, top, low = F.count("*"), F.max("event_id"), F.min("event_id")
    late = top % 3 % 2
    m = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.when(n % 11 != 0, n).alias("source_rows"), (n - late).alias("raw_rows"), (n - late + F.when(low % 17 == 0, 1).otherwise(0)).alias("ledger_rows"), n.alias("mirror_rows"),
        (F.count_if(F.col("event_type") == "error") % 2).alias("missing"), F.floor(low % 13 / 12).alias("extra"), F.floor(top % 7 / 6).alias("duplicates"), late.alias("pending"))
    return O.destination_status(m).select("id", "state")


@query("rec_6_destination_progress", f"""WITH m AS ({MEASURES}), p AS (SELECT user_id AS id, CASE WHEN count(*) % 5 <> 0 THEN max(event_id) END AS source_position, max(CASE WHEN event_type <> 'error' THEN event_id END) AS loaded_position, max(CASE WHEN event_type = 'view' THEN event_id END) AS applied_position FROM events GROUP BY 1)
SELECT m.id, CASE WHEN pending > 0 THEN 'running' WHEN source_rows IS NULL THEN 'unknown' WHEN raw_rows > source_rows THEN 'ahead' WHEN raw_rows < source_rows THEN 'running' ELSE 'complete' END AS load_state, CASE WHEN ledger_rows > raw_rows THEN 'ahead' WHEN ledger_rows < raw_rows THEN 'running' ELSE 'complete' END AS apply_state,
CASE WHEN source_position IS NOT NULL AND loaded_position IS NOT NULL AND applied_position IS NOT NULL THEN least(source_position, loaded_position, applied_position) END AS covered FROM m JOIN p ON m.id = p.id""")
def _(spark, sf_dir):
    n, top, low, e = F.count("*"), F.max("event_id"), F.min("event_id"), F.col("event_id")
    late = top % 3 % 2
    m = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.when(n % 11 != 0, n).alias("source_rows"), (n - late).alias("raw_rows"), (n - late + F.when(low % 17 == 0, 1).otherwise(0)).alias("ledger_rows"), late.alias("pending"), F.when(n % 5 != 0, top).alias("source_position"),
        F.max(F.when(F.col("event_type") != "error", e)).alias("loaded_position"), F.max(F.when(F.col("event_type") == "view", e)).alias("applied_position"))
    return O.destination_progress(m)


@query("rec_8_certification_verdict", """WITH c AS (SELECT user_id AS id, CASE WHEN count(*) % 9 <> 0 THEN count(*) END AS raw_rows, count(*) + CASE WHEN max(event_id) % 8 = 0 THEN 1 ELSE 0 END AS ledger_rows, sum(event_id) AS raw_hash, sum(event_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS ledger_hash,
max(event_id) % 6 // 5 AS missing, min(event_id) % 5 // 4 AS extra, min(event_id) % 7 // 6 AS duplicates, CASE WHEN max(event_id) % 10 <> 0 THEN max(event_id) % 400 END AS freshness_s, CASE WHEN min(event_id) % 3 = 0 THEN NULL ELSE min(event_id) % 3 = 1 END AS cost_matches FROM events GROUP BY user_id),
w AS (SELECT id, CASE WHEN raw_rows IS NULL THEN 'unmeasured' WHEN raw_rows <> ledger_rows THEN 'counts_differ' WHEN raw_hash <> ledger_hash THEN 'hashes_differ' WHEN missing > 0 THEN 'missing' WHEN extra > 0 THEN 'extra' WHEN duplicates > 0 THEN 'duplicates'
WHEN freshness_s IS NULL THEN 'freshness_unknown' WHEN freshness_s > 300 THEN 'stale' WHEN cost_matches IS DISTINCT FROM true THEN 'cost_differs' END AS reason FROM c) SELECT id, reason, CASE WHEN reason IS NULL THEN 'certified' ELSE 'refused' END AS verdict FROM w""")
def _(spark, sf_dir):
    n, top, low, e = F.count("*"), F.max("event_id"), F.min("event_id"), F.col("event_id")
    c = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.when(n % 9 != 0, n).alias("raw_rows"), (n + F.when(top % 8 == 0, 1).otherwise(0)).alias("ledger_rows"), F.sum(e).alias("raw_hash"), F.sum(e + F.when(e % 97 == 0, 1).otherwise(0)).alias("ledger_hash"),
        F.floor(top % 6 / 5).alias("missing"), F.floor(low % 5 / 4).alias("extra"), F.floor(low % 7 / 6).alias("duplicates"), F.when(top % 10 != 0, top % 400).alias("freshness_s"), F.when(low % 3 != 0, low % 3 == 1).alias("cost_matches"))
    return O.certification_verdict(c, 300).select("id", "reason", "verdict")


@query("rec_10_archived_window", """WITH b AS (SELECT user_id AS run, event_id // 500 AS batch_id, count(*) AS event_count, count(DISTINCT CASE WHEN event_id % 83 = 0 THEN -1 ELSE event_id END) AS ids, CASE WHEN max(event_id) % 211 = 0 THEN 'other' ELSE 's' END AS scope FROM events GROUP BY 1, 2),
r AS (SELECT user_id AS run, CASE WHEN count(*) % 7 = 0 THEN 'signal' ELSE 'budget' END AS stopped_by, count(CASE WHEN event_type = 'error' THEN 1 END) // 20 AS errors, count(DISTINCT event_id // 500) + CASE WHEN max(event_id) % 9 = 0 THEN 1 ELSE 0 END AS batches, count(*) + CASE WHEN min(event_id) % 9 = 0 THEN 1 ELSE 0 END AS events FROM events GROUP BY 1),
l AS (SELECT run, count(*) AS n_batches, sum(event_count) AS n_events, sum(ids) AS n_ids, count(DISTINCT scope) AS scopes FROM b GROUP BY 1),
w AS (SELECT r.run, CASE WHEN stopped_by <> 'budget' THEN 'not_stopped_by_budget' WHEN errors > 0 THEN 'errors' WHEN batches <> n_batches THEN 'batch_count' WHEN events <> n_events THEN 'event_count' WHEN n_ids <> n_events THEN 'repeated_id' WHEN scopes <> 1 THEN 'several_scopes' END AS reason FROM r JOIN l ON r.run = l.run)
SELECT run, reason, reason IS NULL AS valid FROM w""")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "event_type", F.floor(F.col("event_id") / 500).alias("batch_id"))
    b = e.groupBy("run", "batch_id").agg(F.count("*").alias("event_count"), F.count_distinct(F.when(F.col("event_id") % 83 == 0, -1).otherwise(F.col("event_id"))).alias("distinct_ids"),
                                         F.when(F.max("event_id") % 211 == 0, "other").otherwise("s").alias("scope"))
    run = e.groupBy("run").agg(F.when(F.count("*") % 7 == 0, "signal").otherwise("budget").alias("stopped_by"), F.floor(F.count_if(F.col("event_type") == "error") / 20).alias("errors"),
                               (F.count_distinct("batch_id") + F.when(F.max("event_id") % 9 == 0, 1).otherwise(0)).alias("batches"), (F.count("*") + F.when(F.min("event_id") % 9 == 0, 1).otherwise(0)).alias("events"))
    return O.archived_window(run, b)
