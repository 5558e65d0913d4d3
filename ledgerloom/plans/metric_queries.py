"""Queries for aggregates over ledgers and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import fixtures as X
from .ledger_queries import ledger, mirror
from .registry import query


@query("agg_1_raw_coverage", "SELECT receiver, count(*) AS rows, count(DISTINCT event_id) AS events, max(sequence) AS last_sequence, receiver LIKE 'SNAPSHOT:%' AS snapshot FROM raw_events GROUP BY receiver")
def _(spark, sf_dir):
    return M.raw_coverage(X.raw_events(spark, sf_dir))


@query("agg_2_ledger_coverage", "SELECT receiver, count(*) AS rows, max(sequence) AS last_sequence FROM ledger GROUP BY receiver")
def _(spark, sf_dir):
    return M.ledger_coverage(ledger(spark, sf_dir))


@query("agg_3_file_rows", "SELECT source_file, count(*) AS rows FROM raw_events GROUP BY source_file")
def _(spark, sf_dir):
    return X.raw_events(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("rows"))


@query("agg_4_set_fingerprint", """SELECT count(*) AS rows, sum(('0x' || substr(sha256(event_id), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS sum_high, sum(('0x' || substr(sha256(event_id), 16, 15))::BIGINT::HUGEINT)::VARCHAR AS sum_low FROM raw_events""")
def _(spark, sf_dir):
    return M.set_fingerprint(X.raw_events(spark, sf_dir), "event_id")


@query("agg_5_identity_digest", """SELECT receiver, sequence // 500 AS slot, count(*) AS values, CASE WHEN count(*) = count(DISTINCT event_id) THEN sha256(string_agg(event_id, chr(10) ORDER BY event_id)) END AS digest, count(*) <> count(DISTINCT event_id) AS refused
FROM raw_events WHERE attempt = 0 OR receiver = 'JRN9' GROUP BY 1, 2""")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir).where("attempt = 0 or receiver = 'JRN9'").withColumn("slot", F.floor(F.col("sequence") / 500))
    return M.identity_digest(raw, ["receiver", "slot"], "event_id")


@query("agg_5_tree_digest", """WITH n AS (SELECT greatest(1, (count(DISTINCT event_id) + 1999) // 2000) AS buckets FROM ledger),
b AS (SELECT ('0x' || substr(sha256(event_id), 1, 8))::BIGINT % buckets AS b, count(*) AS n, sha256(string_agg(event_id, chr(10) ORDER BY event_id)) AS d FROM ledger, n GROUP BY 1)
SELECT sum(n)::BIGINT AS values, false AS refused, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b""")
def _(spark, sf_dir):
    return M.tree_digest(ledger(spark, sf_dir), "event_id")


@query("agg_6_operation_mix", "SELECT receiver, operation, count(*) AS n FROM ledger GROUP BY 1, 2")
def _(spark, sf_dir):
    return M.operation_mix(ledger(spark, sf_dir), ["receiver"])


LATENCY = """WITH l AS (SELECT epoch_us(ingested_at) - epoch_us(commit_ts) AS us FROM ledger WHERE receiver NOT LIKE 'SNAPSHOT:%')
SELECT round(quantile_cont(us, 0.95) / 1000000, 3) AS p95_s, round(quantile_cont(us, 0.99) / 1000000, 3) AS p99_s, min(us) / 1000000.0::DOUBLE AS least_s, count(*) AS rows, 0 AS nulls, NULL AS reason FROM l"""


@query("agg_7_delivery_latency", LATENCY)
def _(spark, sf_dir):
    """Exact percentiles, so that SQL can say the same."""
    got = M.delivery_latency(ledger(spark, sf_dir).where("receiver not like 'SNAPSHOT:%'"), exact=True)
    return got.withColumns({"p95_s": F.round("p95_s", 3), "p99_s": F.round("p99_s", 3)})


@query("agg_7_delivery_latency_approx", """SELECT min(epoch_us(ingested_at) - epoch_us(commit_ts)) / 1000000.0::DOUBLE AS least_s, count(*) AS rows, true AS p95_ranks_right, true AS p99_ranks_right
FROM ledger WHERE receiver NOT LIKE 'SNAPSHOT:%'""")
def _(spark, sf_dir):
    """The approximate percentiles are held to their rank: at most a thousandth of all rows off."""
    led = ledger(spark, sf_dir).where("receiver not like 'SNAPSHOT:%'")
    lag = (X.micros("ingested_at") - X.micros("commit_ts")) / 1000000
    got = M.delivery_latency(led)
    share = led.select(lag.alias("lag")).crossJoin(got.select("p95_s", "p99_s"))  # one row
    off = lambda p, q: (F.avg((F.col("lag") < F.col(q)).cast("double")) <= p + 0.001) & (F.avg((F.col("lag") <= F.col(q)).cast("double")) >= p - 0.001)
    return share.agg(off(0.95, "p95_s").alias("p95_ranks_right"), off(0.99, "p99_s").alias("p99_ranks_right")).crossJoin(got.select("least_s", "rows"))


NOW = 1706745600000000  # 2024-02-01


@query("agg_8_lag_now", f"SELECT ({NOW} - (SELECT max(epoch_us(commit_ts)) FROM ledger)) // 1000 AS history_lag_ms, ({NOW} - (SELECT max(epoch_us(commit_ts)) FROM mirror)) // 1000 AS mirror_lag_ms")
def _(spark, sf_dir):
    return M.lag_now(ledger(spark, sf_dir), mirror(spark, sf_dir), NOW)


@query("agg_9_certify", """WITH r AS (SELECT * FROM raw_events WHERE ingested_at <= TIMESTAMP '2024-01-20 00:00:00'), l AS (SELECT * FROM ledger WHERE n % 100 <> 3)
SELECT (SELECT count(*) FROM r) AS raw_rows, (SELECT count(DISTINCT event_id) FROM r) AS distinct_ids, (SELECT count(*) - count(DISTINCT event_id) FROM r) AS duplicates,
(SELECT count(DISTINCT event_id) FROM r WHERE event_id NOT IN (SELECT event_id FROM l)) AS missing, (SELECT count(*) FROM l WHERE event_id NOT IN (SELECT event_id FROM r)) AS extra, NULL::INT AS freshness_s,
(SELECT greatest(max(epoch_us(ingested_at)) - max(epoch_us(commit_ts)), 0) // 1000000 FROM r) AS latency_s, (SELECT count(*) FROM r WHERE ingested_at > TIMESTAMP '2024-01-19 23:00:00') AS trailing""")
def _(spark, sf_dir):
    return M.certify(X.raw_events(spark, sf_dir), ledger(spark, sf_dir).where("not (n % 100 <=> 3)"), "2024-01-20 00:00:00")


@query("agg_9_certify_pending", """WITH r AS (SELECT DISTINCT event_id, n FROM raw_events WHERE ingested_at <= TIMESTAMP '2024-01-20 00:00:00'), l AS (SELECT DISTINCT event_id, n FROM ledger WHERE ingested_at <= TIMESTAMP '2024-01-20 00:00:00' AND n % 10 <> 3),
h AS (SELECT r.event_id AS id, l.event_id IS NOT NULL AS held, r.n % 20 = 3 AS p, ('0x' || substr(sha256(r.event_id), 1, 15))::BIGINT::HUGEINT AS h FROM r LEFT JOIN l ON l.event_id = r.event_id)
SELECT count(CASE WHEN NOT held AND p THEN 1 END) AS pending, count(CASE WHEN NOT held AND NOT p THEN 1 END) AS missing, (SELECT count(*) FROM l WHERE event_id NOT IN (SELECT event_id FROM r)) AS extra, sum(CASE WHEN held OR NOT p THEN h ELSE 0 END)::VARCHAR AS source_sum,
sum(CASE WHEN held THEN h ELSE 0 END)::VARCHAR AS target_sum, sum(CASE WHEN held OR NOT p THEN h ELSE 0 END) = sum(CASE WHEN held THEN h ELSE 0 END) AS equal FROM h""")
def _(spark, sf_dir):
    end = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    raw = X.raw_events(spark, sf_dir)
    led = ledger(spark, sf_dir).where((F.col("ingested_at") <= end) & (F.col("n") % 10 != 3))
    return M.certify_pending(raw, led, raw.where("n % 20 = 3").select("event_id"), "2024-01-20 00:00:00")


METERED = """SELECT pipeline, CASE WHEN count(*) = 24 AND count(credits) = 24 THEN sum(credits)::BIGINT END AS credits, count(*) AS rows, count(credits) AS known FROM metering
WHERE hour >= TIMESTAMP '2024-01-14 09:00:00' AND hour < TIMESTAMP '2024-01-15 09:00:00' GROUP BY pipeline"""


@query("agg_10_metered_credits", METERED)
def _(spark, sf_dir):
    return M.metered_credits(X.metering(spark, sf_dir), "2024-01-15 15:20:00")


@query("agg_11_cost", f"""WITH c AS ({METERED.replace('= 24 AND count(credits) = 24', '> 0')}), p AS (SELECT * FROM (VALUES ('view', 3, true), ('click', 2, false), ('error', 5, true)) AS t(pipeline, price, declared))
SELECT c.pipeline, credits * price AS amount, CASE WHEN credits IS NULL OR price IS NULL THEN 'absent' WHEN declared THEN 'measured' ELSE 'estimated' END AS status FROM c LEFT JOIN p ON c.pipeline = p.pipeline""")
def _(spark, sf_dir):
    day = X.metering(spark, sf_dir).where("hour >= timestamp_ntz'2024-01-14 09:00:00' and hour < timestamp_ntz'2024-01-15 09:00:00'")
    prices = spark.createDataFrame([("view", 3, True), ("click", 2, False), ("error", 5, True)], "pipeline string, price long, declared boolean")
    return M.cost(M.known_sum(day, ["pipeline"], "credits").withColumnRenamed("total", "credits"), prices)


@query("agg_12_storage_run_rate", f"""WITH l AS (SELECT pipeline, max_by(cents, last_us) AS bytes FROM hourly WHERE last_us >= {NOW} - 259200000000 GROUP BY 1)
SELECT pipeline, CASE WHEN pipeline IN ('view', 'click') THEN bytes * 2 END AS run_rate, CASE WHEN pipeline = 'error' THEN 'price_not_unique' WHEN pipeline NOT IN ('view', 'click') THEN 'no_price' END AS reason FROM l""")
def _(spark, sf_dir):
    points = X.hourly(spark, sf_dir).select("pipeline", F.col("pipeline").alias("region"), F.col("last_us").alias("at_us"), F.col("cents").alias("bytes"))
    prices = spark.createDataFrame([("view", 1, 2), ("view", 2, 1), ("click", 1, 2), ("error", 1, 2), ("error", 1, 3)], "region string, tier int, price long")
    return M.storage_run_rate(points, prices, NOW)


@query("agg_13_cluster_allocation", """WITH a AS (SELECT day(hour) AS day, CASE pipeline WHEN 'signup' THEN '__idle__' ELSE pipeline END AS name, sum(cents)::BIGINT AS cost FROM hourly GROUP BY 1, 2), b AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE day % 7 = 0)
SELECT day, CASE WHEN count(CASE WHEN name = 'view' THEN 1 END) = 1 THEN sum(CASE WHEN name = 'view' THEN cost END)::BIGINT END AS namespace_cost, CASE WHEN count(CASE WHEN name = 'view' THEN 1 END) = 1 THEN sum(cost)::BIGINT END AS cluster_cost,
CASE WHEN count(CASE WHEN name = 'view' THEN 1 END) = 1 THEN sum(CASE WHEN name = '__idle__' THEN cost END)::BIGINT END AS idle_cost FROM b GROUP BY day""")
def _(spark, sf_dir):
    a = X.hourly(spark, sf_dir).groupBy(F.dayofmonth("hour").alias("day"), F.when(F.col("pipeline") == "signup", "__idle__").otherwise(F.col("pipeline")).alias("name")).agg(F.sum("cents").alias("cost"))
    return M.cluster_allocation(a.union(a.where("day % 7 = 0")), "view")


@query("agg_14_compare_runs", """SELECT solution, count(*) AS samples, sum(bytes)::BIGINT AS bytes, sum(elapsed_ms)::BIGINT AS elapsed_ms, round(quantile_cont(elapsed_ms, 0.5), 3) AS p50, round(quantile_cont(elapsed_ms, 0.95), 3) AS p95, round(quantile_cont(elapsed_ms, 0.99), 3) AS p99,
max(lag) AS most_lag, (count(*) * 1000 // sum(elapsed_ms))::BIGINT AS samples_per_s, (sum(bytes) * 1000 // sum(elapsed_ms))::BIGINT AS bytes_per_s, (sum(cost_cents) * 1000000 // count(*))::BIGINT AS cents_per_million, count(DISTINCT scope) = 1 AND count(DISTINCT fingerprint) = 1 AS comparable FROM benchmark_samples GROUP BY solution""")
def _(spark, sf_dir):
    runs = M.compare_runs(X.benchmark_samples(spark, sf_dir))
    return runs.withColumns({c: F.round(c, 3) for c in ("p50", "p95", "p99")})


@query("agg_15_latency_summary", """WITH r AS (SELECT run, poll_ms, row_number() OVER (PARTITION BY run ORDER BY poll_ms) - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM capture_polls)
SELECT run, count(*) AS n, max(CASE WHEN i = round_even(0.5 * (n - 1), 0) THEN poll_ms END) AS p50, max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN poll_ms END) AS p95, max(poll_ms) AS most, round(avg(poll_ms), 6) AS mean FROM r GROUP BY run""")
def _(spark, sf_dir):
    return M.latency_summary(X.capture_polls(spark, sf_dir), ["run"], "poll_ms")


@query("agg_16_position_fingerprint", """SELECT receiver, sequence // 500 AS slot, count(*) AS values, sha256(string_agg(t, chr(10) ORDER BY t)) AS digest, false AS refused FROM (SELECT *, receiver || '|' || lpad(sequence::VARCHAR, 20, '0') || '|' || event_id || '|' || upper(operation) AS t FROM ledger) GROUP BY 1, 2""")
def _(spark, sf_dir):
    return M.position_fingerprint(ledger(spark, sf_dir).withColumn("slot", F.floor(F.col("sequence") / 500)), ["receiver", "slot"])


@query("agg_19_lag_trend", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY elapsed_s, n) AS i, count(*) OVER (PARTITION BY pipeline) AS c FROM lag_samples WHERE lag IS NOT NULL),
a AS (SELECT pipeline, count(*) AS samples, regr_slope(lag, elapsed_s) AS slope, min(CASE WHEN i <= greatest(c // 3, 1) THEN lag END) AS first_floor, min(CASE WHEN i > c - greatest(c // 3, 1) THEN lag END) AS last_floor FROM r GROUP BY 1)
SELECT pipeline, samples, first_floor, last_floor, sign(slope)::INT AS direction, CASE WHEN samples < 6 THEN 'INCONCLUSIVE' WHEN slope > 0 AND last_floor > first_floor THEN 'DIVERGING' WHEN slope < 0 AND last_floor < first_floor THEN 'CATCHING_UP' ELSE 'BOUNDED' END AS trend FROM a""")
def _(spark, sf_dir):
    return M.lag_trend(X.lag_samples(spark, sf_dir))


BUCKETS = """SELECT pipeline, elapsed_s // 86400 * 86400 AS start_s, min(lag) AS least, max(lag) AS most, arg_max(lag, elapsed_s * 1000000000 + n) FILTER (lag IS NOT NULL) AS last, count(*) AS samples, count(CASE WHEN lag IS NULL THEN 1 END) AS unknown FROM lag_samples GROUP BY 1, 2"""


@query("agg_20_lag_buckets", BUCKETS)
def _(spark, sf_dir):
    return M.lag_buckets(X.lag_samples(spark, sf_dir), 86400)


@query("agg_20_merged_buckets", BUCKETS.replace("86400", "604800").replace("start_s", "wide_s"))
def _(spark, sf_dir):
    return M.merge_buckets(M.lag_buckets(X.lag_samples(spark, sf_dir), 86400), 604800)


@query("agg_21_lag_floor_peak", f"""WITH b AS ({BUCKETS}), r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY start_s) AS i, count(*) OVER (PARTITION BY pipeline) AS c FROM b)
SELECT pipeline, min(CASE WHEN i <= greatest(c // 3, 1) THEN least END) AS first_floor, min(CASE WHEN i > c - greatest(c // 3, 1) THEN least END) AS last_floor, max(most) AS peak FROM r GROUP BY 1""")
def _(spark, sf_dir):
    return M.lag_floor_peak(M.lag_buckets(X.lag_samples(spark, sf_dir), 86400))


@query("agg_22_fleet_totals", """WITH m AS (SELECT user_id % 5 AS fleet, user_id, count(*) AS c, max(event_id) AS p FROM events GROUP BY 1, 2)
SELECT 'fleet-' || fleet AS fleet, count(*) AS tables, CASE WHEN count(CASE WHEN user_id % 35 = 1 THEN 1 END) = 0 THEN sum(c)::BIGINT END AS rows, CASE WHEN count(CASE WHEN user_id % 45 = 2 THEN 1 END) = 0 THEN least(min(p), max(p - 10)) END AS covered FROM m GROUP BY fleet""")
def _(spark, sf_dir):
    m = X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("c"), F.max("event_id").alias("p"))
    return M.fleet_totals(m.select(F.concat(F.lit("fleet-"), F.col("user_id") % 5).alias("fleet"), F.when(F.col("user_id") % 35 != 1, F.col("c")).alias("rows"), F.when(F.col("user_id") % 45 != 2, F.col("p")).alias("position"),
                                   (F.col("p") - 10).alias("source_position")))


@query("agg_23_snapshot_progress", """SELECT c_mktsegment AS table_name, sum(n)::BIGINT AS planned_rows, sum(b)::BIGINT AS planned_bytes, coalesce(sum(CASE WHEN s % 3 <> 0 THEN n END), 0)::BIGINT AS published_rows, coalesce(sum(CASE WHEN s % 3 <> 0 THEN b END), 0)::BIGINT AS published_bytes,
count(*) AS planned_objects, count(CASE WHEN s % 3 <> 0 THEN 1 END) AS published_objects FROM (SELECT c_mktsegment, c_custkey // 100 AS s, count(*) AS n, sum(length(c_name)) AS b FROM customer GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("table_name"), F.floor(F.col("c_custkey") / 100).alias("s")).agg(F.count("*").alias("rows"), F.sum(F.length("c_name")).alias("bytes"))
    return M.snapshot_progress(c.withColumn("published", F.col("s") % 3 != 0))


@query("agg_24_published_rows", """SELECT sum(declared)::BIGINT AS rows, count(CASE WHEN m.source_file IS NULL THEN 1 END) AS without_manifest, count(CASE WHEN f.source_file IS NULL THEN 1 END) AS without_payload FROM manifests m FULL JOIN file_rows f ON m.source_file = f.source_file""")
def _(spark, sf_dir):
    return M.published_rows(X.file_rows(spark, sf_dir).withColumnRenamed("source_file", "batch_id"), X.manifests(spark, sf_dir).select(F.col("source_file").alias("batch_id"), F.col("declared").alias("event_count")))


@query("agg_26_tail_calm", """WITH l AS (SELECT event_type AS t, max_by(event_id % 1500, event_id) AS lag FROM events WHERE event_type <> 'view' GROUP BY 1), w AS (SELECT DISTINCT event_type AS t FROM events)
SELECT count(*) AS watched, count(lag) AS seen, max(lag) AS most_lag, bool_and(coalesce(lag <= 5000, false)) AS calm FROM w LEFT JOIN l ON w.t = l.t""")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "view", "noise").otherwise(F.concat(F.lit("stats table="), "event_type", F.lit(" lag="), F.col("event_id") % 1500, F.lit(" ok")))
    return M.tail_calm(e.select(line.alias("line"), F.col("event_id").alias("n")), e.select(F.col("event_type").alias("table_name")).distinct(), 5000)


@query("agg_27_capture_counters", """SELECT run, count(*) AS polls, count(CASE WHEN events = 0 THEN 1 END) AS empty, sum(events)::BIGINT AS events, sum(bytes)::BIGINT AS bytes, count(CASE WHEN rotated THEN 1 END) AS rotations, max(errors_total) AS errors, sum(poll_ms)::BIGINT AS poll_ms,
CASE WHEN sum(poll_ms) > 0 THEN (sum(events) * 1000 // sum(poll_ms))::BIGINT END AS events_per_s FROM capture_polls GROUP BY run""")
def _(spark, sf_dir):
    return M.capture_counters(X.capture_polls(spark, sf_dir))


@query("agg_28_stage_durations", """WITH s AS (SELECT i, (event_id + i) % 50 AS ms FROM events, range(7) t(i) WHERE event_id % 9 <> 0), k AS (SELECT (['discover', 'snapshot', 'split', 'history', 'mirror', 'checkpoint', 'lag'])[i + 1] AS stage, ms FROM s WHERE i <> 1 OR ms < 10)
SELECT stage, count(*) AS cycles, round(quantile_cont(ms, 0.5), 3)::DOUBLE AS p50_ms, round(quantile_cont(ms, 0.95), 3)::DOUBLE AS p95_ms, max(ms)::DOUBLE AS most_ms FROM k GROUP BY stage""")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    stages = F.create_map(*[x for i, s in enumerate(M.STAGES) for x in (F.lit(s), ((F.col("event_id") + i) % 50).cast("double"))])
    some = F.map_filter(stages, lambda k, v: (k != "snapshot") | (v < 10))
    total = F.aggregate(F.map_values(some), F.lit(0.0), lambda a, x: a + x)
    line = F.to_json(F.struct((total + F.when(F.col("event_id") % 9 == 0, -1.0).otherwise(2.0)).alias("cycle_ms"), some.alias("stages_ms")))
    got = M.stage_durations(e.select(line.alias("line")))
    return got.withColumns({c: F.round(c, 3) for c in ("p50_ms", "p95_ms")})


@query("agg_29_known_sum", "SELECT pipeline, sum(CASE WHEN pipeline <> 'view' THEN credits END)::BIGINT AS total FROM metering GROUP BY pipeline")
def _(spark, sf_dir):
    return M.known_sum(X.metering(spark, sf_dir).withColumn("credits", F.when(F.col("pipeline") != "view", F.col("credits"))), ["pipeline"], "credits")


@query("agg_30_requests_24h", f"SELECT pipeline, sum(CASE WHEN last_us > {NOW} - 172800000000 AND last_us <= {NOW} - 86400000000 AND pipeline <> 'click' THEN n END)::BIGINT AS requests FROM hourly GROUP BY pipeline")
def _(spark, sf_dir):
    h = X.hourly(spark, sf_dir).where("pipeline <> 'click'").unionByName(X.hourly(spark, sf_dir).where("pipeline = 'click' and n < 0 or pipeline = 'click' and hour < timestamp_ntz'2024-01-02 00:00:00'"))
    return M.requests_24h(h.select("pipeline", F.col("last_us").alias("at_us"), F.col("n").alias("requests")), NOW - 86400000000)


@query("agg_31_connection_rollup", """WITH t AS (SELECT user_id % 7 AS c, CASE WHEN user_id % 7 = 0 AND user_id % 21 = 0 THEN 'incident' WHEN user_id % 7 = 1 AND user_id % 3 = 0 THEN 'unknown' WHEN user_id % 7 < 4 THEN 'planned_stop' ELSE 'healthy' END AS state,
max(event_id) AS lag, count(*) AS tp, user_id FROM events GROUP BY user_id)
SELECT 'conn-' || c AS connection, CASE min(CASE state WHEN 'incident' THEN 1 WHEN 'unknown' THEN 2 WHEN 'degraded' THEN 3 WHEN 'planned_stop' THEN 4 ELSE 5 END) WHEN 1 THEN 'incident' WHEN 2 THEN 'unknown' WHEN 3 THEN 'degraded' WHEN 4 THEN 'planned_stop' ELSE 'healthy' END AS state,
max(CASE WHEN user_id % 2 = 0 THEN lag END) AS lag, sum(CASE WHEN c <> 5 THEN tp END)::BIGINT AS throughput FROM t GROUP BY c""")
def _(spark, sf_dir):
    u, c = F.col("user_id"), F.col("user_id") % 7
    state = F.when((c == 0) & (u % 21 == 0), "incident").when((c == 1) & (u % 3 == 0), "unknown").when(c < 4, "planned_stop").otherwise("healthy")
    t = X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("lag"), F.count("*").alias("tp"))
    return M.connection_rollup(t.select(F.concat(F.lit("conn-"), c).alias("connection"), state.alias("state"), F.when(u % 2 == 0, F.col("lag")).alias("lag"), F.when(c != 5, F.col("tp")).alias("throughput")))


@query("agg_27_capture_costs", """SELECT run, count(CASE WHEN events = 0 AND NOT rotated THEN 1 END) AS idle, count(CASE WHEN events > 0 THEN 1 END) AS batches, sum(events)::BIGINT AS events, sum(CASE WHEN n % 5 <> 0 THEN poll_ms END)::BIGINT AS read_ms, sum(n % 11)::BIGINT AS write_ms,
sum(CASE WHEN n % 2 = 0 THEN n % 7 END)::BIGINT AS cpu_ms, CASE WHEN sum(events) > 0 THEN floor(sum(CASE WHEN n % 2 = 0 THEN n % 7 END) * 1000 / sum(events))::BIGINT END AS cpu_us_per_event FROM capture_polls GROUP BY run""")
def _(spark, sf_dir):
    n = F.col("n")
    p = X.capture_polls(spark, sf_dir).withColumns({"read_ms": F.when(n % 5 != 0, F.col("poll_ms")), "write_ms": n % 11, "cpu_ms": F.when(n % 2 == 0, n % 7)})
    return M.capture_costs(p, ["read_ms", "write_ms"])


@query("agg_28_stage_failures", """WITH c AS (SELECT CASE n % 9 WHEN 0 THEN 'history' WHEN 1 THEN 'mirror' WHEN 2 THEN 'elsewhere' WHEN 3 THEN 'lag' END AS stage, n % 2 = 0 AS timed FROM capture_polls)
SELECT stage, count(*) AS failures, count(CASE WHEN NOT (timed AND stage <> 'lag') THEN 1 END) AS without_time FROM c WHERE stage IN ('history', 'mirror', 'lag') GROUP BY stage""")
def _(spark, sf_dir):
    """Failures in three stages and in a name that is none; even polls give times of all stages but the lag."""
    n = F.col("n")
    failed = F.element_at(F.array(*[F.lit(s) for s in ("history", "mirror", "elsewhere", "lag", None, None, None, None, None)]), (n % 9 + 1).cast("int"))
    times = F.when(n % 2 == 0, F.create_map(F.lit("history"), F.lit(1.0), F.lit("mirror"), F.lit(2.0))).otherwise(F.create_map().cast("map<string,double>"))
    return M.stage_failures(X.capture_polls(spark, sf_dir).select(F.to_json(F.struct(failed.alias("failed_stage"), times.alias("stages_ms"))).alias("line")))
