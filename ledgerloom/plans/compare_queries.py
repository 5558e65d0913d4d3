"""Queries that compare systems: joins, sets and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as R
from ..operators import ledger as L
from ..sources import fixtures as X
from .ledger_queries import ledger
from .registry import query

FIELDS = ["o_custkey", "o_orderstatus", "cents"]
PAIRED = "FROM orders_source s FULL JOIN orders_dest d USING (o_orderkey)"


@query("jon_1_missing", "SELECT o_orderkey FROM orders_source WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_dest)")
def _(spark, sf_dir):
    return R.missing(X.orders_source(spark, sf_dir), X.orders_dest(spark, sf_dir), ["o_orderkey"])


@query("jon_2_common", "SELECT s.o_orderkey, s.cents AS source_cents, d.cents AS dest_cents FROM orders_source s JOIN orders_dest d USING (o_orderkey)")
def _(spark, sf_dir):
    s, d = X.orders_source(spark, sf_dir), X.orders_dest(spark, sf_dir)
    return s.select("o_orderkey", F.col("cents").alias("source_cents")).join(d.select("o_orderkey", F.col("cents").alias("dest_cents")), "o_orderkey")


@query("jon_3_keyed_diff", """WITH p AS (SELECT o_orderkey, s.o_custkey AS sc, d.o_custkey AS dc, s.o_orderstatus AS ss, d.o_orderstatus AS ds, s.cents AS sm, d.cents AS dm, s.o_orderkey AS sk, d.o_orderkey AS dk
FROM orders_source s FULL JOIN orders_dest d ON s.o_orderkey = d.o_orderkey, LATERAL (SELECT coalesce(s.o_orderkey, d.o_orderkey) AS o_orderkey))
SELECT o_orderkey, 'missing' AS kind, NULL AS field, NULL AS expected, NULL AS actual FROM p WHERE dk IS NULL UNION ALL
SELECT o_orderkey, 'extra', NULL, NULL, NULL FROM p WHERE sk IS NULL UNION ALL
SELECT o_orderkey, 'field', 'o_custkey', sc::VARCHAR, dc::VARCHAR FROM p WHERE sk IS NOT NULL AND dk IS NOT NULL AND sc IS DISTINCT FROM dc UNION ALL
SELECT o_orderkey, 'field', 'o_orderstatus', ss, ds FROM p WHERE sk IS NOT NULL AND dk IS NOT NULL AND ss IS DISTINCT FROM ds UNION ALL
SELECT o_orderkey, 'field', 'cents', sm::VARCHAR, dm::VARCHAR FROM p WHERE sk IS NOT NULL AND dk IS NOT NULL AND sm IS DISTINCT FROM dm""".replace(
    "FROM orders_source s FULL JOIN orders_dest d ON s.o_orderkey = d.o_orderkey, LATERAL (SELECT coalesce(s.o_orderkey, d.o_orderkey) AS o_orderkey))", "FROM orders_source s FULL JOIN orders_dest d ON s.o_orderkey = d.o_orderkey)").replace(
    "SELECT o_orderkey, s.o_custkey AS sc", "SELECT coalesce(s.o_orderkey, d.o_orderkey) AS o_orderkey, s.o_custkey AS sc"))
def _(spark, sf_dir):
    return R.keyed_diff(X.orders_source(spark, sf_dir), X.orders_dest(spark, sf_dir), ["o_orderkey"], FIELDS)


SUMMARY = f"""SELECT count(CASE WHEN s.o_custkey IS NOT NULL AND d.o_custkey IS NOT NULL THEN 1 END) AS compared, count(CASE WHEN d.o_custkey IS NULL THEN 1 END) AS missing,
count(CASE WHEN s.o_custkey IS NULL THEN 1 END) AS extra, 3 * count(CASE WHEN s.o_custkey IS NOT NULL AND d.o_custkey IS NOT NULL THEN 1 END) AS cells,
sum(CASE WHEN s.o_custkey IS NOT NULL AND d.o_custkey IS NOT NULL THEN (s.o_orderstatus IS DISTINCT FROM d.o_orderstatus)::INT + (s.cents IS DISTINCT FROM d.cents)::INT ELSE 0 END)::BIGINT AS differing,
count(CASE WHEN s.o_custkey IS NOT NULL AND d.o_custkey IS NOT NULL AND d.cents IS NULL THEN 1 END) AS null_cells {PAIRED}"""


@query("agg_25_cell_counts", SUMMARY)
def _(spark, sf_dir):
    return R.diff_summary(X.orders_source(spark, sf_dir), X.orders_dest(spark, sf_dir), ["o_orderkey"], FIELDS)


@query("rec_1_reconcile_events", f"""WITH d AS ({SUMMARY}) SELECT (SELECT count(*) FROM orders_source) AS source_rows, (SELECT count(*) FROM orders_dest) AS dest_rows, d.*,
CASE WHEN missing = 0 AND extra = 0 AND differing = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM d""")
def _(spark, sf_dir):
    return R.reconcile_events(X.orders_source(spark, sf_dir), X.orders_dest(spark, sf_dir), "o_orderkey", FIELDS)


@query("jon_4_ledger_of_files", "SELECT event_id FROM ledger WHERE event_id IN (SELECT event_id FROM raw_events WHERE source_file LIKE '%JRN2/%')")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir)
    return L.dedupe_first(raw).join(raw.where("source_file like '%JRN2/%'").select("event_id"), "event_id", "left_semi").select("event_id")


NEAREST = """WITH p AS (SELECT a.op, a.n AS a_n, a.sequence AS a_seq, b.sequence AS b_seq, row_number() OVER (PARTITION BY a.n ORDER BY abs(b.sequence - a.sequence), b.sequence) AS i
FROM first_system a JOIN (SELECT DISTINCT at_ms, op, sequence FROM second_system) b ON a.at_ms + 3600000 = b.at_ms AND a.op = b.op)"""


@query("jon_8_nearest_sequence", NEAREST + " SELECT a_n, a_seq, b_seq, b_seq - a_seq AS delta FROM p WHERE i = 1")
def _(spark, sf_dir):
    a = X.first_system(spark, sf_dir).withColumn("key", F.concat_ws("/", F.col("at_ms") + 3600000, "op"))
    b = X.second_system(spark, sf_dir).withColumn("key", F.concat_ws("/", "at_ms", "op"))
    return R.nearest_sequence(a, b, "key").select("a_n", "a_seq", "b_seq", "delta")


@query("jon_8_delta_profile", NEAREST + """ SELECT count(*) AS n, min(b_seq - a_seq) AS least, max(b_seq - a_seq) AS most, count(DISTINCT b_seq - a_seq) AS different,
count(DISTINCT b_seq - a_seq) = 1 AS constant, count(CASE WHEN b_seq = a_seq THEN 1 END) AS exact FROM p WHERE i = 1""")
def _(spark, sf_dir):
    a = X.first_system(spark, sf_dir).withColumn("key", F.concat_ws("/", F.col("at_ms") + 3600000, "op"))
    b = X.second_system(spark, sf_dir).withColumn("key", F.concat_ws("/", "at_ms", "op"))
    return R.delta_profile(R.nearest_sequence(a, b, "key"))


FILES = """SELECT coalesce(m.source_file, f.source_file) AS source_file, declared, loaded, CASE WHEN m.source_file IS NULL THEN 'unreceipted' WHEN declared IS NULL THEN 'pending'
WHEN loaded IS NULL THEN 'missing' WHEN loaded < declared THEN 'short' WHEN loaded > declared THEN 'over' ELSE 'matched' END AS state FROM manifests m FULL JOIN file_rows f ON m.source_file = f.source_file"""


@query("jon_9_files_against_receipts", FILES)
def _(spark, sf_dir):
    return R.files_against_receipts(X.manifests(spark, sf_dir), X.file_rows(spark, sf_dir))


@query("rec_5_files_vs_receipts", f"WITH x AS ({FILES}) SELECT state, count(*) AS files, sum(coalesce(declared, 0))::BIGINT AS declared, sum(coalesce(loaded, 0))::BIGINT AS loaded FROM x GROUP BY state")
def _(spark, sf_dir):
    x = R.files_against_receipts(X.manifests(spark, sf_dir), X.file_rows(spark, sf_dir))
    return x.groupBy("state").agg(F.count("*").alias("files"), F.sum(F.coalesce("declared", F.lit(0))).alias("declared"), F.sum(F.coalesce("loaded", F.lit(0))).alias("loaded"))


@query("jon_10_replay_proof", """WITH b AS (SELECT DISTINCT k, event_id FROM mirror_broken), s AS (SELECT k, CASE WHEN k % 89 = 0 THEN 'other' ELSE event_id END AS stored FROM b)
SELECT count(CASE WHEN m.event_id = stored THEN 1 END) AS conform, count(CASE WHEN m.event_id <> stored THEN 1 END) AS divergent, count(CASE WHEN stored IS NULL THEN 1 END) AS missing, count(CASE WHEN m.event_id IS NULL THEN 1 END) AS unexpected
FROM mirror m FULL JOIN s ON m.k = s.k""")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir)
    won = L.latest_operation(L.operations(led), L.receiver_ranks(led))
    stored = X.broken_mirror(L.replay_full(led)).select("k", "event_id").distinct().withColumn("event_id", F.when(F.col("k") % 89 == 0, "other").otherwise(F.col("event_id")))
    return R.replay_proof(won, stored)


@query("jon_12_reconcile3", """WITH o AS (SELECT o_orderkey AS key, o_custkey || '/' || o_orderstatus || '/' || coalesce(cents::VARCHAR, '') AS d FROM orders_source), t AS (SELECT o_orderkey AS key, o_custkey || '/' || o_orderstatus || '/' || coalesce(cents::VARCHAR, '') AS d FROM orders_dest),
p AS (SELECT o.d AS oracle, o.d AS source, t.d AS destination, CASE WHEN t.key % 7 <> 0 THEN t.d END AS mirror FROM o FULL JOIN t ON o.key = t.key),
x AS (SELECT 'oracle-source' AS pair, oracle AS a, source AS b FROM p UNION ALL SELECT 'oracle-destination', oracle, destination FROM p UNION ALL SELECT 'source-destination', source, destination FROM p UNION ALL
SELECT 'destination-mirror', destination, mirror FROM p UNION ALL SELECT 'oracle-mirror', oracle, mirror FROM p)
SELECT pair, count(CASE WHEN a = b THEN 1 END) AS same, count(CASE WHEN a IS NOT NULL AND b IS NULL THEN 1 END) AS missing, count(CASE WHEN a IS NULL AND b IS NOT NULL THEN 1 END) AS extra, count(CASE WHEN a <> b THEN 1 END) AS different FROM x GROUP BY pair""")
def _(spark, sf_dir):
    s, d = X.orders_source(spark, sf_dir), X.orders_dest(spark, sf_dir)
    return R.reconcile3(s, s, d, d.where("o_orderkey % 7 <> 0"), "o_orderkey", FIELDS)


@query("set_3_multiset", """WITH a AS (SELECT at_ms, op, count(*) AS x FROM first_system GROUP BY 1, 2), b AS (SELECT at_ms - 3600000 AS at_ms, op, count(*) AS y FROM second_system GROUP BY 1, 2),
j AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.at_ms = b.at_ms AND a.op = b.op)
SELECT sum(least(x, y))::BIGINT AS overlap, sum(greatest(x - y, 0))::BIGINT AS missing, sum(greatest(y - x, 0))::BIGINT AS extra FROM j""")
def _(spark, sf_dir):
    b = X.second_system(spark, sf_dir).withColumn("at_ms", F.col("at_ms") - 3600000)
    return R.multiset_counts(X.first_system(spark, sf_dir), b, ["at_ms", "op"])


@query("set_4_technical_sets", """SELECT (SELECT count(*) FROM (SELECT receiver, sequence, op FROM first_system INTERSECT SELECT receiver, sequence, op FROM second_system)) AS overlap,
(SELECT count(*) FROM (SELECT receiver, sequence, op FROM first_system EXCEPT SELECT receiver, sequence, op FROM second_system)) AS missing,
(SELECT count(*) FROM (SELECT receiver, sequence, op FROM second_system EXCEPT SELECT receiver, sequence, op FROM first_system)) AS extra""")
def _(spark, sf_dir):
    return R.set_counts(X.first_system(spark, sf_dir), X.second_system(spark, sf_dir), ["receiver", "sequence", "op"])


BANDS = """SELECT at_ms // 86400000 AS band, (at_ms // 86400000) * 86400000 AS low, (at_ms // 86400000) * 86400000 + 86399999 AS high, max(x) AS x, max(y) AS y FROM (
SELECT at_ms, op, 1 AS x, 0 AS y FROM first_system UNION ALL SELECT at_ms - 3600000, op, 0, 1 FROM second_system) GROUP BY at_ms, op"""


@query("set_5_band_comparability", f"""WITH k AS ({BANDS}), b AS (SELECT band, min(low) AS low, max(high) AS high, sum(x * y) AS overlap, sum(x * (1 - y)) AS missing, sum(y * (1 - x)) AS extra FROM k GROUP BY band),
c AS (SELECT min(at_ms) AS low, max(at_ms) AS high FROM first_system)
SELECT band, CASE WHEN b.low < c.low OR b.high > c.high THEN 'NOT_COMPARABLE' WHEN missing = 0 AND extra = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM b, c""")
def _(spark, sf_dir):
    a, b = X.first_system(spark, sf_dir), X.second_system(spark, sf_dir).withColumn("at_ms", F.col("at_ms") - 3600000)
    day = F.floor(F.col("at_ms") / 86400000)
    k = (a.select("at_ms", "op", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("at_ms", "op", F.lit(0), F.lit(1))).groupBy("at_ms", "op").agg(F.max("x").alias("x"), F.max("y").alias("y"))
         .groupBy(day.alias("band")).agg(F.sum(F.col("x") * F.col("y")).alias("overlap"), F.sum(F.col("x") * (1 - F.col("y"))).alias("missing"), F.sum(F.col("y") * (1 - F.col("x"))).alias("extra")))
    bands = k.withColumns({"low": F.col("band") * 86400000, "high": F.col("band") * 86400000 + 86399999})
    return R.band_comparability(bands, a.agg(F.min("at_ms").alias("low"), F.max("at_ms").alias("high")))


@query("set_6_best_offset", """WITH h AS (SELECT unnest([-1, 0, 1, 2]) AS hours), a AS (SELECT hours, at_ms, op, count(*) AS x FROM first_system, h GROUP BY ALL), b AS (SELECT hours, at_ms - hours * 3600000 AS at_ms, op, count(*) AS y FROM second_system, h GROUP BY ALL),
o AS (SELECT coalesce(a.hours, b.hours) AS hours, sum(least(coalesce(x, 0), coalesce(y, 0)))::BIGINT AS overlap FROM a FULL JOIN b ON a.hours = b.hours AND a.at_ms = b.at_ms AND a.op = b.op GROUP BY 1)
SELECT hours, overlap, overlap > 0 AND row_number() OVER (ORDER BY overlap DESC, hours) = 1 AS best FROM o""")
def _(spark, sf_dir):
    return R.best_offset(X.first_system(spark, sf_dir), X.second_system(spark, sf_dir), [-1, 0, 1, 2])


@query("set_7_position_diff", """WITH p AS (SELECT receiver, sequence, sum(c) AS c, sum(s) AS s FROM (SELECT receiver, sequence, 1 AS c, 0 AS s FROM second_system UNION ALL SELECT receiver, sequence, 0, 1 FROM first_system WHERE sequence % 211 <> 0) GROUP BY 1, 2)
SELECT receiver, sequence, CASE WHEN c = 0 THEN 'missing' WHEN s = 0 THEN 'unexpected' ELSE 'duplicate' END AS kind FROM p WHERE c = 0 OR s = 0 OR c > 1""")
def _(spark, sf_dir):
    return R.position_diff(X.second_system(spark, sf_dir), X.first_system(spark, sf_dir).where("sequence % 211 <> 0"))


@query("agg_17_duplicate_identities", "SELECT event_id, count(*) AS copies FROM raw_events GROUP BY event_id HAVING count(*) > 1")
def _(spark, sf_dir):
    return R.duplicate_identities(X.raw_events(spark, sf_dir))


@query("agg_18_replay_check", """WITH r AS (SELECT event_id, count(*) AS n, count(DISTINCT CASE WHEN n % 20 = 0 THEN attempt ELSE 0 END) AS contents FROM raw_events GROUP BY event_id)
SELECT sum(n)::BIGINT AS raw_rows, count(*) AS distinct_ids, sum(CASE WHEN contents = 1 THEN n - 1 ELSE 0 END)::BIGINT AS identical_repeats, sum(CASE WHEN contents > 1 THEN n - 1 ELSE 0 END)::BIGINT AS divergent_repeats FROM r""")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir).withColumn("cents", F.when(F.col("n") % 20 == 0, F.col("cents") + F.col("attempt")).otherwise(F.col("cents")))
    return R.replay_check(raw, ["operation", "before_key", "after_key", "cents"])


@query("win_9_before_image_mismatch", """WITH e AS (SELECT *, user_id AS k, CASE WHEN operation IN ('d', 'u') AND event_id % 3 <> 0 THEN event_id END AS bv, event_id AS av FROM operation_events),
r AS (SELECT receiver, dense_rank() OVER (ORDER BY min(ts)) AS receiver_rank FROM e GROUP BY receiver),
s AS (SELECT k, e.receiver, sequence, operation, bv, lag(operation) OVER w AS po, lag(av) OVER w AS pv FROM e JOIN r ON e.receiver = r.receiver WINDOW w AS (PARTITION BY k ORDER BY receiver_rank, sequence))
SELECT k, receiver, sequence, CASE WHEN operation = 'd' AND (po IS NULL OR po = 'd') THEN 'delete_of_absent_key' ELSE 'before_image_differs' END AS reason FROM s
WHERE (operation = 'd' AND (po IS NULL OR po = 'd')) OR (operation IN ('d', 'u') AND po IS NOT NULL AND po <> 'd' AND bv IS NOT NULL AND bv IS DISTINCT FROM pv)""")
def _(spark, sf_dir):
    j = X.journal_events(spark, sf_dir)
    e = j.select(F.coalesce("before_key", "after_key").alias("k"), "receiver", "sequence", "operation", F.when(F.col("operation").isin("d", "u") & (F.col("n") % 3 != 0), F.col("n")).alias("before_value"), F.col("n").alias("after_value"))
    return R.before_image_mismatch(e, L.receiver_ranks(j))


@query("rec_2_reconcile_run", """SELECT (SELECT count(*) FROM mirror) AS expected_rows, (SELECT count(*) FROM mirror_broken) AS mirror_rows, (SELECT count(*) FROM mirror WHERE k NOT IN (SELECT k FROM mirror_broken)) AS missing_keys,
(SELECT count(*) FROM (SELECT k FROM mirror_broken GROUP BY k HAVING count(*) > 1)) AS duplicate_keys,
(SELECT count(*) FROM mirror m JOIN (SELECT k, max(cents) AS cents FROM mirror_broken GROUP BY k) b ON m.k = b.k WHERE m.cents <> b.cents) AS different_keys,
(SELECT count(*) FROM (SELECT DISTINCT k FROM mirror_broken) b JOIN winners w ON w.k = b.k WHERE w.kind = 'delete') AS deleted_present, 'FAIL' AS verdict""")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir)
    won = L.latest_operation(L.operations(led), L.receiver_ranks(led)).select("k", "kind", "cents")
    held = X.broken_mirror(L.replay_full(led)).groupBy("k").agg(F.count("*").alias("rows"), F.max("cents").alias("held"))
    x = won.join(held, "k", "full_outer")
    up = F.col("kind") == "upsert"
    out = x.agg(F.count_if(up).alias("expected_rows"), F.sum("rows").alias("mirror_rows"), F.count_if(up & F.col("rows").isNull()).alias("missing_keys"), F.count_if(F.col("rows") > 1).alias("duplicate_keys"),
                F.count_if(up & (F.col("cents") != F.col("held"))).alias("different_keys"), F.count_if((F.col("kind") == "delete") & F.col("rows").isNotNull()).alias("deleted_present"))
    return out.withColumn("verdict", F.when((F.col("missing_keys") == 0) & (F.col("duplicate_keys") == 0) & (F.col("different_keys") == 0) & (F.col("deleted_present") == 0), "PASS").otherwise("FAIL"))


@query("rec_3_boundary_check", """SELECT count(CASE WHEN receiver LIKE 'SNAPSHOT:%' THEN 1 END) AS snapshot_rows, min(CASE WHEN receiver NOT LIKE 'SNAPSHOT:%' THEN sequence END) AS least, max(CASE WHEN receiver NOT LIKE 'SNAPSHOT:%' THEN sequence END) AS most,
count(CASE WHEN receiver NOT LIKE 'SNAPSHOT:%' AND commit_ts < TIMESTAMP '2024-01-03 00:00:00' THEN 1 END) AS before_bootstrap FROM ledger""")
def _(spark, sf_dir):
    return R.boundary_check(ledger(spark, sf_dir), "2024-01-03 00:00:00")


@query("rec_4_history_equality", """WITH e AS (SELECT event_id, receiver, sequence, cents, n FROM ledger),
k AS (SELECT * REPLACE (CASE WHEN n % 50 = 9 THEN cents + 1 ELSE cents END AS cents) FROM e WHERE n % 50 IS DISTINCT FROM 7), a AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE n % 50 = 11),
c AS (SELECT (SELECT count(DISTINCT event_id) FROM e WHERE event_id NOT IN (SELECT event_id FROM a)) AS missing, (SELECT count(DISTINCT event_id) FROM a WHERE event_id NOT IN (SELECT event_id FROM e)) AS unexpected,
  (SELECT count(DISTINCT a.event_id) FROM a JOIN e ON a.event_id = e.event_id WHERE (a.receiver, a.sequence, a.cents) IS DISTINCT FROM (e.receiver, e.sequence, e.cents)) AS different,
  (SELECT count(*) FROM (SELECT event_id FROM a GROUP BY event_id HAVING count(*) > 1)) AS repeated_ids,
  (SELECT count(*) FROM (SELECT receiver, sequence FROM a GROUP BY ALL HAVING count(DISTINCT event_id) > 1)) AS repeated_positions)
SELECT *, CASE WHEN missing + unexpected + different + repeated_ids + repeated_positions = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""")
def _(spark, sf_dir):
    e = ledger(spark, sf_dir).select("event_id", "receiver", "sequence", "cents", "n")
    a = e.where("not (n % 50 <=> 7)").withColumn("cents", F.when(F.col("n") % 50 == 9, F.col("cents") + 1).otherwise(F.col("cents")))
    a = a.union(a.where("n % 50 = 11"))
    return R.history_equality(a, e, ["receiver", "sequence", "cents"])


@query("rec_7_reconcile_files", """WITH f AS (SELECT DISTINCT source_file FROM raw_events WHERE source_file LIKE '%JRN9/%'), s AS (SELECT * FROM raw_events WHERE source_file IN (SELECT source_file FROM f))
SELECT count(*) AS raw_rows, count(DISTINCT event_id) AS distinct_ids, count(DISTINCT source_file) AS files_seen, (SELECT count(*) FROM ledger WHERE event_id IN (SELECT event_id FROM s)) AS ledger_rows, (SELECT count(*) FROM f) AS files_listed, 'FAIL' AS verdict FROM s""")
def _(spark, sf_dir):
    raw = X.raw_events(spark, sf_dir)
    return R.reconcile_files(raw, L.dedupe_first(raw), raw.where("source_file like '%JRN9/%'").select("source_file").distinct(), 4000)


WINDOWS = "SELECT receiver || '-' || start_seq AS window_id, receiver, start_seq, end_seq, CASE WHEN start_seq = 1001 THEN 0 WHEN start_seq = 501 THEN event_count + 1 ELSE event_count END AS event_count FROM receipts"


@query("rec_9_window_delivery", f"""WITH w AS ({WINDOWS}) SELECT window_id, event_count, (SELECT count(*) FROM journal_events j WHERE j.receiver = w.receiver AND j.sequence BETWEEN start_seq AND end_seq) AS raw_rows,
CASE WHEN event_count = 0 THEN 'not_tested' WHEN event_count = (SELECT count(*) FROM journal_events j WHERE j.receiver = w.receiver AND j.sequence BETWEEN start_seq AND end_seq) THEN 'matched' ELSE 'invalid' END AS state FROM w""")
def _(spark, sf_dir):
    r = X.receipts(spark, sf_dir)
    w = r.select(F.concat_ws("-", "receiver", "start_seq").alias("window_id"), "receiver", "start_seq", "end_seq",
                 F.when(F.col("start_seq") == 1001, 0).when(F.col("start_seq") == 501, F.col("event_count") + 1).otherwise(F.col("event_count")).alias("event_count"))
    return R.window_delivery(w, X.journal_events(spark, sf_dir), ledger(spark, sf_dir))


@query("rec_11_write_latency", """WITH v AS (SELECT user_id AS marker, min(epoch_us(ts)) AS visible_us FROM events WHERE event_type <> 'signup' GROUP BY 1), w AS (SELECT user_id AS marker, min(epoch_us(ts)) AS acked_us FROM events GROUP BY 1)
SELECT w.marker, CASE WHEN visible_us >= acked_us THEN visible_us - acked_us END AS latency_us, CASE WHEN visible_us IS NULL THEN 'not_visible' WHEN visible_us < acked_us THEN 'clock' END AS reason FROM w LEFT JOIN v ON v.marker = w.marker""")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("marker"), X.micros("ts").alias("us"), "event_type")
    return R.write_latency(e.groupBy("marker").agg(F.min("us").alias("acked_us")), e.where("event_type <> 'signup'").select("marker", F.col("us").alias("visible_us")))


@query("rec_12_find_published", """WITH e AS (SELECT user_id AS marker, epoch_us(ts) // 3600000000 AS published_us, event_id::VARCHAR AS event_id FROM events), f AS (SELECT marker, min(published_us) AS p, count(*) AS publications FROM e WHERE marker % 3 = 0 GROUP BY 1)
SELECT f.marker, min(event_id) AS event_id, any_value(publications) AS publications, count(DISTINCT event_id) > 1 AS ambiguous FROM f JOIN e ON e.marker = f.marker AND e.published_us = f.p GROUP BY f.marker""")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("marker"), F.floor(X.micros("ts") / 3600000000).alias("published_us"), F.col("event_id").cast("string").alias("event_id"))
    return R.find_published(e, e.where("marker % 3 = 0").select("marker").distinct())


@query("rec_13_resume_progress", """WITH p AS (SELECT coalesce(before_key, after_key) AS id, min(struct_pack(t := commit_ts, r := receiver, s := sequence)) AS a, max(struct_pack(t := commit_ts, r := receiver, s := sequence)) AS b FROM journal_events GROUP BY 1),
q AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'JRN?' WHEN id % 2 = 0 THEN a.r ELSE b.r END AS r0, CASE WHEN id % 2 = 0 THEN a.s ELSE b.s END AS s0, CASE WHEN id % 2 = 0 THEN b.r ELSE a.r END AS r1, CASE WHEN id % 2 = 0 THEN b.s ELSE a.s END AS s1 FROM p)
SELECT id, CASE WHEN x.receiver_rank IS NULL OR y.receiver_rank IS NULL THEN 'unmeasured' WHEN x.receiver_rank = y.receiver_rank AND s0 = s1 THEN 'same'
  WHEN y.receiver_rank > x.receiver_rank OR y.receiver_rank = x.receiver_rank AND s1 > s0 THEN 'forward' ELSE 'backward' END AS progress
FROM q LEFT JOIN receiver_ranks x ON x.receiver = r0 LEFT JOIN receiver_ranks y ON y.receiver = r1""")
def _(spark, sf_dir):
    j = X.journal_events(spark, sf_dir)
    place = F.struct("commit_ts", "receiver", "sequence")
    p = j.groupBy(F.coalesce("before_key", "after_key").alias("id")).agg(F.min(place).alias("a"), F.max(place).alias("b"))
    fwd = F.col("id") % 2 == 0
    first, last = F.when(fwd, F.col("a")).otherwise(F.col("b")), F.when(fwd, F.col("b")).otherwise(F.col("a"))
    pos = p.select("id", F.when(F.col("id") % 5 == 0, "JRN?").otherwise(first["receiver"]).alias("before_receiver"), first["sequence"].alias("before_seq"), last["receiver"].alias("after_receiver"), last["sequence"].alias("after_seq"))
    return R.resume_progress(pos, L.receiver_ranks(j))


@query("jon_13_offsets_by_events", """SELECT hours, count(*) AS matches FROM (SELECT unnest([-1, 0, 1]) AS hours) h, first_system a WHERE EXISTS (SELECT 1 FROM second_system b WHERE b.at_ms = a.at_ms + hours * 3600000 AND b.op = a.op) GROUP BY hours""")
def _(spark, sf_dir):
    """A few candidate offsets against all events, as an equi semi join on the shifted time."""
    a = X.first_system(spark, sf_dir).select("op", F.explode(F.array(*[F.lit(h) for h in (-1, 0, 1)])).alias("hours"), "at_ms").withColumn("at_ms", F.col("at_ms") + F.col("hours") * 3600000)
    return a.join(X.second_system(spark, sf_dir), ["at_ms", "op"], "left_semi").groupBy("hours").agg(F.count("*").alias("matches"))


@query("rec_9_chain_verdict", f"""WITH w AS ({WINDOWS}), s AS (SELECT window_id, event_count, (SELECT count(*) FROM journal_events j WHERE j.receiver = w.receiver AND j.sequence BETWEEN start_seq AND end_seq) AS raw_rows FROM w),
t AS (SELECT CASE WHEN event_count = 0 THEN 'not_tested' WHEN event_count = raw_rows THEN 'matched' ELSE 'invalid' END AS state FROM s)
SELECT count(*) AS windows, count(CASE WHEN state = 'matched' THEN 1 END) AS matched, count(CASE WHEN state = 'not_tested' THEN 1 END) AS not_tested, count(CASE WHEN state = 'invalid' THEN 1 END) AS invalid,
CASE WHEN count(*) = 0 THEN 'empty' WHEN count(CASE WHEN state = 'invalid' THEN 1 END) > 0 THEN 'broken' WHEN count(CASE WHEN state = 'not_tested' THEN 1 END) > 0 THEN 'untested' ELSE 'complete' END AS verdict FROM t""")
def _(spark, sf_dir):
    r = X.receipts(spark, sf_dir)
    w = r.select(F.concat_ws("-", "receiver", "start_seq").alias("window_id"), "receiver", "start_seq", "end_seq",
                 F.when(F.col("start_seq") == 1001, 0).when(F.col("start_seq") == 501, F.col("event_count") + 1).otherwise(F.col("event_count")).alias("event_count"))
    return R.chain_verdict(R.window_delivery(w, X.journal_events(spark, sf_dir), ledger(spark, sf_dir), width=700))


@query("set_5_classify_matrix", """WITH k AS (SELECT at_ms, op, sum(x) AS x, sum(y) AS y FROM (SELECT at_ms, op, 1 AS x, 0 AS y FROM first_system UNION ALL SELECT at_ms - 3600000, op, 0, 1 FROM second_system) GROUP BY 1, 2),
b AS (SELECT at_ms // 86400000 AS band, sum(least(x, y))::BIGINT AS overlap, sum(greatest(x - y, 0))::BIGINT AS missing, sum(greatest(y - x, 0))::BIGINT AS extra FROM k GROUP BY 1), c AS (SELECT min(at_ms) AS low, max(at_ms) AS high FROM first_system),
r AS (SELECT b.*, CASE WHEN band * 86400000 < low THEN 'before_coverage' WHEN band * 86400000 + 86399999 > high THEN 'after_coverage' END AS reason FROM b, c)
SELECT 'ORDERS' AS table_name, band, overlap, missing, extra, CASE WHEN reason IS NOT NULL THEN 'NOT_COMPARABLE' WHEN missing = 0 AND extra = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, reason FROM r""")
def _(spark, sf_dir):
    a, b = X.first_system(spark, sf_dir), X.second_system(spark, sf_dir).withColumn("at_ms", F.col("at_ms") - 3600000)
    one = F.lit("ORDERS").alias("table_name")
    return R.classify_matrix(a.select(one, "at_ms", "op"), b.select(one, "at_ms", "op"), a.agg(F.min("at_ms").alias("low"), F.max("at_ms").alias("high")), 86400000)


RUN = """WITH o AS (SELECT k, cents FROM mirror), d AS (SELECT k, cents FROM mirror), h AS (SELECT k, cents FROM mirror_broken), hm AS (SELECT k, min(cents) AS lo, max(cents) AS hi FROM h GROUP BY k),
x AS (SELECT count(*) AS c FROM o FULL JOIN (SELECT k, hi AS cents FROM hm) m ON o.k = m.k WHERE o.k IS NULL OR m.k IS NULL OR o.cents <> m.cents),
j AS (SELECT l.*, r.receiver_rank FROM ledger l LEFT JOIN receiver_ranks r ON r.receiver = l.receiver WHERE l.receiver NOT LIKE 'SNAPSHOT:%')
SELECT 0 AS oracle_vs_source, 0 AS oracle_vs_destination, 0 AS source_vs_destination, (SELECT c FROM x) AS destination_vs_mirror, (SELECT c FROM x) AS oracle_vs_mirror, (SELECT count(*) FROM (SELECT k FROM h GROUP BY k HAVING count(*) > 1)) AS duplicate_mirror_keys,
(SELECT count(*) FROM j WHERE receiver_rank < (SELECT receiver_rank FROM receiver_ranks WHERE receiver = 'JRN9') OR receiver = 'JRN9' AND sequence < 11) AS before_bootstrap, (SELECT count(*) FROM j WHERE sequence % 211 = 0) AS position_differences,
0 AS divergent_repeats, 0 AS unexplained_repeats, (SELECT count(*) FROM ledger WHERE n % 50 = 11) AS history_repeats, (SELECT count(*) FROM ledger WHERE n % 50 = 11) AS history_off_by, 'FAIL' AS verdict"""


@query("rec_2_reconcile_run_in_full", RUN)
def _(spark, sf_dir):
    """A run whose mirror, history, boundary and positions are off in known ways; the image checks have a query of their own."""
    raw = X.raw_events(spark, sf_dir)
    led = L.dedupe_first(raw)
    state = L.replay_full(led).select("k", "cents")
    j = led.withColumns({"k": F.coalesce("before_key", "after_key"), "before_value": F.lit(None).cast("long"), "after_value": F.col("cents")})
    gone = L.latest_operation(L.operations(led), L.receiver_ranks(led)).where("kind = 'delete'").select("k")
    ids = led.select("event_id", "n")
    run = R.reconcile_run(state, state, state, X.broken_mirror(L.replay_full(led)).select("k", "cents"), "k", ["cents"], j, L.receiver_ranks(led), ("JRN9", 11),
                          led.where("sequence % 211 <> 0 and receiver not like 'SNAPSHOT:%'").select("receiver", "sequence"), raw, ["operation", "before_key", "after_key", "cents"],
                          ids.union(ids.where("n % 50 = 11")).select("event_id"), gone)
    return run.drop("before_image_mismatches", "deleted_present")


@query("rec_1_column_sets", "SELECT 'cents' AS \"column\", 'missing' AS kind UNION ALL SELECT 'o_totalprice', 'extra'")
def _(spark, sf_dir):
    s = X.orders_source(spark, sf_dir)
    return R.column_sets(s, s.withColumnRenamed("cents", "o_totalprice"))


@query("agg_25_cell_kinds", """SELECT c AS "column", count(*) AS cells, count(CASE WHEN v IS NULL THEN 1 END) AS nulls, count(CASE WHEN regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 1 END) AS numeric FROM (
SELECT unnest(['o_custkey', 'o_orderstatus', 'cents']) AS c, unnest([o_custkey::VARCHAR, o_orderstatus, cents::VARCHAR]) AS v FROM orders_dest) GROUP BY c""")
def _(spark, sf_dir):
    return R.cell_kinds(X.orders_dest(spark, sf_dir), FIELDS)


@query("agg_17_duplicate_totals", "SELECT count(*) AS rows, count(DISTINCT event_id) AS distinct_ids, count(*) - count(DISTINCT event_id) AS surplus, (SELECT count(*) FROM (SELECT event_id FROM raw_events GROUP BY event_id HAVING count(*) > 1)) AS repeated_ids FROM raw_events")
def _(spark, sf_dir):
    return R.duplicate_totals(X.raw_events(spark, sf_dir))


@query("set_3_multiset_digests", """WITH a AS (SELECT at_ms, op, count(*) AS x FROM first_system GROUP BY 1, 2), b AS (SELECT at_ms - 3600000 AS at_ms, op, count(*) AS y FROM second_system GROUP BY 1, 2),
j AS (SELECT coalesce(a.at_ms, b.at_ms) || '|' || coalesce(a.op, b.op) AS t, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.at_ms = b.at_ms AND a.op = b.op), h AS (SELECT *, ('0x' || substr(sha256(t), 1, 15))::BIGINT::HUGEINT AS h FROM j)
SELECT sum(h * least(x, y))::VARCHAR AS overlap_digest, sum(h * greatest(x - y, 0))::VARCHAR AS missing_digest, sum(h * greatest(y - x, 0))::VARCHAR AS extra_digest FROM h""")
def _(spark, sf_dir):
    b = X.second_system(spark, sf_dir).withColumn("at_ms", F.col("at_ms") - 3600000)
    return R.multiset_digests(X.first_system(spark, sf_dir), b, ["at_ms", "op"])


@query("rec_11_write_bounds", """WITH e AS (SELECT user_id AS marker, epoch_us(ts) AS us, event_type FROM events), w AS (SELECT marker, min(us) AS acked_us FROM e GROUP BY 1), r AS (SELECT marker, min(us) AS raw_us FROM e WHERE event_type = 'click' GROUP BY 1),
v AS (SELECT marker, max(CASE WHEN event_type = 'view' THEN us END) AS absent_us, min(CASE WHEN event_type = 'purchase' THEN us END) AS visible_us FROM e WHERE event_type IN ('view', 'purchase') GROUP BY 1),
x AS (SELECT w.marker, acked_us, raw_us, absent_us, visible_us, CASE WHEN visible_us IS NULL THEN 'not_visible' WHEN coalesce(raw_us < acked_us, false) OR visible_us < acked_us OR coalesce(visible_us < absent_us, false) THEN 'clock' END AS reason FROM w LEFT JOIN r ON r.marker = w.marker LEFT JOIN v ON v.marker = w.marker)
SELECT marker, CASE WHEN reason IS NULL THEN raw_us - acked_us END AS to_raw_us, CASE WHEN reason IS NULL THEN greatest(coalesce(absent_us, acked_us) - acked_us, 0) END AS at_least_us, CASE WHEN reason IS NULL THEN visible_us - acked_us END AS at_most_us, reason FROM x""")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("marker"), X.micros("ts").alias("us"), "event_type")
    v = e.where("event_type in ('view', 'purchase')").select("marker", F.when(F.col("event_type") == "view", F.col("us")).alias("absent_us"), F.when(F.col("event_type") == "purchase", F.col("us")).alias("visible_us"))
    return R.write_bounds(e.groupBy("marker").agg(F.min("us").alias("acked_us")), e.where("event_type = 'click'").select("marker", F.col("us").alias("raw_us")), v)
