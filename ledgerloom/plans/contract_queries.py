"""Queries for projections, canonical forms and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms as P
from ..operators import contract as C
from ..operators import ledger as L
from ..sources import fixtures as X
from .ledger_queries import ledger
from .registry import query

BROKEN = """SELECT * REPLACE (CASE WHEN n % 31 = 0 THEN NULL ELSE after_key END AS after_key, CASE WHEN n % 37 = 0 THEN 7 ELSE before_key END AS before_key,
CASE WHEN n % 41 = 0 THEN 'zz' ELSE operation END AS operation) FROM ledger"""


def broken(spark, sf_dir):
    n = F.col("n")
    return ledger(spark, sf_dir).withColumns({
        "after_key": F.when(n % 31 != 0, F.col("after_key")), "before_key": F.when(n % 37 == 0, F.lit(7)).otherwise(F.col("before_key")),
        "operation": F.when(n % 41 == 0, "zz").otherwise(F.col("operation"))})


@query("prj_2_event_id", "SELECT event_id, sha256('ibmi|JRN|' || receiver || '|' || sequence) = event_id AS derived FROM journal_events")
def _(spark, sf_dir):
    return X.journal_events(spark, sf_dir).select("event_id", (P.event_id(F.lit("ibmi"), F.lit("JRN"), "receiver", "sequence") == F.col("event_id")).alias("derived"))


@query("prj_5_key_fingerprint", """SELECT event_id, CASE WHEN after_key IS NOT NULL THEN sha256('[' || after_key || ']') END AS after_fp,
CASE WHEN before_key IS NOT NULL THEN sha256('[' || before_key || ']') END AS before_fp FROM ledger""")
def _(spark, sf_dir):
    return ledger(spark, sf_dir).select("event_id", P.key_fingerprint(F.col("after_key").isNotNull(), "after_key").alias("after_fp"),
                                        P.key_fingerprint(F.col("before_key").isNotNull(), "before_key").alias("before_fp"))


@query("prj_5_key_object", """SELECT event_id, CASE WHEN after_key IS NOT NULL THEN '{"k":' || after_key || ',"zone":' || CASE WHEN n % 3 = 0 THEN 'null' ELSE '"' || event_type || '"' END || '}' END AS after_object FROM ledger""")
def _(spark, sf_dir):
    zone = F.when(F.col("n") % 3 != 0, F.col("event_type"))
    return ledger(spark, sf_dir).select("event_id", P.key_object(F.col("after_key").isNotNull(), k="after_key", zone=zone).alias("after_object"))


@query("prj_6_project_events", """SELECT event_id, receiver, sequence, lower(operation) AS op, starts_with(receiver, 'SNAPSHOT:') AS is_snapshot, before_key, after_key, CASE WHEN before_key IS NOT NULL THEN sha256('[' || before_key || ']') END AS before_fp,
CASE WHEN after_key IS NOT NULL THEN sha256('[' || after_key || ']') END AS after_fp, CASE WHEN before_key IS NOT NULL THEN '{"k":' || before_key || ',"type":"' || event_type || '"}' END AS before_image,
CASE WHEN after_key IS NOT NULL THEN '{"k":' || after_key || ',"type":"' || event_type || '"}' END AS after_image FROM ledger""")
def _(spark, sf_dir):
    return L.project_events(ledger(spark, sf_dir), {"k": ("before_key", "after_key"), "type": ("event_type", "event_type")})


@query("prj_8_canonicalise", """WITH q AS (SELECT *, cents // 10 + CASE WHEN cents % 10 > 5 OR (cents % 10 = 5 AND (cents // 10) % 2 = 1) THEN 1 ELSE 0 END AS even FROM orders_source)
SELECT o_orderkey, rpad(o_orderstatus, 8, ' ') AS status, (even // 100) || '.' || lpad((even % 100)::VARCHAR, 2, '0') AS amount FROM q""")
def _(spark, sf_dir):
    s = X.orders_source(spark, sf_dir)
    thousandth = (F.col("cents").cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")).cast("decimal(28,6)")
    return s.select("o_orderkey", P.canonical_char(F.col("o_orderstatus"), 8).alias("status"), P.canonical_decimal(thousandth.cast("string"), 2).alias("amount"))


@query("prj_8_canonicalise_schema", """SELECT o_orderkey::VARCHAR AS o_orderkey, rpad(o_orderstatus, 3, ' ') AS o_orderstatus, (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS price, strftime(o_orderdate, '%Y-%m-%d') AS day,
strftime(o_orderdate, '%Y-%m-%d 00:00:00.000') AS moment, o_orderpriority FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)""")
def _(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", "o_orderstatus", (X.cents("o_totalprice").cast("decimal(20,0)") / 100).cast("decimal(22,4)").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"),
                    F.date_format("o_orderdate", "yyyy-MM-dd-HH.mm.ss").alias("moment"), "o_orderpriority")
    return P.canonicalise(rows, {"o_orderkey": ("integer",), "o_orderstatus": ("char", 3), "price": ("decimal", 22, 2), "day": ("date",), "moment": ("timestamp", 3), "o_orderpriority": ("varchar",)})


@query("prj_9_canonical_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 3 = 2 THEN 'two_digit_year' END AS refused FROM orders""")
def _(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yy-MM-dd"))
    day, why = P.canonical_date(text)
    return o.select("o_orderkey", day.alias("day"), why.alias("refused"))


@query("prj_10_canonical_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.') || substr(strftime(ts, '%f'), 1, 3) AS ts3, strftime(ts, '%Y-%m-%d %H:%M:%S.') || strftime(ts, '%f') || '000' AS ts9 FROM events")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return e.select("event_id", P.canonical_timestamp(text, 3).alias("ts3"), P.canonical_timestamp(text, 9).alias("ts9"))


@query("prj_11_normalise_values", """SELECT n, CASE WHEN s LIKE '%.%' THEN CASE WHEN rtrim(rtrim(s, '0'), '.') IN ('-0', '') THEN '0' ELSE rtrim(rtrim(s, '0'), '.') END ELSE s END AS plain
FROM (SELECT n, CAST(CAST(cents AS DECIMAL(20,2)) / 100 AS DECIMAL(20,4))::VARCHAR AS s FROM (SELECT n, cents * (CASE WHEN n % 9 = 0 THEN 0 ELSE 1 END) AS cents FROM ledger))""")
def _(spark, sf_dir):
    c = F.col("cents") * F.when(F.col("n") % 9 == 0, 0).otherwise(1)
    exact = (c.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,4)")
    return ledger(spark, sf_dir).select("n", P.plain_decimal(exact).alias("plain"))


@query("prj_12_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 - CASE WHEN event_id % 2 = 0 THEN 7200000 ELSE 0 END AS at_ms FROM events")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "").otherwise("Z"))
    return e.select("event_id", P.epoch_ms(text, 2).alias("at_ms"))


LOCAL = "SELECT event_id, make_timestamp((1704067200 + event_id * 6007 % 31622400) * 1000000) AS local FROM events"


@query("prj_13_resolve_source_time", f"""SELECT event_id, CASE WHEN w IS NULL THEN epoch_us(local) - CASE WHEN local >= TIMESTAMP '2024-03-31 03:00:00' AND local < TIMESTAMP '2024-10-27 02:00:00' THEN 7200000000 ELSE 3600000000 END END AS utc_us, w AS refused FROM (
SELECT *, CASE WHEN local >= TIMESTAMP '2024-03-31 02:00:00' AND local < TIMESTAMP '2024-03-31 03:00:00' THEN 'nonexistent_hour' WHEN local >= TIMESTAMP '2024-10-27 02:00:00' AND local < TIMESTAMP '2024-10-27 03:00:00' THEN 'ambiguous_hour' END AS w FROM ({LOCAL}))""")
def _(spark, sf_dir):
    """Wall clocks all over the leap year 2024, with both changes of the zone."""
    utc, why = P.local_to_utc(F.col("local"), "Europe/Paris")
    return local_clocks(spark, sf_dir).select("event_id", F.unix_micros(utc).alias("utc_us"), why.alias("refused"))


@query("prj_13_september_rule", f"""SELECT event_id, CASE WHEN w IS NULL THEN epoch_us(local) - CASE WHEN local >= TIMESTAMP '2024-03-31 03:00:00' AND local < TIMESTAMP '2024-09-29 01:00:00' THEN 7200000000 ELSE 3600000000 END END AS utc_us, w AS refused FROM (
SELECT *, CASE WHEN local >= TIMESTAMP '2024-03-31 02:00:00' AND local < TIMESTAMP '2024-03-31 03:00:00' THEN 'nonexistent_hour' WHEN local >= TIMESTAMP '2024-09-29 01:00:00' AND local < TIMESTAMP '2024-09-29 02:00:00' THEN 'ambiguous_hour' END AS w FROM ({LOCAL}))""")
def _(spark, sf_dir):
    utc, why = P.september_to_utc(F.col("local"))
    return local_clocks(spark, sf_dir).select("event_id", F.unix_micros(utc).alias("utc_us"), why.alias("refused"))


def local_clocks(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") * 6007 % 31622400).alias("local"))


@query("prj_14_system_keys", "SELECT n, receiver || '/' || sequence || '/' || op AS technical, at_ms || '/' || op AS temporal FROM first_system")
def _(spark, sf_dir):
    return X.first_system(spark, sf_dir).select("n", P.technical_key("receiver", "sequence", "op").alias("technical"), P.temporal_key("at_ms", "op").alias("temporal"))


@query("prj_15_positions", "SELECT event_id, receiver || ':' || lpad(sequence::VARCHAR, 20, '0') AS position, receiver AS decoded_receiver, sequence AS decoded_sequence FROM ledger")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir).withColumn("position", P.encode_position("receiver", "sequence"))
    r, s = P.decode_position("position")
    return led.select("event_id", "position", r.alias("decoded_receiver"), s.alias("decoded_sequence"))


@query("con_1_contract_violations", f"""WITH b AS ({BROKEN}), r AS (SELECT event_id, CASE WHEN operation NOT IN ('c', 'u', 'u_before', 'u_after', 'd') THEN 'operation_unknown'
WHEN operation = 'c' AND after_key IS NULL THEN 'create_without_after' WHEN operation = 'c' AND before_key IS NOT NULL THEN 'create_with_before'
WHEN operation = 'd' AND before_key IS NULL THEN 'delete_without_before' WHEN operation = 'd' AND after_key IS NOT NULL THEN 'delete_with_after'
WHEN operation = 'u' AND (before_key IS NULL OR after_key IS NULL) THEN 'update_without_both_images'
WHEN operation = 'u_after' AND after_key IS NULL THEN 'after_image_missing' WHEN operation = 'u_after' AND before_key IS NOT NULL THEN 'after_image_with_before' END AS reason FROM b)
SELECT * FROM r WHERE reason IS NOT NULL""")
def _(spark, sf_dir):
    return C.contract_violations(broken(spark, sf_dir)).select("event_id", "reason")


@query("con_2_null_keys", f"""WITH b AS ({BROKEN}) SELECT event_id, operation FROM b WHERE (operation IN ('d', 'u', 'u_before') AND before_key IS NULL) OR (operation IN ('c', 'u', 'u_after') AND after_key IS NULL)""")
def _(spark, sf_dir):
    return C.null_keys(broken(spark, sf_dir)).select("event_id", "operation")


@query("con_3_ambiguous_receivers", """WITH f AS (SELECT receiver, date_trunc('year', min(commit_ts)) AS first_ts FROM ledger WHERE receiver NOT LIKE 'SNAPSHOT:%' GROUP BY receiver)
SELECT epoch_us(first_ts) AS first_us, count(*) AS receivers, string_agg(receiver, ',' ORDER BY receiver) AS names FROM f GROUP BY first_ts HAVING count(*) > 1""")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir).withColumn("commit_ts", F.date_trunc("year", "commit_ts"))
    return C.ambiguous_receivers(led).select(X.micros("first_ts").alias("first_us"), "receivers", F.array_join("names", ",").alias("names"))


@query("con_4_snapshot_count", "SELECT count(DISTINCT CASE WHEN receiver LIKE 'SNAPSHOT:%' THEN receiver END) AS snapshots, count(DISTINCT CASE WHEN receiver LIKE 'SNAPSHOT:%' THEN receiver END) > 1 AS refused FROM ledger")
def _(spark, sf_dir):
    return C.snapshot_count(ledger(spark, sf_dir))


@query("con_5_orphan_deletes", """SELECT event_id FROM ledger d WHERE operation = 'd' AND NOT EXISTS (SELECT 1 FROM ledger i WHERE i.after_key = d.before_key AND i.commit_ts <= d.commit_ts AND i.receiver NOT LIKE 'SNAPSHOT:%' AND i.sequence % 4 = 0)""")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir).withColumns({"before_rrn": F.col("before_key"), "after_rrn": F.when(~L.is_snapshot() & (F.col("sequence") % 4 == 0), F.col("after_key"))})
    return C.orphan_deletes(led).select("event_id")


@query("con_6_scope", "SELECT event_id, source_file FROM raw_events WHERE source_file LIKE '%/ORDERS/%' AND (source_file LIKE '%JRN9/batch-00000.jsonl' OR source_file LIKE '%SNAPSHOT/batch-00001.jsonl')")
def _(spark, sf_dir):
    ends = spark.createDataFrame([("JRN9/batch-00000.jsonl",), ("SNAPSHOT/batch-00001.jsonl",)], "suffix string")
    return C.in_scope(X.raw_events(spark, sf_dir), "ORDERS", ends).select("event_id", "source_file")


@query("con_6_of_table", """WITH e AS (SELECT event_id, 'LIB' || (n % 2) AS library, 'T' || (n % 3) AS table_name FROM ledger)
SELECT event_id FROM e WHERE library = 'LIB0' AND table_name = 'T1'""")
def _(spark, sf_dir):
    e = ledger(spark, sf_dir).withColumns({"library": F.concat(F.lit("LIB"), F.col("n") % 2), "table_name": F.concat(F.lit("T"), F.col("n") % 3)})
    return C.of_table(e, "LIB0", "T1").select("event_id")


@query("con_7_schema_drift", """WITH v AS (SELECT DISTINCT 'v' || (n % 3 + 1) AS v FROM (SELECT n % 3 + CASE WHEN n % 3 < 0 THEN 3 ELSE 0 END AS n FROM ledger)),
f AS (SELECT v, field FROM v JOIN (VALUES ('v1', 'cents'), ('v1', 'event_type'), ('v2', 'cents'), ('v2', 'event_type'), ('v2', 'k2'), ('v3', 'cents'), ('v3', 'k2')) p(pv, field) ON pv = v),
base AS (SELECT field FROM f WHERE v = (SELECT min(v) FROM f)), d AS (SELECT f.v, string_agg(CASE WHEN b.field IS NULL THEN f.field END, ',' ORDER BY f.field) AS added, count(b.field) AS kept FROM f LEFT JOIN base b ON b.field = f.field GROUP BY f.v)
SELECT v AS schema_version, added FROM d WHERE added IS NOT NULL AND kept = (SELECT count(*) FROM base)""")
def _(spark, sf_dir):
    e = ledger(spark, sf_dir)
    """The second version adds a field; the third also loses one, so it is no drift of this kind."""
    v = F.concat(F.lit("v"), F.pmod("n", F.lit(3)) + 1)
    image = F.when(v == "v1", F.to_json(F.struct("cents", "event_type"))).when(v == "v2", F.to_json(F.struct("cents", "event_type", "k2"))).otherwise(F.to_json(F.struct("cents", "k2")))
    drift = C.schema_drift(e.withColumns({"k2": F.lit(1), "cents": F.coalesce("cents", F.lit(0))}).select(v.alias("schema_version"), image.alias("image")))
    return drift.withColumn("added", F.array_join("added", ","))


@query("con_8_after_boundary", "SELECT event_id FROM ledger WHERE receiver <> 'JRN9' OR sequence > 1000")
def _(spark, sf_dir):
    return C.after_boundary(ledger(spark, sf_dir), "JRN9", 1000).select("event_id")


@query("con_9_not_yet_loaded", "SELECT event_id FROM ledger WHERE (receiver <> 'JRN9' OR sequence > 1000) AND n % 3 <> 0")
def _(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return C.not_yet_loaded(led, "JRN9", 1000, led.where("n % 3 = 0")).select("event_id")


@query("con_12_replay_order", """WITH b AS (SELECT receiver, end_seq AS watermark, start_seq FROM receipts_broken UNION ALL SELECT 'JRN7', 1, 1)
SELECT b.receiver, watermark, ordinal, CASE WHEN ordinal IS NULL THEN 'receiver_unknown' WHEN count(*) OVER (PARTITION BY b.receiver, watermark) > 1 THEN 'watermark_twice' END AS refused
FROM b LEFT JOIN receiver_catalogue c ON b.receiver = c.receiver""")
def _(spark, sf_dir):
    b = X.receipts_broken(spark, sf_dir).select("receiver", F.col("end_seq").alias("watermark")).union(spark.createDataFrame([("JRN7", 1)], "receiver string, watermark long"))
    return C.replay_order(b, X.receiver_catalogue(spark, sf_dir).select("receiver", "ordinal")).select("receiver", "watermark", "ordinal", "refused")


@query("con_13_mutation_window_checks", """WITH e AS (SELECT receiver || '-' || (sequence // 1000) AS w, * FROM journal_events),
o AS (SELECT *, lag(sequence) OVER (PARTITION BY w ORDER BY sequence) AS prev, coalesce(after_key, before_key) AS k FROM e),
a AS (SELECT w, true AS scope, count(DISTINCT receiver) = 1 AS single_receiver, count(CASE WHEN sequence <= prev THEN 1 END) = 0 AS strict_order, count(CASE WHEN k IS NULL THEN 1 END) = 0 AS keys,
 count(CASE WHEN operation = 'c' THEN 1 END) > 0 AND count(CASE WHEN operation = 'd' THEN 1 END) > 0 AND count(CASE WHEN operation IN ('u', 'u_after') THEN 1 END) > 0 AS operation_coverage,
 count(CASE WHEN operation = 'u_after' THEN 1 END) = 0 AS image_balance, count(CASE WHEN operation = 'u_after' THEN 1 END) = 0 AS image_order,
 count(CASE WHEN cents IS NULL THEN 1 END) = 0 AS business_null, w NOT LIKE 'JRN2%' AS additive_schema, count(*) = count(DISTINCT event_id) AS idempotent_replay FROM o GROUP BY w)
SELECT w AS "window", "check", passed FROM (UNPIVOT a ON scope, single_receiver, strict_order, keys, operation_coverage, image_balance, image_order, business_null, additive_schema, idempotent_replay INTO NAME "check" VALUE passed)""")
def _(spark, sf_dir):
    j = X.journal_events(spark, sf_dir).withColumns({"window": F.concat("receiver", F.lit("-"), F.floor(F.col("sequence") / 1000)), "table_name": F.lit("ORDERS"), "k": F.coalesce("after_key", "before_key")})
    # every window opens with one schema and is written with another; that of one receiver loses a field on the way
    fields = F.when(F.col("receiver") == "JRN2", F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return C.mutation_window_checks(j.withColumns({"schema_version": F.lit("v2"), "fields": fields, "opened_with": F.array(F.lit("a"), F.lit("b"))}))


@query("prj_3_map_entry_type", """SELECT event_id, CASE event_type WHEN 'signup' THEN 'c' WHEN 'click' THEN 'u_after' WHEN 'view' THEN 'u_before' WHEN 'error' THEN 'd' END AS operation, event_type = 'purchase' AS refused FROM events""")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "PT", "click", "UP", "view", "UB", "error", "DL", "purchase", "BR")])
    op, refused = C.map_entry_type(kinds[F.col("event_type")])
    return e.select("event_id", op.alias("operation"), refused.alias("refused"))


@query("jon_7_not_exists", """SELECT event_id, before_key FROM ledger d WHERE operation = 'd' AND NOT EXISTS (SELECT 1 FROM ledger i WHERE i.after_key = d.before_key AND i.commit_ts <= d.commit_ts AND i.sequence % 9 = 0)""")
def _(spark, sf_dir):
    """The inequality is decided by the earliest known time of a key, so the join stays an equi join."""
    led = ledger(spark, sf_dir).withColumns({"before_rrn": F.col("before_key"), "after_rrn": F.when(F.col("sequence") % 9 == 0, F.col("after_key"))})
    return C.orphan_deletes(led).select("event_id", "before_key")
