"""Queries that write raw files to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import fixtures as X
from ..sources import raw as W
from .ledger_queries import ledger
from .registry import query


def written(spark, sf_dir) -> str:
    """The ledger as payload files and manifests in a new folder."""
    out = W.scratch(spark, "raw")
    W.write_raw_batches(ledger(spark, sf_dir).withColumn("table_name", F.lit("ORDERS")), out)
    return out


@query("src_1_read_raw_events", "SELECT event_id, receiver, sequence, operation, row_number() OVER (PARTITION BY receiver, sequence // 500 ORDER BY sequence, event_id) AS row_number FROM ledger")
def _(spark, sf_dir):
    raw = W.project_envelope(W.read_raw_events(spark, written(spark, sf_dir)))
    return raw.select("event_id", "receiver", "sequence", "operation", F.col("source_row_number").cast("long").alias("row_number"))


@query("src_2_read_listed_files", "SELECT event_id, sequence FROM ledger WHERE (receiver = 'JRN9' AND sequence // 500 = 0) OR (receiver = 'JRN2' AND sequence // 500 = 0)")
def _(spark, sf_dir):
    files = ["table_name=ORDERS/receiver_dir=JRN9/batch=000000", "table_name=ORDERS/receiver_dir=JRN2/batch=000000"]
    return W.project_envelope(W.read_raw_events(spark, written(spark, sf_dir), files)).select("event_id", "sequence")


BATCHES = "SELECT 'ORDERS/' || replace(receiver, ':', '_') || '/' || lpad((sequence // 500)::VARCHAR, 6, '0') AS batch_id, receiver, count(*) AS event_count, max(sequence) AS last_sequence FROM ledger GROUP BY 1, 2"


@query("src_3_read_manifests", BATCHES)
def _(spark, sf_dir):
    m = W.read_manifests(spark, written(spark, sf_dir))
    return m.select("batch_id", F.col("high_watermark.receiver").alias("receiver"), "event_count", F.col("high_watermark.sequence").alias("last_sequence"))


@query("src_4_read_receipts", "SELECT receiver, start_seq, end_seq, event_count FROM receipts")
def _(spark, sf_dir):
    out = W.scratch(spark, "receipts")
    r = X.receipts(spark, sf_dir)
    pos = lambda c: F.struct("receiver", F.col(c).alias("sequence"))
    r.select(F.lit("v2").alias("format_version"), pos("start_seq").alias("start"), pos("end_seq").alias("end"), "event_count").write.json(out)
    got = W.read_receipts(spark, out)
    return got.select(F.col("start.receiver").alias("receiver"), F.col("start.sequence").alias("start_seq"), F.col("end.sequence").alias("end_seq"), "event_count")


@query("src_5_journal_window", "SELECT event_id, sequence FROM journal_events WHERE receiver = 'JRN2' AND sequence BETWEEN 300 AND 900 AND operation IN ('c', 'd')")
def _(spark, sf_dir):
    return W.journal_window(X.journal_events(spark, sf_dir), "JRN2", 300, 900, codes=["c", "d"]).select("event_id", "sequence")


@query("src_7_read_partitioned", """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), c AS (SELECT i, lo + (hi - lo + 1) * i // 7 AS low, lo + (hi - lo + 1) * (i + 1) // 7 - 1 AS high FROM b, range(7) t(i))
SELECT o_orderkey, i::INT AS chunk, low - 1 AS ordinal_base FROM orders JOIN c ON o_orderkey BETWEEN low AND high""")
def _(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    b = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return W.read_partitioned(o, "o_orderkey", b[0], b[1], 7).select("o_orderkey", "chunk", "ordinal_base")


@query("src_8_latest_raw_object", "WITH b AS (" + BATCHES + ") SELECT count(*) AS objects, true AS newest_is_recent, true AS has_bytes FROM b")
def _(spark, sf_dir):
    """One file a batch; its time is the file system's, so it is only held to be of the last hour."""
    got = W.latest_raw_object(spark, written(spark, sf_dir))
    age = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("last_object_at")
    return got.select("objects", ((age >= -5) & (age < 3600)).alias("newest_is_recent"), (F.col("bytes") > 0).alias("has_bytes"))


@query("src_8_latest_of_listed_keys", "SELECT 2 AS objects")
def _(spark, sf_dir):
    """Only listed objects count; names that are not there do not."""
    keys = ["receiver_dir=JRN9/batch=000000", "receiver_dir=JRN2/batch=000000", "receiver_dir=JRN2/batch=999999"]
    return W.latest_raw_object(spark, written(spark, sf_dir), keys).select(F.col("objects").cast("int").alias("objects"))


@query("src_9_write_raw_batches", BATCHES.replace("AS last_sequence", "AS last_sequence, sha256(string_agg(event_id, ',' ORDER BY sequence, event_id)) AS ids"))
def _(spark, sf_dir):
    m = W.read_manifests(spark, written(spark, sf_dir))
    return m.select("batch_id", F.col("high_watermark.receiver").alias("receiver"), "event_count", F.col("high_watermark.sequence").alias("last_sequence"), F.sha2(F.array_join("event_ids", ","), 256).alias("ids"))


@query("src_9_refused_events", """WITH b AS (SELECT CASE WHEN n % 29 = 0 THEN '' WHEN n % 31 = 0 THEN 'same' ELSE event_id END AS event_id, CASE WHEN n % 37 = 0 THEN NULL ELSE receiver END AS receiver, CASE WHEN n % 41 = 0 THEN -1 ELSE sequence END AS sequence FROM journal_events),
s AS (SELECT event_id, count(DISTINCT CASE WHEN receiver IS NOT NULL AND sequence IS NOT NULL THEN receiver || '/' || sequence END) AS places FROM b GROUP BY 1),
r AS (SELECT DISTINCT b.event_id, receiver, sequence, CASE WHEN b.event_id = '' THEN 'no_id' WHEN receiver IS NULL THEN 'no_receiver' WHEN sequence < 0 THEN 'negative_position' WHEN places > 1 THEN 'several_positions' END AS reason FROM b JOIN s ON s.event_id = b.event_id)
SELECT * FROM r WHERE reason IS NOT NULL""")
def _(spark, sf_dir):
    n = F.col("n")
    j = X.journal_events(spark, sf_dir).select(F.when(n % 29 == 0, "").when(n % 31 == 0, "same").otherwise(F.col("event_id")).alias("event_id"), F.when(n % 37 != 0, F.col("receiver")).alias("receiver"), F.when(n % 41 == 0, -1).otherwise(F.col("sequence")).alias("sequence"))
    return W.refused_events(j)


@query("src_10_route_by_table", "SELECT 'T' || (n % 4) AS table_name, count(*) AS events, max(sequence) AS last_sequence, CASE WHEN n % 4 = 3 THEN 'refused' ELSE 'routed' END AS state FROM journal_events GROUP BY n % 4")
def _(spark, sf_dir):
    e = X.journal_events(spark, sf_dir).withColumn("table_name", F.concat(F.lit("T"), F.col("n") % 4))
    per, refused = W.route_by_table(e, spark.createDataFrame([("T0",), ("T1",), ("T2",)], "table_name string"))
    bad = refused.select("table_name").distinct().withColumn("bad", F.lit(True))
    return per.join(bad, "table_name", "left").select("table_name", "events", "last_sequence", F.when(F.col("bad"), "refused").otherwise("routed").alias("state"))


@query("src_10_route_check", "SELECT count(*) AS events, count(CASE WHEN n % 4 <> 3 THEN 1 END) AS routed, count(DISTINCT CASE WHEN n % 4 = 3 THEN 3 END) AS unknown_tables, CASE WHEN count(CASE WHEN n % 4 = 3 THEN 1 END) > 0 THEN 'refused' ELSE 'routed' END AS verdict FROM journal_events")
def _(spark, sf_dir):
    e = X.journal_events(spark, sf_dir).withColumn("table_name", F.concat(F.lit("T"), F.col("n") % 4))
    return W.route_check(e, spark.createDataFrame([("T0",), ("T1",), ("T2",)], "table_name string"))


@query("src_14_generate_changes", """WITH s AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 50 = 1 THEN '3-changes' WHEN c_custkey % 60 = 0 OR c_custkey % 30 = 1 THEN '2-changes' WHEN c_custkey % 4 = 3 OR c_custkey % 10 = 1 OR c_custkey % 20 = 0 THEN '1-changes' ELSE '0-seed' END AS step,
c_name, c_acctbal FROM customer WHERE c_custkey % 20 <> 0 OR c_custkey % 60 = 0)
SELECT key, step, 'Libellé ' || c_name || ' ' || step AS label, rpad('C' || key, 8, ' ') AS code, CAST(CAST(round(c_acctbal * 100) AS BIGINT) * CASE WHEN key % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS cents,
CASE WHEN key % 5 <> 0 THEN 'note ' || key END AS note FROM s""")
def _(spark, sf_dir):
    """The state that changes of the customers must lead to."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label"), (X.cents("c_acctbal") / 100).cast("decimal(15,2)").alias("amount"))
    return W.generate_changes(c)[1].select("key", "step", "label", "code", (F.col("amount") * 100).cast("long").alias("cents"), "note")


@query("prj_1_project_envelope", "SELECT event_id, receiver, sequence, operation FROM ledger")
def _(spark, sf_dir):
    j = ledger(spark, sf_dir)
    raw = j.select(F.parse_json(W.line(j.columns)).alias("payload"))
    return W.project_envelope(raw).select("event_id", "receiver", "sequence", "operation")


@query("prj_4_with_rrn", "SELECT event_id, CASE WHEN n % 19 = 0 OR n <= 0 THEN NULL ELSE n::VARCHAR END AS rrn, CASE WHEN n % 10 = 3 AND operation <> 'd' THEN 'image_missing' END AS refused FROM ledger WHERE NOT (n % 10 = 3 AND operation <> 'd') OR n % 10 = 3")
def _(spark, sf_dir):
    n = F.col("n")
    image = F.when(n % 10 != 3, F.create_map(F.lit("cents"), F.col("cents").cast("string")))
    rrn = F.when(n % 19 == 0, 0).otherwise(n)
    full, why = W.with_rrn(image, rrn, F.col("operation"))
    got = ledger(spark, sf_dir).select("event_id", full.alias("i"), why.alias("refused"), n.alias("n"), "operation")
    own = F.when(n % 19 == 0, None).when(n > 0, n.cast("string"))
    return got.select("event_id", F.when(F.col("i").isNotNull(), F.col("i")["_rrn"]).otherwise(own).alias("rrn"), "refused")


@query("prj_7_typed_history", "SELECT event_id, operation, cents, epoch_us(commit_ts) AS commit_us, before_key, after_key FROM ledger")
def _(spark, sf_dir):
    raw = W.read_raw_events(spark, written(spark, sf_dir))
    return W.typed_events(raw).select("event_id", "operation", "cents", X.micros("commit_ts").alias("commit_us"), "before_key", "after_key")


@query("prj_7_declared_history", """SELECT event_id AS _event_id, operation AS _operation, receiver AS _receiver, sequence AS _sequence, epoch_us(commit_ts) AS _commit_us, coalesce(after_key, before_key) AS k,
CAST(round(cents * 10) AS BIGINT) AS amount_mills, event_type AS label, hex(encode(event_type)) AS payload, CAST(CAST(commit_ts AS DATE) AS VARCHAR) AS day, strftime(commit_ts, '%H:%M:%S') AS clock, CASE WHEN n % 3 = 0 THEN NULL ELSE n END AS note FROM ledger""")
def _(spark, sf_dir):
    """Images as JSON text, of any declared kinds: the after-image where there is one, else the before-image."""
    led = ledger(spark, sf_dir)
    blob = F.struct(F.lit("bytes").alias("type"), F.lit("base64").alias("encoding"), F.base64(F.col("event_type").cast("binary")).alias("value"))
    image = lambda key: F.when(F.col(key).isNotNull(), F.to_json(F.struct(
        F.col(key).alias("k"), (F.col("cents") / 100).cast("decimal(20,3)").alias("amount"), F.col("event_type").alias("label"), blob.alias("payload"), F.date_format("commit_ts", "yyyy-MM-dd").alias("day"),
        F.date_format("commit_ts", "HH:mm:ss").alias("clock"), F.when(F.col("n") % 3 != 0, F.col("n")).alias("note"))))
    kinds = {"k": "bigint", "amount": "decimal(20,3)", "label": "string", "payload": "binary", "day": "date", "clock": "time", "note": "bigint"}
    typed = W.typed_history(led.withColumns({"before": image("before_key"), "after": image("after_key")}), kinds)
    return typed.select("_event_id", "_operation", "_receiver", "_sequence", X.micros("_commit_ts").alias("_commit_us"), "k", (F.col("amount") * 1000).cast("long").alias("amount_mills"), "label", F.hex("payload").alias("payload"),
                        F.col("day").cast("string").alias("day"), "clock", "note")


@query("con_10_batch_integrity", "WITH b AS (" + BATCHES + """), m AS (SELECT *, row_number() OVER (ORDER BY batch_id) AS i FROM b)
SELECT batch_id, event_count AS events, CASE WHEN i % 7 = 1 THEN 'format_unsupported' WHEN event_count <> event_count + CASE WHEN i % 7 = 2 THEN 1 ELSE 0 END THEN 'event_count' WHEN i % 7 = 3 THEN 'event_ids'
WHEN i % 7 = 4 THEN 'payload_sha256' WHEN last_sequence <> last_sequence + CASE WHEN i % 7 = 5 THEN 1 ELSE 0 END THEN 'watermark' WHEN i % 7 = 6 THEN 'manifest_missing' END AS reason FROM m""")
def _(spark, sf_dir):
    """Every seventh batch is left whole; the others' manifests say something else in one way each."""
    out = written(spark, sf_dir)
    m = W.read_manifests(spark, out)
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("batch_id")) % 7  # a name a batch; manifests hold all ids and stay where they are
    broken = m.join(m.select("batch_id").withColumn("i", i), "batch_id").where("i <> 6").withColumns({
        "event_count": F.when(F.col("i") == 2, F.col("event_count") + 1).otherwise(F.col("event_count")), "event_ids": F.when(F.col("i") == 3, F.slice(F.reverse("event_ids"), 1, 10**6)).otherwise(F.col("event_ids")),
        "payload_sha256": F.when(F.col("i") == 4, "x").otherwise(F.col("payload_sha256")), "format_version": F.when(F.col("i") == 1, "v0").otherwise(F.col("format_version")),
        "high_watermark": F.when(F.col("i") == 5, F.struct(F.col("high_watermark.receiver").alias("receiver"), (F.col("high_watermark.sequence") + 1).alias("sequence"))).otherwise(F.col("high_watermark"))})
    return W.batch_integrity(W.read_raw_events(spark, out), broken)


@query("con_11_receipt_integrity", "WITH b AS (" + BATCHES + """), s AS (SELECT 'ORDERS/' || replace(receiver, ':', '_') || '/' || lpad((sequence // 500)::VARCHAR, 6, '0') AS batch_id, min(sequence) AS lo, max(sequence) AS hi, count(*) AS n FROM ledger GROUP BY 1),
r AS (SELECT s.*, row_number() OVER (ORDER BY batch_id) % 5 AS i FROM s), c AS (SELECT *, CASE WHEN i = 2 THEN n + 1 ELSE n END AS claimed, CASE WHEN i = 3 THEN hi - 1 ELSE hi END AS claimed_end, CASE WHEN i = 4 THEN lo + 1 ELSE lo END AS claimed_start FROM r)
SELECT batch_id AS receipt, CASE WHEN i = 1 THEN 'payload_sha256' WHEN claimed <> n THEN 'event_count' WHEN claimed_end <> hi THEN 'end_is_not_watermark' WHEN lo < claimed_start OR hi > claimed_end THEN 'event_outside' END AS reason FROM c""")
def _(spark, sf_dir):
    out = written(spark, sf_dir)
    m = W.read_manifests(spark, out)
    e = W.project_envelope(W.read_raw_events(spark, out)).select("batch_id", "sequence")
    low = e.groupBy("batch_id").agg(F.min("sequence").alias("lo"))
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("batch_id")) % 5  # one row a batch
    r = m.join(low, "batch_id").withColumn("i", i).select(
        F.col("batch_id").alias("receipt"), "batch_id", F.when(F.col("i") == 4, F.col("lo") + 1).otherwise(F.col("lo")).alias("start_seq"), (F.col("high_watermark.sequence") - F.when(F.col("i") == 3, 1).otherwise(0)).alias("end_seq"),
        (F.col("event_count") + F.when(F.col("i") == 2, 1).otherwise(0)).alias("event_count"), F.when(F.col("i") == 1, "x").otherwise(F.col("payload_sha256")).alias("payload_sha256"))
    return W.receipt_integrity(r, m, e)


@query("rep_4_receipt_chain", """WITH o AS (SELECT r.*, row_number() OVER (ORDER BY ordinal, start_seq) - 1 AS place FROM receipts r JOIN receiver_catalogue c ON r.receiver = c.receiver) SELECT receiver || ':' || start_seq AS receipt, place::INT AS place, NULL AS reason FROM o""")
def _(spark, sf_dir):
    r = X.receipts(spark, sf_dir).join(F.broadcast(X.receiver_catalogue(spark, sf_dir).select("receiver", "ordinal")), "receiver")
    end = F.concat_ws(":", "receiver", "end_seq")
    w = Window.partitionBy("table_name").orderBy("ordinal", "start_seq")
    chain = r.select(F.concat_ws(":", "receiver", "start_seq").alias("receipt"), end.alias("end_key"), F.lag(end).over(w).alias("previous_key"))
    return W.receipt_chain(chain).withColumn("place", F.col("place").cast("int"))


@query("rep_4_pending_after_cursor", """WITH o AS (SELECT r.*, row_number() OVER (ORDER BY ordinal, start_seq) - 1 AS place FROM receipts r JOIN receiver_catalogue c ON r.receiver = c.receiver),
f AS (SELECT min(place) AS first FROM o WHERE receiver = 'JRN2' AND start_seq <= 750 AND end_seq > 750) SELECT receiver || ':' || start_seq AS receipt, (place - first)::INT AS place, NULL AS reason FROM o, f WHERE place >= first""")
def _(spark, sf_dir):
    """A cursor in the middle of a receipt: that one and all after it, across receivers."""
    r = X.receipts(spark, sf_dir).join(F.broadcast(X.receiver_catalogue(spark, sf_dir).select("receiver", "ordinal")), "receiver")
    w = Window.partitionBy("table_name").orderBy("ordinal", "start_seq")
    linked = r.select(F.concat_ws(":", "receiver", "start_seq").alias("receipt"), "receiver", "start_seq", "end_seq", F.lag("receiver").over(w).alias("previous_receiver"), F.lag("end_seq").over(w).alias("previous_seq"))
    return W.pending_receipts(linked, ("JRN2", 750)).withColumn("place", F.col("place").cast("int"))
