"""Ledgers, receipts and telemetry derived from the driver's tables, as lazy DataFrames.

Positions (receiver, sequence) only compare inside one receiver; receivers' names deliberately do not sort
in their order in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _file(folder: str, number) -> F.Column:
    return F.concat(F.lit(f"raw/ORDERS/{folder}"), F.lit("/batch-"), F.lpad(number.cast("string"), 5, "0"), F.lit(".jsonl"))


def journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row changes from ``events``: event ids rise with time, so a receiver's sequence is an offset into them."""
    e = table(spark, sf_dir, "events").withColumn("receiver", F.when(F.dayofmonth("ts") <= 10, "JRN9").when(F.dayofmonth("ts") <= 20, "JRN2").otherwise("JRN5"))
    first = F.broadcast(e.groupBy("receiver").agg(F.min("event_id").alias("first_id")))  # three rows
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.join(first, "receiver").select(
        "*", (F.col("event_id") - F.col("first_id") + 1).alias("sequence"), F.lag("event_type").over(user).alias("previous"), F.row_number().over(user).alias("nth"))
    op = (F.when((F.col("nth") == 1) | (F.col("previous") == "error"), "c").when(F.col("event_type") == "error", "d")
          .when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), "u").otherwise("u_after"))
    e = e.withColumn("operation", op)
    late = F.when(F.col("event_id") % 50 == 0, 2).otherwise(0)
    return e.select(
        F.sha2(F.concat_ws("|", F.lit("ibmi"), F.lit("JRN"), "receiver", "sequence"), 256).alias("event_id"), "receiver", "sequence", "operation", F.col("ts").alias("commit_ts"),
        (F.col("ts") + F.make_dt_interval(late, F.lit(0), F.lit(0), (F.col("event_id") % 300).cast("decimal(18,6)"))).alias("ingested_at"),
        F.concat(F.lit("raw/ORDERS/"), "receiver", F.lit("/batch-"), F.lpad(F.floor(F.col("sequence") / 500).cast("string"), 5, "0"), F.lit(".jsonl")).alias("source_file"),
        F.lit(0).alias("attempt"), F.when(F.col("operation").isin("d", "u"), F.col("user_id")).alias("before_key"),
        F.when(F.col("operation") == "u", F.col("user_id") + 100000).when(F.col("operation") != "d", F.col("user_id")).alias("after_key"),
        cents("value").alias("cents"), "event_type", F.col("event_id").alias("n"))


def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An initial copy: one create a customer, under a receiver of its own."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.sha2(F.concat_ws("|", F.lit("ibmi"), F.lit("SNAPSHOT:ORDERS"), F.lit("SNAPSHOT:S1"), "c_custkey"), 256).alias("event_id"), F.lit("SNAPSHOT:S1").alias("receiver"),
        F.col("c_custkey").alias("sequence"), F.lit("c").alias("operation"), F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("commit_ts"),
        F.lit("2023-12-31 00:10:00").cast("timestamp_ntz").alias("ingested_at"), _file("SNAPSHOT", F.floor(F.col("c_custkey") / 500)).alias("source_file"), F.lit(0).alias("attempt"),
        F.lit(None).cast("long").alias("before_key"), F.col("c_custkey").alias("after_key"), cents("c_acctbal").alias("cents"), F.lit("snapshot").alias("event_type"),
        (-1 - F.col("c_custkey")).alias("n"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal rows, a tenth of them delivered twice, and the snapshot."""
    j = journal_events(spark, sf_dir)
    again = j.where("n % 10 = 0").withColumns({
        "attempt": F.lit(1), "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 1 HOUR"), "source_file": F.regexp_replace("source_file", "batch-", "replay-")})
    return j.unionByName(again).unionByName(snapshot_events(spark, sf_dir))


def broken_mirror(mirror: DataFrame) -> DataFrame:
    kept = mirror.where("k % 97 <> 0")
    return kept.withColumn("cents", F.when(F.col("k") % 89 == 0, F.col("cents") + 1).otherwise(F.col("cents"))).unionByName(kept.where("k % 83 = 0"))


def orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("cents"))


def orders_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders_source(spark, sf_dir)
    changed = s.where("o_orderkey % 97 <> 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 101 == 0, "X").otherwise(F.col("o_orderstatus")),
        "cents": F.when(F.col("o_orderkey") % 89 == 0, F.col("cents") + 1).when(F.col("o_orderkey") % 103 == 0, F.lit(None)).otherwise(F.col("cents"))})
    return changed.unionByName(s.where("o_orderkey % 113 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (journal_events(spark, sf_dir).groupBy("receiver", F.floor((F.col("sequence") - 1) / 500).alias("slot"))
            .agg(F.min("sequence").alias("start_seq"), F.max("sequence").alias("end_seq"), F.count("*").alias("event_count"))
            .select(F.lit("ORDERS").alias("table_name"), "receiver", "start_seq", "end_seq", "event_count"))


def receipts_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = receipts(spark, sf_dir)
    return r.where("not (receiver = 'JRN2' and start_seq = 501)").unionByName(r.where("receiver = 'JRN9' and start_seq = 1"))


def receiver_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a receiver (a handful), with its place in time and the receiver before it."""
    c = journal_events(spark, sf_dir).groupBy("receiver").agg(
        F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"), F.min("commit_ts").alias("first_ts"), F.max("commit_ts").alias("last_ts"))
    w = Window.partitionBy(F.lit("JRN")).orderBy("first_ts")
    return c.select("*", F.row_number().over(w).cast("long").alias("ordinal"), F.lag("receiver").over(w).alias("previous"))


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where("attempt = 0 and source_file not like '%JRN5/batch-00001%'").groupBy("source_file").agg(F.count("*").alias("loaded"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = raw_events(spark, sf_dir).where("attempt = 0 and source_file not like '%SNAPSHOT/batch-00001%'").groupBy("source_file").agg(F.count("*").alias("declared"))
    return n.withColumn("declared", F.when(F.col("source_file").contains("00000"), F.col("declared") + 3).when(F.col("source_file").contains("00002"), F.lit(None)).otherwise(F.col("declared")))


def lag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", F.floor(micros("ts") / 1000000))
    first = F.min("s").over(Window.partitionBy("user_id"))
    return e.select(F.concat(F.lit("user-"), F.col("user_id")).alias("pipeline"), (F.col("s") - first).alias("elapsed_s"),
                    F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 5000).alias("lag"), F.col("event_id").alias("n"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("pipeline"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("n"), F.max(micros("ts")).alias("last_us"), F.sum(cents("value")).alias("cents"), F.max("event_id").alias("top"))


def slo_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, n = F.col("top"), F.col("n")
    return hourly(spark, sf_dir).select(
        "pipeline", "hour", F.when(n % 7 != 0, top % 200).alias("capture_age_s"), F.when(n % 5 != 0, top % 250).alias("raw_age_s"), (top % 400).alias("destination_age_s"),
        F.when(n % 11 != 0, top % 1500).alias("lag"), (top * 7 % 90).alias("p95_s"), (top * 11 % 250).alias("p99_s"), (n * 1000).alias("requests_24h"),
        (n % 14).alias("pending_files"), F.col("cents").alias("credits_cents"))


def metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("pipeline", "hour", F.when(F.col("n") % 17 != 0, F.col("cents")).alias("credits"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pipeline"), F.floor(micros("ts") / 300000000).alias("slot")).agg(
        F.count("*").alias("n"), F.max(micros("ts")).alias("at_us"))


def benchmark_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("solution"), F.col("l_quantity").cast("long").alias("elapsed_ms"), F.round("l_extendedprice").cast("long").alias("bytes"),
        F.col("l_linenumber").alias("lag"), F.lit("scope-1").alias("scope"),
        F.lit("print-1").alias("fingerprint"), F.col("l_quantity").cast("long").alias("cost_cents"))


def capture_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("n"), micros("ts").alias("at_us"), F.round("value").cast("long").alias("poll_ms"),
                    F.when(F.col("event_type") == "view", 0).otherwise(F.col("event_id") % 40).alias("events"), (F.col("event_id") % 9000).alias("bytes"),
                    F.count(F.when(F.col("event_type") == "error", 1)).over(upto).alias("errors_total"),
                    ((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0)).alias("rotated"))


def first_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("operation").isin("c", "d"), F.col("operation")).otherwise("u")
    return journal_events(spark, sf_dir).select(F.floor(micros("commit_ts") / 1000).alias("at_ms"), op.alias("op"), "receiver", "sequence", "n")


def second_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events an hour later, one in a hundred lost and one in a hundred doubled."""
    s = first_system(spark, sf_dir).withColumn("at_ms", F.col("at_ms") + 3600000)
    return s.where("n % 100 <> 0").unionByName(s.where("n % 100 = 1"))
