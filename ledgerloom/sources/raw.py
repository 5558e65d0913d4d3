"""Raw batches on storage: JSON-lines payloads with manifests, receipts, and their integrity.

Paths are anything that Spark reads; listing and content go through Spark's own sources.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENT = ("event_id string, receiver string, sequence long, operation string, commit_ts timestamp_ntz, ingested_at timestamp_ntz, source_file string, attempt int, "
         "before_key long, after_key long, cents long, event_type string, n long")
MANIFEST = "batch_id string, format_version string, event_count long, event_ids array<string>, high_watermark struct<receiver:string,sequence:long>, payload_sha256 string"
RECEIPT = ("format_version string, previous struct<receiver:string,sequence:long>, start struct<receiver:string,sequence:long>, `end` struct<receiver:string,sequence:long>, event_count long, "
           "raw struct<payload_key:string,payload_sha256:string>, scan_completed_at string")
FORMAT = "ledger-raw-v1"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the session names; a temporary one only where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-ledger-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder: lineage ends here and survives a lost executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Asks for the shuffle files of finished jobs to go now: Spark removes them once the driver's JVM happens to collect its
    garbage, and until then they fill the executors' disks.  Python lets go of JVM objects about a second after its own collection."""
    gc.collect()
    time.sleep(1.5)
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def bytes_under(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(root).getLength()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from Parquet in the shared folder: what reads them several times makes them once, and reads only the
    columns and row groups that it needs."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_of(size: int = 500) -> Column:
    return F.lpad(F.floor(F.col("sequence") / size).cast("string"), 6, "0")


def line(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def _refusal(c: dict[str, Column]) -> Column:
    """Why no batch may hold an event, if so."""
    empty = lambda x: x.isNull() | (F.trim(x) == "")
    return (F.when(empty(c["event_id"]), "no_id").when(empty(c["receiver"]), "no_receiver").when(c["sequence"].isNull(), "no_position").when(c["sequence"] < 0, "negative_position"))


def write_raw_batches(events: DataFrame, out: str, size: int = 500) -> int:
    """SRC-9: events once each, in position order, as one payload file per (table, receiver, batch), and then the
    manifests; gives the number of events.  A batch is one task's file, so it is in order; empty batches do not exist.

    Checks are part of the pass that writes: an event without id, receiver or position, an id at several positions or with
    several contents, or no event at all, is an error, and then there are no manifests.  Only whole copies are dropped.
    Manifests are read off the files, one file a row, so they say what storage holds; both passes count, and must agree."""
    content = [c for c in events.columns if c not in ("table_name", "attempt", "ingested_at", "source_file")]
    rest = [c for c in events.columns if c != "event_id"]
    digest, place = F.xxhash64(F.to_json(F.struct(*content), {"ignoreNullFields": "false"})), F.struct("receiver", "sequence")
    first = [F.col("ingested_at"), F.col("source_file")] if "ingested_at" in events.columns else []
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(first)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(rest)])
    once = events.groupBy("event_id").agg(F.min(packed).alias("row"), F.min(place).alias("p"), F.max(place).alias("q"), F.min(digest).alias("a"), F.max(digest).alias("b"))
    c = {"event_id": F.col("event_id")} | {x: F.col(f"row.v{i}") for i, x in enumerate(rest)}
    why = F.coalesce(_refusal(c), F.when(F.col("p") != F.col("q"), "several_positions").when(F.col("a") != F.col("b"), "several_contents"))
    checked = once.select(*[c[x].alias(x) for x in events.columns], why.alias("__why"))
    text = F.when(F.col("__why").isNull(), line([x for x in events.columns if x != "table_name"])).otherwise(
        F.raise_error(F.concat(F.lit("refused "), F.coalesce("event_id", F.lit("null")), F.lit(": "), F.col("__why"))))
    parts = ["table_name", "receiver_dir", "batch"]
    dealt = checked.select("table_name", F.regexp_replace("receiver", "[^A-Za-z0-9]", "_").alias("receiver_dir"), batch_of(size).alias("batch"), "sequence", "event_id", text.alias("value"))
    written = Observation()  # in the stage that writes, whose tasks count once each even if they run again
    rows = dealt.repartition(*parts).sortWithinPartitions(*parts, "sequence", "event_id")
    rows.select("value", *parts).observe(written, F.count("value").alias("n")).write.partitionBy(*parts).text(f"{out}/payload")
    if not written.get["n"]:
        raise ValueError("no event to write")
    spark = events.sparkSession
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{out}/payload")
    lines = F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != "")
    read = held.select(*[F.lpad(F.col(p).cast("string"), 6, "0").alias(p) if p == "batch" else F.col(p).cast("string").alias(p) for p in parts], F.sha2("content", 256).alias("payload_sha256"),
                       F.transform(lines, lambda x: F.from_json(x, "event_id string, receiver string, sequence long")).alias("e"))
    manifest = read.select(F.concat_ws("/", *parts).alias("batch_id"), F.lit(FORMAT).alias("format_version"), F.size("e").cast("long").alias("event_count"), F.col("e.event_id").alias("event_ids"),
                           F.element_at("e", -1).dropFields("event_id").alias("high_watermark"), "payload_sha256")
    # held back until both counts agree: a manifest says that its batch is whole
    manifest = cut(manifest)
    there = manifest.agg(F.sum("event_count")).first()[0]
    if there != written.get["n"]:
        raise ValueError(f"{written.get['n']} events went out, {there} are there")
    manifest.write.json(f"{out}/manifest")
    return int(written.get["n"])


def refused_events(events: DataFrame) -> DataFrame:
    """SRC-9: events that no batch may hold: without id, receiver or position, below position 0, or an id that stands at more
    than one position.  event_id, receiver, sequence, reason."""
    several = events.groupBy("event_id").agg(F.count_distinct("receiver", "sequence").alias("__places"))
    x = events.select("event_id", "receiver", "sequence").join(several, "event_id", "left")
    why = F.coalesce(_refusal({c: F.col(c) for c in ("event_id", "receiver", "sequence")}), F.when(F.col("__places") > 1, "several_positions"))
    return x.withColumn("reason", why).where("reason is not null").select("event_id", "receiver", "sequence", "reason").distinct()


def read_raw_events(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """SRC-1 and SRC-2: every line as an untyped payload with its batch, file, time and row number inside its
    file (files are in position order).  An explicit list must be free of repeats and of ways out."""
    if files is not None:
        if len(files) > 1000 or len(set(files)) != len(files) or any(".." in f or f.startswith("/") for f in files):
            raise ValueError("at most 1,000 different relative files")
    where = f"{path}/payload" if files is None else [f"{path}/payload/{f}" for f in files]
    rows = spark.read.option("basePath", f"{path}/payload").text(where)
    parsed = rows.select(F.concat_ws("/", "table_name", "receiver_dir", F.lpad(F.col("batch").cast("string"), 6, "0")).alias("batch_id"), F.parse_json("value").alias("payload"), "value",
                         F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("ingested_at"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")).alias("line_number"))
    order = Window.partitionBy("source_file").orderBy(F.expr("variant_get(payload, '$.sequence', 'long')"), F.expr("variant_get(payload, '$.event_id', 'string')"))
    return parsed.withColumn("source_row_number", F.row_number().over(order))


def project_envelope(raw: DataFrame) -> DataFrame:
    """PRJ-1: event_id, receiver, sequence and operation out of the payload."""
    get = lambda p, t: F.expr(f"variant_get(payload, '$.{p}', '{t}')")
    return raw.select("*", get("event_id", "string").alias("event_id"), get("receiver", "string").alias("receiver"), get("sequence", "long").alias("sequence"), get("operation", "string").alias("operation"))


def typed_events(raw: DataFrame, col: str = "value", *others: str) -> DataFrame:
    """The ledger's own columns of every line, and ``others`` as they are; decimals and times are read from their text."""
    return raw.select(F.from_json(col, EVENT, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("e"), *others).select("e.*", *others)


#: What a declared column may be (fixed values); decimals carry precision and scale.
KINDS = re.compile(r"string|smallint|integer|int|bigint|long|date|time|timestamp|binary|decimal\(\d{1,2},\d{1,2}\)")
TECHNICAL = ("_event_id", "_operation", "_receiver", "_sequence", "_commit_ts")


def typed_history(events: DataFrame, declared: dict[str, str], before: str = "before", after: str = "after") -> DataFrame:
    """PRJ-7: one typed row a change: the after-image, else the before-image (JSON text), cast to the declared columns (name:
    kind), and five technical columns.  Numbers are read from their text, so 38 digits survive; binary arrives as
    {type: bytes, encoding: base64, value}; a time is text HH:mm:ss; what cannot be cast is null.  Unknown kinds and names
    that clash with technical columns are refused."""
    bad = [k for k in declared.values() if not KINDS.fullmatch(k.replace(" ", ""))]
    clash = [c for c in declared if c in TECHNICAL]
    if bad or clash:
        raise ValueError(f"not supported: {bad + clash}")
    text = {c: "string" if k in ("time", "date", "timestamp") else "struct<type:string,encoding:string,value:string>" if k == "binary" else k for c, k in declared.items()}
    read = F.from_json(F.coalesce(after, before), ", ".join(f"`{c}` {k}" for c, k in text.items()))

    def typed(c: str, kind: str) -> Column:
        x = F.col("__image").getField(c)
        if kind == "binary":
            return F.when((x["type"] == "bytes") & (x["encoding"] == "base64"), F.try_to_binary(x["value"], F.lit("base64")))
        if kind == "time":
            return F.when(x.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), x)
        if kind == "date":
            return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))
        if kind == "timestamp":
            return F.try_to_timestamp(x).cast("timestamp_ntz")
        return x
    technical = [F.col(c.removeprefix("_")).alias(c) for c in TECHNICAL]
    return events.withColumn("__image", read).select(*technical, *[typed(c, k).alias(c) for c, k in declared.items()])


def with_rrn(image: Column, rrn: Column, operation: Column) -> tuple[Column, Column]:
    """PRJ-4: the image (map) with its record number; a delete without image keeps only that; other events
    without image are refused; a record number of 0 or less is unknown."""
    n = F.when(rrn > 0, rrn.cast("string"))
    own = F.create_map(F.lit("_rrn"), n)
    full = F.when(image.isNotNull(), F.map_concat(image, own)).when(operation == "d", own)
    return full, F.when(image.isNull() & (operation != "d"), "image_missing").when(image.isNotNull() & F.map_contains_key(F.coalesce(image, F.create_map().cast("map<string,string>")), "_rrn"), "reserved_name")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4."""
    return spark.read.schema(RECEIPT).json(path)


def journal_window(events: DataFrame, receiver: str, start: int, end: int, objects: list[str] | None = None, codes: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """SRC-5: a bounded window of one receiver; the predicates reach the scan."""
    if not 0 <= end - start < most:
        raise ValueError(f"a window spans 1 to {most} positions")
    w = events.where((F.col("receiver") == receiver) & F.col("sequence").between(start, end))
    w = w if objects is None else w.where(F.col("table_name").isin(objects))
    return w if codes is None else w.where(F.col("operation").isin(codes))


def key_ranges(least: int, most: int, parts: int) -> list[tuple[int, int, int]]:
    """SRC-7: contiguous (low, high, ordinal base) that cover every key of [least, most] once."""
    parts = max(1, min(parts, most - least + 1))
    cuts = [least + (most - least + 1) * i // parts for i in range(parts + 1)]
    return [(a, b - 1, a - 1) for a, b in zip(cuts, cuts[1:])]


def read_partitioned(table: DataFrame, column: str, least: int, most: int, parts: int) -> DataFrame:
    """SRC-7: the rows with the range they fall in and the ordinal base of it; one scan."""
    ranges = key_ranges(least, most, parts)
    bucket = F.width_bucket(F.col(column).cast("double"), F.lit(float(least)), F.lit(float(most + 1)), F.lit(len(ranges))) - 1
    # width_bucket's cuts are real numbers, the ranges' are whole: settle the edge
    highs = F.array(*[F.lit(r[1]) for r in ranges])
    lows = F.array(*[F.lit(r[0]) for r in ranges])
    b = bucket.cast("int")
    fixed = F.when(F.col(column) > F.element_at(highs, b + 1), b + 1).when(F.col(column) < F.element_at(lows, b + 1), b - 1).otherwise(b)
    return table.where(F.col(column).between(least, most)).withColumn("chunk", fixed).withColumn("ordinal_base", F.element_at(lows, F.col("chunk") + 1) - 1)


def latest_raw_object(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """SRC-8: newest payload file time, number of files and bytes, of all or only of those under listed folders or names (parts of
    a path); contents are not read, a listed name that is not there does not count."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/payload").select("path", "modificationTime", "length")
    if keys is not None:
        found = F.lit(False)
        for k in keys:
            found = found | F.contains("path", F.lit(f"/{k}/")) | F.endswith("path", F.lit(f"/{k}"))
        listed = listed.where(found)
    return listed.agg(F.max("modificationTime").alias("last_object_at"), F.count("*").alias("objects"), F.sum("length").alias("bytes"))


def batch_integrity(raw: DataFrame, manifests: DataFrame, size: int = 500) -> DataFrame:
    """CON-10: one row per batch and what is wrong with it, the first rule that fails: manifest or payload missing, format,
    receivers, the batch id that the positions give, order of the lines, count, ids, digest, watermark."""
    e = project_envelope(raw)
    # the id that the position gives, and lines that stand before a smaller position in their file
    derived = F.concat_ws("/", F.regexp_replace("receiver", "[^A-Za-z0-9]", "_"), batch_of(size))
    place = Window.partitionBy("source_file").orderBy("line_number")
    e = e.withColumns({"stray": ~F.endswith("batch_id", derived), "back": F.col("sequence") < F.lag("sequence").over(place)})
    order = F.array_sort(F.collect_list(F.struct("sequence", "event_id", "value")))
    per = e.groupBy("batch_id").agg(F.count("*").alias("n"), order.alias("o"), F.count_distinct("receiver").alias("receivers"), F.max("sequence").alias("last"), F.max("receiver").alias("receiver"),
                                      F.count_if("stray").alias("strays"), F.count_if("back").alias("unordered"))
    per = per.select("batch_id", "n", "receivers", "last", "receiver", "strays", "unordered", F.transform("o", lambda x: x["event_id"]).alias("ids"), F.sha2(F.concat(F.array_join(F.transform("o", lambda x: x["value"]), "\n"), F.lit("\n")), 256).alias("sha"))
    x = per.join(manifests.withColumn("__m", F.lit(1)), "batch_id", "full_outer")
    why = (F.when(F.col("__m").isNull(), "manifest_missing").when(F.col("n").isNull(), "payload_missing").when(F.col("format_version") != FORMAT, "format_unsupported").when(F.col("receivers") != 1, "several_receivers")
           .when(F.col("strays") > 0, "batch_id").when(F.col("unordered") > 0, "order").when(F.col("n") != F.col("event_count"), "event_count").when(~F.col("ids").eqNullSafe(F.col("event_ids")), "event_ids").when(F.col("sha") != F.col("payload_sha256"), "payload_sha256")
           .when((F.col("high_watermark.sequence") != F.col("last")) | (F.col("high_watermark.receiver") != F.col("receiver")), "watermark"))
    return x.select("batch_id", F.coalesce("n", F.lit(0)).alias("events"), why.alias("reason"))


def receipt_integrity(receipts: DataFrame, batches: DataFrame, events: DataFrame) -> DataFrame:
    """CON-11: receipts against their batch and events: digest, count, end and range; the first rule that
    fails.  receipts: receipt, batch_id, start_seq, end_seq, event_count, payload_sha256."""
    held = events.groupBy("batch_id").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count("*").alias("n"))
    b = batches.select("batch_id", F.col("payload_sha256").alias("b_sha"), F.col("event_count").alias("b_count"), F.col("high_watermark.sequence").alias("b_end"))
    x = receipts.join(b, "batch_id", "left").join(held, "batch_id", "left")
    why = (F.when(F.col("b_sha").isNull(), "batch_missing").when(F.col("payload_sha256") != F.col("b_sha"), "payload_sha256").when((F.col("event_count") != F.col("b_count")) | (F.col("event_count") != F.col("n")), "event_count")
           .when(F.col("end_seq") != F.col("b_end"), "end_is_not_watermark").when((F.col("lo") < F.col("start_seq")) | (F.col("hi") > F.col("end_seq")), "event_outside"))
    return x.select("receipt", why.alias("reason"))


def route_by_table(events: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-10: per-table counts of a combined window, and the events of tables that are not listed."""
    per = events.groupBy("table_name").agg(F.count("*").alias("events"), F.max("sequence").alias("last_sequence"))
    return per, events.join(allowed, "table_name", "left_anti")


def route_check(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """SRC-10: whether a combined window may be split: every event in a listed table, none lost; counts must sum."""
    listed = allowed.select("table_name", F.lit(1).alias("ok")).distinct()
    per = events.groupBy("table_name").agg(F.count("*").alias("n")).join(listed, "table_name", "left")
    a = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.sum(F.when(F.col("ok") == 1, F.col("n"))), F.lit(0)).alias("routed"), F.count_if(F.col("ok").isNull()).alias("unknown_tables"))
    return a.withColumn("verdict", F.when((F.col("events") == F.col("routed")) & (F.col("unknown_tables") == 0), "routed").otherwise("refused"))


def generate_changes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-14: deterministic changes of a table's own rows (a seed and three steps, chosen by key: updates with accents, padding,
    nulls and changed signs, deletes, and keys that come back) and the state they must lead to: the latest step of every
    key that was not deleted.  rows: key, label, amount."""
    k = F.col("key")

    def step(name: str, some: Column, op: str) -> DataFrame:
        return rows.where(some).select(k, F.lit(name).alias("step"), F.lit(op).alias("operation"), F.concat(F.lit("Libellé "), "label", F.lit(f" {name}")).alias("label"), F.rpad(F.concat(F.lit("C"), k), 8, " ").alias("code"),
                                       (F.col("amount") * F.when(k % 2 == 0, 1).otherwise(-1)).cast("decimal(15,2)").alias("amount"), F.when(k % 5 != 0, F.concat(F.lit("note "), k)).alias("note"))
    plan = [("0-seed", k % 4 != 3, "c"), ("1-changes", k % 4 == 3, "c"), ("1-changes", k % 10 == 1, "u_after"), ("1-changes", k % 20 == 0, "d"), ("2-changes", k % 60 == 0, "c"), ("2-changes", k % 30 == 1, "u_after"), ("3-changes", k % 50 == 1, "u_after")]
    events = None
    for p in plan:
        s = step(*p)
        events = s if events is None else events.unionByName(s)
    last = events.groupBy("key").agg(F.max(F.struct("step", F.when(F.col("operation") == "c", 0).otherwise(1).alias("o"), "operation", "label", "code", "amount", "note")).alias("x")).where("x.operation <> 'd'")
    return events, last.select("key", "x.step", "x.label", "x.code", "x.amount", "x.note")


def receipt_chain(receipts: DataFrame) -> DataFrame:
    """REP-4: receipts in chain order by doubling their ``previous`` links: start of the chain, distance from it, and what is
    wrong (fork, several_roots, cycle, unreachable).  A chain of n receipts takes about log2(n) joins, each cut by a
    checkpoint, and the rounds end where all have found their root or nothing moves on.
    receipts: receipt, end_key, previous_key (null: root)."""
    r = cut(receipts.select("receipt", "end_key", "previous_key"))
    forks = r.where("previous_key is not null").groupBy("previous_key").agg(F.count("*").alias("c")).where("c > 1")
    roots = r.where("previous_key is null").agg(F.count("*").alias("roots"))
    jump = r.select("receipt", F.col("previous_key").alias("to"), F.when(F.col("previous_key").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("end_key").alias("key"))
    total, bound, before = r.count(), 1, None
    while True:
        now = jump.agg(F.count("to"), F.sum("steps")).first()
        if not now[0] or now == before or bound > 2 * total:
            break
        nxt = jump.groupBy(F.col("key").alias("to")).agg(F.min(F.struct(F.col("to").alias("far"), F.col("steps").alias("more"))).alias("n"))
        far = F.when(F.col("n").isNull(), F.col("to")).otherwise(F.col("n.far"))
        jump = cut(jump.where("to is not null").join(nxt, "to", "left").select("receipt", far.alias("to"), (F.col("steps") + F.coalesce("n.more", F.lit(0))).alias("steps"), "key").unionByName(jump.where("to is null")))
        before, bound = now, bound * 2
    ends = r.select(F.col("end_key").alias("to"), F.lit(True).alias("loops")).distinct()
    x = (jump.join(r.select("receipt", "previous_key"), "receipt").join(forks.select("previous_key", F.lit(True).alias("fork")), "previous_key", "left")
         .join(ends, "to", "left").crossJoin(roots))  # one row
    why = (F.when(F.col("to").isNotNull() & F.col("loops"), "cycle").when(F.col("to").isNotNull(), "unreachable").when(F.col("fork"), "fork").when(F.col("roots") != 1, "several_roots"))
    return x.select("receipt", F.when(F.col("to").isNull(), F.col("steps")).alias("place"), why.alias("reason"))


def pending_receipts(receipts: DataFrame, cursor: tuple[str, int] | None) -> DataFrame:
    """REP-4: what is to be read after a cursor: the chain from the receipt whose ``previous`` is the cursor; else from a root
    that starts right behind it; else from the one receipt that covers it (a copy's boundary may lie inside a window).
    Several covering receipts and a hole right after the boundary are refused, without a cursor the whole chain is pending.
    receipts: receipt, receiver, start_seq, end_seq, previous_receiver, previous_seq.  receipt, place, reason."""
    name = lambda a, b: F.when(F.col(a).isNotNull(), F.concat_ws(":", a, F.col(b).cast("string")))
    keyed = receipts.select("receipt", "receiver", "start_seq", "end_seq", name("receiver", "end_seq").alias("end_key"), name("previous_receiver", "previous_seq").alias("previous_key"))
    chain = cut(receipt_chain(keyed).join(keyed.drop("end_key"), "receipt"))
    if cursor is None:
        return chain.select("receipt", "place", "reason")
    receiver, sequence = cursor
    here = F.col("receiver") == receiver
    follows = F.col("previous_key") == f"{receiver}:{sequence}"
    behind = F.col("previous_key").isNull() & here & (F.col("start_seq") == sequence + 1)
    covers = here & (F.col("start_seq") <= sequence) & (F.col("end_seq") > sequence)
    first = chain.agg(F.min(F.when(follows, F.col("place"))).alias("a"), F.min(F.when(behind, F.col("place"))).alias("b"), F.min(F.when(covers, F.col("place"))).alias("c"),
                      F.count_if(covers).alias("covering"), F.count_if(here & (F.col("start_seq") > sequence + 1)).alias("beyond"))
    known = F.coalesce("a", "b")
    start = F.coalesce(known, F.when(F.col("covering") == 1, F.col("c")))
    why = F.when(known.isNull() & (F.col("covering") > 1), "several_cover_the_boundary").when(start.isNull() & (F.col("beyond") > 0), "hole_after_boundary")
    x = chain.crossJoin(first.select(start.alias("start"), why.alias("why")))  # one row
    return x.where("place >= start or why is not null or reason is not null").select("receipt", (F.col("place") - F.col("start")).alias("place"), F.coalesce("reason", "why").alias("reason"))
