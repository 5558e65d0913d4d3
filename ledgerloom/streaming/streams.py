"""Structured Streaming over raw files, receipts, samples and checks.

State lives in Spark's own state store (RocksDB with changelog checkpoints), so a micro-batch reads and writes the keys it
holds and no others, and a batch that runs again after a crash leaves the same state.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators import ledger as L
from ..sources.raw import EVENT, cut, line, typed_events
from ..sources.versions import BatchedTable, BucketTable

MIRROR = "k long, cents long, event_type string, event_id string, receiver string, sequence long, commit_ts timestamp_ntz"
#: What makes two events with one id the same event
CONTENT = ("receiver", "sequence", "operation", "before_key", "after_key", "cents", "event_type")
EVENT_COLUMNS = [f.split()[0] for f in EVENT.split(", ")]
JUDGED = f"{EVENT}, verdict string"
VERDICT = "line string, verdict string"
#: Slots that ids are dealt over; a batch reads and writes the slots of its ids
SLOTS = 16384
#: Hex digits that name an id in its slot (128 bits of its SHA-256), and those of a content's digest
ID, DIGEST = 32, 64
#: Ids up to which a slot is one value, written anew by each batch that adds to it; to a larger one a batch adds a part with
#: its own ids only, and so many parts become one value again
WHOLE, PARTS = 256, 32
#: Bytes of files, as they are stored, that a micro-batch of the ledger takes: compressed lines, and rows of history
SIZE, HISTORY_SIZE = 1 << 28, 1 << 28
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _named(schema: str) -> Row:
    """Makes rows of a schema from their values."""
    return Row(*[f.split()[0] for f in schema.split(", ")])


def rocksdb(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB and checkpoint its changes only; digests in hex shrink to about half."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.compression.codec", "zstd")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.compression", "zstd")


def lines(spark: SparkSession, path: str, files: int = 100, size: int | None = None) -> DataFrame:
    """The stream of raw lines under a folder; a micro-batch takes so many files, or files of about so many bytes."""
    stream = spark.readStream.option("recursiveFileLookup", "true")
    stream = stream.option("maxFilesPerTrigger", files) if size is None else stream.option("maxBytesPerTrigger", size)
    return stream.text(f"{path}/payload")


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, size: int = 1 << 30) -> None:
    """STR-1: new files' lines appended to the raw table, each once; returns when all there are have been read.  Nothing is kept
    between micro-batches, so bytes bound them: by files, many small ones would make as many batches."""
    q = lines(spark, path, size=size).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()


def dedupe_within(events: DataFrame, horizon: str = "3 days") -> DataFrame:
    """STR-2 with bounded state: one copy of an id whose copies arrive within the horizon of event time."""
    return events.withColumn("__t", F.col("ingested_at").cast("timestamp")).withWatermark("__t", horizon).dropDuplicatesWithinWatermark(["event_id"]).drop("__t")


class Judge(StatefulProcessor):
    """STR-6: by slot of ids, the digests of the contents that its ids first came with.  Python is called once a slot and batch and
    not once an id, and sees an event as a line with its id's hash and its place.  A large slot grows by parts, so that what many
    batches write is about what they add and not each time all that there is.  With a horizon a slot is one id, which
    is forgotten once event time has passed its last event by that much."""

    def __init__(self, horizon_ms: int | None = None) -> None:
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.content = handle.getValueState("content", "ids string, digest string, due long")
        self.added = handle.getListState("added", "ids string, digest string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, row = self.content.get(), _named(VERDICT)
        ids, digests, due = tuple(held) if held else ("", "", None)
        parts = [tuple(p) for p in self.added.get()] if len(ids) >= ID * WHOLE else []
        known = {i[ID * k:ID * k + ID]: d[DIGEST * k:DIGEST * k + DIGEST] for i, d in [(ids, digests), *parts] for k in range(len(i) // ID)}
        before, newest = len(known), 0
        for r in sorted(rows, key=lambda r: r.place):
            newest, digest = max(newest, r.at_ms), r.place[-DIGEST:]
            first = known.setdefault(r.id, None)
            if first is None:
                known[r.id] = digest
                yield row(r.line, "accepted")
            elif first != digest:
                yield row(r.line, "refused")
        if self.horizon_ms is not None:
            later = newest + self.horizon_ms
            if due is not None and later <= due:
                return
            if due is not None:
                self.handle.deleteTimer(due)
            due = later
            self.handle.registerTimer(due)
        elif len(known) == before:
            return
        elif before >= WHOLE and len(parts) < PARTS:
            self.added.appendValue(("".join(islice(known, before, None)), "".join(islice(known.values(), before, None))))
            return
        self.content.update(("".join(known), "".join(known.values()), due))
        if parts:
            self.added.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.content.clear()
        return iter(())

    def close(self) -> None:
        pass


def judged(events: DataFrame, horizon_s: int | None = None, run: str | None = None, boundary: tuple[str, int] | None = None) -> DataFrame:
    """STR-2 and STR-6: of each id its first event, accepted, or fenced if it is of another snapshot than ``run`` or lies at or
    before that one's boundary; and every event that comes with another content, refused.  Replays are dropped.  State: an
    id's hash and a digest in the id's slot, for good or, with a horizon, as long as ingestion time has not passed them by it; then events that were
    ingested longer than that before the newest are not looked at."""
    digest = F.sha2(F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"}), 256)
    fenced = F.lit(False) if run is None else L.is_snapshot() & (F.col("receiver") != f"{L.SNAPSHOT}{run}")
    if boundary is not None:
        fenced = fenced | ((F.col("receiver") == boundary[0]) & (F.col("sequence") <= boundary[1]))
    at, name = F.col("ingested_at").cast("timestamp"), F.sha2(F.coalesce("event_id", F.lit("")), 256)
    slot = name if horizon_s is not None else F.pmod(F.xxhash64("event_id"), F.lit(SLOTS)).cast("string")
    place = F.concat(F.format_string("%020d", F.coalesce(F.unix_micros(at), F.lit(0)) + 2 ** 62), F.coalesce("source_file", F.lit("")), F.lit("\x01"), digest)
    rows = events.select(slot.alias("slot"), F.substring(name, 1, ID).alias("id"), place.alias("place"), line(EVENT_COLUMNS).alias("line"), F.coalesce(F.unix_millis(at), F.lit(0)).alias("at_ms"), at.alias("at"))
    rows = rows.drop("at") if horizon_s is None else rows.withWatermark("at", f"{horizon_s} seconds")
    told = rows.groupBy("slot").transformWithState(Judge(None if horizon_s is None else horizon_s * 1000), VERDICT, "Append", "None" if horizon_s is None else "EventTime")
    verdict = F.when((F.col("verdict") == "accepted") & F.coalesce(fenced, F.lit(False)), "fenced").otherwise(F.col("verdict"))
    return typed_events(told, "line", "verdict").withColumn("verdict", verdict)


class LedgerStream:
    """STR-2 to STR-6 and STR-10.  ``run`` is two streams, one after the other, each with its own checkpoint: raw lines are
    judged and added to history, batch by batch; then history's accepted events advance the mirror.  If the second dies,
    the next run goes on where it stopped, so history is never ahead for good.

    The mirror is the second stream's state: per key and receiver the winning operation.  A batch touches the state of its
    own keys; late files and replays need no special way, as a winner is a maximum; and an order of receivers that turns
    out another way changes no state, as keys are resolved over their receivers when the mirror is read.

    A snapshot opens an epoch.  Rows of older epochs stay in history and never win: each epoch has a folder of history and a
    mirror of its own, which starts with the snapshot's rows.  Journal events that come later count if they lie past the
    boundary; what receivers are known, and since when, is carried over.  The epoch is open once its record is written, after
    its rows, so a snapshot that dies before is simply taken again, and its mirror advances with the next run otherwise."""

    def __init__(self, spark: SparkSession, folder: str, horizon_s: int | None = None) -> None:
        self.spark, self.folder, self.horizon_s = spark, folder.rstrip("/"), horizon_s
        self.epochs = BatchedTable(spark, f"{self.folder}/epochs", "epoch long, run string, receiver string, sequence long")
        self.carried = BatchedTable(spark, f"{self.folder}/carried", "receiver string, commit_ts timestamp_ntz, epoch long")
        self.last: list = []  # progress of the mirror's batches in this session, for reports

    def epoch(self) -> tuple[int, str | None, tuple[str, int] | None]:
        """The open epoch, its snapshot's run and its boundary."""
        now = self.epochs.read().agg(F.max(F.struct("epoch", "run", "receiver", "sequence")).alias("e")).first().e
        return (now.epoch, now.run, None if now.receiver is None else (now.receiver, now.sequence)) if now else (0, None, None)

    def _rows(self, epoch: int) -> BatchedTable:
        return BatchedTable(self.spark, f"{self.folder}/history/epoch={epoch}", JUDGED)

    def judgements(self) -> DataFrame:
        """All events that ever came, but for replays, with their epoch and verdict."""
        parts = [self._rows(e).read().withColumn("epoch", F.lit(e).cast("long")) for e in range(self.epoch()[0] + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def history(self) -> DataFrame:
        """Accepted and fenced events, each once."""
        return L.dedupe_first(self.judgements().where("verdict <> 'refused'").drop("verdict", "epoch"))

    def rejects(self) -> DataFrame:
        return self.judgements().where("verdict = 'refused'")

    def run(self, path: str, size: int = SIZE) -> None:
        """Reads all files there are in micro-batches of about so many bytes, and returns."""
        rocksdb(self.spark)
        number, snapshot, boundary = self.epoch()
        stream = judged(typed_events(lines(self.spark, path, size=size)), self.horizon_s, snapshot, boundary)
        out = self._rows(number)
        q = stream.writeStream.foreachBatch(self._then_free(out.write)).outputMode("append").option("checkpointLocation", f"{self.folder}/judge").trigger(availableNow=True).start()
        q.awaitTermination()
        self._advance(number)

    def _then_free(self, write):
        """What a batch does with its rows.  Python and the driver's JVM then collect their garbage, as only this lets go of the shuffle
        files of the batches before; else those of all batches would stay."""
        def batch(rows: DataFrame, number: int) -> None:
            write(rows, number)
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

        return batch

    def _advance(self, epoch: int) -> None:
        rows = self._rows(epoch)
        if not rows.read().limit(1).count():
            return
        live = self.spark.readStream.schema(JUDGED).option("recursiveFileLookup", "true").option("maxBytesPerTrigger", HISTORY_SIZE).parquet(rows.path)
        won = L.winners_by_receiver(live.where("verdict = 'accepted'").drop("verdict"))
        q = (won.writeStream.outputMode("update").foreachBatch(self._then_free(lambda rows, _: rows.write.format("noop").mode("overwrite").save()))
             .option("checkpointLocation", f"{self.folder}/mirror-{epoch}").trigger(availableNow=True).start())
        q.awaitTermination()
        self.last = q.recentProgress

    def _state(self, epoch: int) -> DataFrame:
        """k, receiver, won, first_ts as the state store holds them."""
        state = self.spark.read.format("statestore").load(f"{self.folder}/mirror-{epoch}")
        won, first = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
        key = [f"key.`{f.name}`" for f in state.schema["key"].dataType.fields]
        return state.select(F.col(key[0]).alias("k"), F.col(key[1]).alias("receiver"), F.col(won).alias("won"), F.col(first).alias("first_ts"))

    def _started(self, epoch: int) -> bool:
        return self.epochs.exists(f"{self.folder}/mirror-{epoch}/state")

    def winners(self) -> DataFrame:
        """``STATE`` of the open epoch, one row a key and receiver."""
        epoch = self.epoch()[0]
        if not self._started(epoch):
            return self.spark.createDataFrame([], L.STATE)
        s = self._state(epoch).where("k is not null").select("k", "receiver", "won.*")
        return s.select(*L.STATE_COLUMNS)

    def receivers(self) -> DataFrame:
        """receiver, commit_ts: the first commit known of each; one row a receiver and epoch."""
        epoch = self.epoch()[0]
        known = self.carried.read(without=epoch + 1).where(F.col("epoch") == epoch).drop("epoch")
        if self._started(epoch):
            known = known.unionByName(self._state(epoch).where("k is null").select("receiver", F.col("first_ts").alias("commit_ts")))
        return known

    def mirror(self) -> DataFrame:
        won = L.resolve(self.winners(), L.receiver_ranks(self.receivers()))
        return won.where("kind = 'upsert'").select(*[c.split()[0] for c in MIRROR.split(", ")])

    def snapshot(self, events: DataFrame, run: str, boundary: tuple[str, int] | None = None) -> int:
        """STR-5: a snapshot run opens the next epoch, and its rows are the mirror that the epoch starts with."""
        rocksdb(self.spark)
        number = self.epoch()[0] + 1
        s = events.where(F.col("receiver") == f"{L.SNAPSHOT}{run}").withColumn("verdict", F.lit("accepted"))
        self.carried.write(self.receivers().withColumn("epoch", F.lit(number).cast("long")), number)
        self._rows(number).write(s.select(*[f.split()[0] for f in JUDGED.split(", ")]), -1)
        self.epochs.write(self.spark.createDataFrame([(number, run, *(boundary or (None, None)))], self.epochs.schema), number)
        self._advance(number)
        return number

    def positions(self) -> DataFrame:
        """STR-10: last committed position of each table, for reporting; resuming is the checkpoint's matter."""
        return positions(self.history())


def positions(history: DataFrame) -> DataFrame:
    """STR-10: table_name, receiver, sequence of the last event of each table."""
    ranked = history.join(F.broadcast(L.receiver_ranks(history)), "receiver", "left").withColumn("table_name", F.split("source_file", "/")[1])
    return ranked.groupBy("table_name").agg(F.max(F.struct(F.coalesce("receiver_rank", F.lit(-1)).alias("r"), "sequence", "receiver")).alias("x")).select("table_name", "x.receiver", "x.sequence")


class Winners(BucketTable):
    """Winning operations by key and receiver, in buckets of the key."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, L.STATE, "k")


class IncrementalReplay:
    """REP-2 with its state: winners by bucket of the key, and the ingestion-time watermark that the last finished run left.
    The watermark is written last, so a run that dies is simply run again.  Winners are kept by receiver: when receivers
    turn out to stand in another order, only what is read changes, and no key is replayed."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.winners = Winners(spark, f"{folder}/winners")
        self.marks = BatchedTable(spark, f"{folder}/marks", "run long, ingested_at timestamp_ntz")
        self.receivers = BatchedTable(spark, f"{folder}/receivers", "receiver string, commit_ts timestamp_ntz")

    def last(self) -> tuple[int, object]:
        """Number and watermark of the last finished run."""
        mark = self.marks.read().agg(F.max(F.struct("run", "ingested_at")).alias("m")).first().m
        return (mark.run, mark.ingested_at) if mark else (0, None)

    def run(self, ledger: DataFrame) -> DataFrame:
        """The mirror after all events of the ledger; only those ingested past the watermark count.  They are read three times, a few
        columns twice and all once, and not held in memory: a ledger that is dear to make should be stored (``raw.stored``)."""
        run, mark = self.last()
        changed = ledger if mark is None else ledger.where(F.col("ingested_at") > F.lit(mark))
        seen = cut(changed.groupBy("receiver").agg(F.min("commit_ts").alias("commit_ts"), F.max("ingested_at").alias("high")))  # one row a receiver
        high = seen.agg(F.max("high")).first()[0]
        if high is not None:
            self.receivers.write(seen.select("receiver", "commit_ts"), run + 1)
            keys = changed.select(F.explode(F.array("before_key", "after_key")).alias("k")).where("k is not null")
            touched = keys.select(self.winners.bucket().alias("b")).distinct().collect()  # at most the buckets; keys need not be told apart
            self.winners.write(L.advance(self.winners.rows(only={r.b for r in touched}, before=run + 1), changed), run + 1)
            self.marks.write(changed.sparkSession.createDataFrame([(run + 1, high)], self.marks.schema), run + 1)
        won = L.resolve(self.winners.rows(), L.receiver_ranks(self.receivers.read()))
        return won.where("kind = 'upsert'").select(*[c.split()[0] for c in MIRROR.split(", ")])


# -- windows that close on data ---------------------------------------------------------------------

WINDOW_OUT = "stream string, window_no long, start_us long, close_us long, receipts long, events long, state string"


def close_windows(stream: str, receipts: pd.DataFrame, duration_us: int, grace_us: int, state: tuple | None) -> tuple[list[tuple], tuple | None]:
    """STR-7: a window closes at the first scan that ends at or after start + duration; later than the grace it
    is ``late``.  The next starts at that close.  state: (window_no, start, receipts, events)."""
    out = []
    for t, n in zip(receipts["at_us"].tolist(), receipts["event_count"].tolist()):
        if state is None:
            state = (0, t, 0, 0)
        no, start, k, e = state
        k, e = k + 1, e + n
        if t >= start + duration_us:
            out.append((stream, no, start, t, k, e, "closed" if t <= start + duration_us + grace_us else "late"))
            state = (no + 1, t, 0, 0)
        else:
            state = (no, start, k, e)
    return out, state


def proof_windows(receipts: DataFrame, duration_s: int, grace_s: int) -> DataFrame:
    """STR-7 in batch: receipts (stream, at_us, event_count); one group a stream, whose rows are one short row a
    scan.  The window still open comes last, with state ``open``."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, state = close_windows(key[0], pdf.sort_values(["at_us", "event_count"]), duration_s * 1000000, grace_s * 1000000, None)
        if state and state[2]:
            rows.append((key[0], state[0], state[1], None, state[2], state[3], "open"))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOW_OUT.split(", ")]).astype({"close_us": "Int64"})

    return receipts.groupBy("stream").applyInPandas(run, WINDOW_OUT)


def chained(scans: DataFrame) -> DataFrame:
    """STR-7: scans (stream, at_us, previous_us: null for the first) with the reason that they break their stream's chain for,
    if any: a loop (linked to itself or to a later one), an unknown predecessor (a moment at which there was no scan), or a
    gap (linked to another than the one before, or to none)."""
    w = Window.partitionBy("stream").orderBy("at_us")
    there = scans.select("stream", F.col("at_us").alias("previous_us"), F.lit(True).alias("__there")).distinct()
    x = scans.withColumn("__before", F.lag("at_us").over(w)).join(there, ["stream", "previous_us"], "left")
    why = (F.when(F.col("previous_us") >= F.col("at_us"), "loop").when(F.col("previous_us").isNotNull() & F.col("__there").isNull(), "unknown_predecessor")
           .when(~F.col("previous_us").eqNullSafe(F.col("__before")), "gap"))
    return x.select(*scans.columns, why.alias("reason"))


def refused_scans(scans: DataFrame) -> DataFrame:
    """STR-7: stream, at_us, reason of the scans that break their stream's chain."""
    return chained(scans).where("reason is not null").select("stream", "at_us", "reason")


WINDOWS_LIVE = f"{WINDOW_OUT}, at_us long, reason string"


class ProofWindows(StatefulProcessor):
    """STR-7 live: the open window, the moments of all scans so far, and a timer at the end of the window's grace."""

    def __init__(self, duration_us: int, grace_us: int) -> None:
        self.duration_us, self.grace_us = duration_us, grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "window_no long, start_us long, receipts long, events long")
        self.last = handle.getValueState("last", "at_us long")
        self.scans = handle.getMapState("scans", "at_us long", "event_count long")

    def _due(self, start_us: int) -> int:
        return -(-(start_us + self.duration_us + self.grace_us) // 1000) + 1

    def _reason(self, r: Row, before: int | None) -> str | None:
        if r.previous_us is not None and r.previous_us >= r.at_us:
            return "loop"
        if r.previous_us is not None and not self.scans.containsKey((r.previous_us,)):
            return "unknown_predecessor"
        return None if r.previous_us == before else "gap"

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, row = self.last.get(), _named(WINDOWS_LIVE)
        before = last[0] if last else None
        state = self.window.get()
        state = tuple(state) if state else None
        opened = state and state[1]
        for r in sorted(rows, key=lambda r: (r.at_us, r.event_count)):
            reason = self._reason(r, before)
            self.scans.updateValue((r.at_us,), (r.event_count,))
            before = r.at_us
            if reason:
                yield row(key[0], None, None, None, None, r.event_count, "refused", r.at_us, reason)
                continue
            closed, state = close_windows(key[0], pd.DataFrame({"at_us": [r.at_us], "event_count": [r.event_count]}), self.duration_us, self.grace_us, state)
            for w in closed:
                yield row(*w, r.at_us, None)
        if before is not None:
            self.last.update((before,))
        if state is not None:
            self.window.update(state)
            if state[1] != opened:
                if opened is not None:
                    self.handle.deleteTimer(self._due(opened))
                self.handle.registerTimer(self._due(state[1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """No scan has ended the window within its grace: it is reported, and stays open for the scan that ends it late."""
        state = self.window.get()
        if state and self._due(state[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            yield _named(WINDOWS_LIVE)(key[0], state[0], state[1], None, state[2], state[3], "overdue", state[1] + self.duration_us + self.grace_us, None)

    def close(self) -> None:
        pass


def proof_window_stream(scans: DataFrame, duration_s: int, grace_s: int, late: str = "0 seconds") -> DataFrame:
    """STR-7 live: closed and late windows, scans refused for their chain (they count in no window), and windows overdue by the
    watermark, which trails event time by ``late``.  scans: stream, at_us, previous_us, event_count."""
    timed = scans.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return timed.groupBy("stream").transformWithState(ProofWindows(duration_s * 1000000, grace_s * 1000000), WINDOWS_LIVE, "Append", "EventTime")


def lag_stream(samples: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """STR-8: least, most, samples and unknown samples of event-time windows.  samples: pipeline, at, lag."""
    return (samples.withWatermark("at", late).groupBy("pipeline", F.window("at", width).alias("w"))
            .agg(F.min("lag").alias("least"), F.max("lag").alias("most"), F.count("*").alias("samples"), F.count_if(F.col("lag").isNull()).alias("unknown")).select("pipeline", F.col("w.start").alias("start"), "least", "most", "samples", "unknown"))


ALERT_OUT = "pipeline string, check string, at_us long, event string, occurrence long, evaluations long, before double, observed double"


class Alerts(StatefulProcessor):
    """STR-9: by (pipeline, check) the last report that observed it and what has been counted so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "last long, status string, observed double, occurrence long, evaluations long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, row = self.state.get(), _named(ALERT_OUT)
        last, status, observed, occurrence, evaluations = tuple(held) if held else (None, None, None, 0, 0)
        for r in sorted(rows, key=lambda r: r.at_us):
            if last is not None and r.at_us <= last:  # the same instant is idempotent, or a contradiction
                if r.at_us < last or (r.status, r.observed) != (status, observed):
                    yield row(*key, r.at_us, "refused_older" if r.at_us < last else "refused_conflict", occurrence, evaluations, None, r.observed)
                continue
            if r.status not in ("breach", "pass"):
                continue
            event = None
            if r.status == "breach":
                evaluations += 1
                occurrence += status != "breach"
                event = ("opened" if occurrence == 1 else "reopened") if status != "breach" else "changed" if r.observed != observed else None
            elif status == "breach":
                event = "resolved"
            if event:
                yield row(*key, r.at_us, event, occurrence, evaluations, observed if event == "changed" else None, r.observed)
            last, status, observed = r.at_us, r.status, r.observed
        if last is not None:
            self.state.update((last, status, observed, occurrence, evaluations))

    def close(self) -> None:
        pass


def alert_stream(checks: DataFrame) -> DataFrame:
    """STR-9: WIN-16 live per (pipeline, check), with what changed while it was firing; a report older than the last, or another
    one of the same instant, is refused as a row of its own; an unobserved check changes nothing.
    checks: pipeline, check, at_us, status, observed."""
    rows = checks.select("pipeline", "check", "at_us", "status", F.col("observed").cast("double").alias("observed"))
    return rows.groupBy("pipeline", "check").transformWithState(Alerts(), ALERT_OUT, "Append", "None")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is into Parquet, and returns."""
    rocksdb(stream.sparkSession)
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
