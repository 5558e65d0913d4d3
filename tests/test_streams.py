"""Streams whose state is Spark's own: mirror, epochs, conflicts, proof windows and alerts, on several micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.operators import sequences as S
from ledgerloom.plans.stream_queries import deliver
from ledgerloom.sources.raw import EVENT
from ledgerloom.streaming import streams as T

START = datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (minute, receiver, sequence, operation, before_key, after_key[, cents])"""
    made = [(f"{r[1]}-{r[2]}", r[1], r[2], r[3], START + timedelta(minutes=r[0]), START + timedelta(minutes=r[0]), "raw/T/f", 0, r[4], r[5], r[6] if len(r) > 6 else r[2], "x", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, EVENT)


def state(df):
    return {r.k: r.cents for r in df.collect()}


@pytest.fixture
def stream(spark, tmp_path):
    s = T.LedgerStream(spark, f"file://{tmp_path}/t")
    s.inbox = f"file://{tmp_path}/in"
    s.deliver = lambda rows: s.run(deliver(events(spark, rows), s.inbox))
    return s


def test_replays_change_nothing(spark, stream):
    second = [(2, "A", 3, "d", 1, None), (3, "A", 4, "u_after", None, 2)]
    stream.deliver([(0, "A", 1, "c", None, 1), (1, "A", 2, "c", None, 2)])
    stream.deliver(second)
    want = state(stream.mirror())
    stream.deliver(second)
    assert state(stream.mirror()) == want == {2: 4} and stream.history().count() == 4


def test_a_mirror_that_was_left_behind_catches_up(spark, stream, monkeypatch):
    stream.deliver([(0, "A", 1, "c", None, 1)])
    with monkeypatch.context() as m:
        m.setattr(stream, "_advance", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            stream.deliver([(1, "A", 2, "u_after", None, 1)])
    assert stream.history().count() == 2 and state(stream.mirror()) == {1: 1}
    stream.run(stream.inbox)  # nothing new to judge
    assert state(stream.mirror()) == {1: 2}


def test_a_batch_writes_the_state_of_its_keys(spark, stream):
    stream.deliver([(0, "A", i, "c", None, i) for i in range(1, 2001)])
    stream.deliver([(5, "A", 5000 + i, "u_after", None, 7 * i + 1) for i in range(20)])
    touched = sum(p["stateOperators"][0]["numRowsUpdated"] for p in stream.last)
    assert touched == 21 and stream.last[-1]["stateOperators"][0]["numRowsTotal"] == 2001  # keys, and the receiver
    assert "RocksDB" in str(stream.last[-1]["stateOperators"][0]["customMetrics"].keys() and spark.conf.get("spark.sql.streaming.stateStore.providerClass"))
    assert state(stream.mirror())[8] == 5001


def test_late_and_mixed_receivers_equal_the_full_replay(spark, stream):
    rows = [(10, "A", 1, "c", None, 1), (20, "B", 1, "u_after", None, 1), (0, "B", 0, "c", None, 9), (30, "C", 1, "u", 9, 10), (31, "C", 2, "d", 1, None), (12, "A", 2, "u_after", None, 1)]
    for i in range(len(rows)):
        stream.deliver(rows[i:i + 1])
        assert state(stream.mirror()) == state(L.replay_full(events(spark, rows[:i + 1])))


def test_conflicts_are_refused_and_the_first_content_stays(spark, stream):
    stream.deliver([(0, "A", 1, "c", None, 1, 5)])
    stream.deliver([(1, "A", 1, "c", None, 1, 99), (2, "A", 2, "c", None, 2, 6), (3, "A", 2, "c", None, 2, 7)])
    stream.deliver([(4, "A", 1, "c", None, 1, 99), (5, "A", 1, "c", None, 1, 5)])
    assert sorted((r.event_id, r.cents) for r in stream.rejects().collect()) == [("A-1", 99), ("A-1", 99), ("A-2", 7)]
    assert {r.event_id: r.cents for r in stream.history().collect()} == {"A-1": 5, "A-2": 6} and state(stream.mirror()) == {1: 5, 2: 6}


def test_a_snapshot_after_batches_opens_an_epoch(spark, stream):
    stream.deliver([(0, "A", 1, "c", None, 1, 5), (1, "A", 2, "c", None, 2, 5)])
    assert stream.snapshot(events(spark, [(2, "SNAPSHOT:R1", 1, "c", None, 1, 70)]), "R1", ("A", 3)) == 1
    assert state(stream.mirror()) == {1: 70}
    stream.deliver([(3, "A", 3, "u_after", None, 1, 6), (4, "A", 4, "c", None, 4, 8), (0, "A", 1, "c", None, 1, 5)])
    assert state(stream.mirror()) == {1: 70, 4: 8}  # 3 lies at the boundary, 1 is a replay
    assert {r.event_id: (r.epoch, r.verdict) for r in stream.judgements().collect()} == {
        "A-1": (0, "accepted"), "A-2": (0, "accepted"), "SNAPSHOT:R1-1": (1, "accepted"), "A-3": (1, "fenced"), "A-4": (1, "accepted")}
    stream.snapshot(events(spark, [(9, "SNAPSHOT:R2", 1, "c", None, 2, 90)]), "R2")
    stream.deliver([(8, "SNAPSHOT:R1", 2, "c", None, 5, 1), (10, "B", 1, "c", None, 6, 3)])
    assert state(stream.mirror()) == {2: 90, 6: 3}  # rows of the older snapshot are fenced
    assert stream.history().count() == 8


def test_receivers_keep_their_order_over_epochs(spark, stream):
    """B's first commit was seen before the snapshot; after it B's events still come before A's."""
    stream.deliver([(0, "B", 1, "c", None, 1), (5, "A", 1, "c", None, 2)])
    stream.snapshot(events(spark, [(6, "SNAPSHOT:R", 1, "c", None, 1, 7)]), "R")
    stream.deliver([(8, "A", 2, "u_after", None, 1, 100), (9, "B", 2, "u_after", None, 1, 200)])
    assert state(stream.mirror()) == {1: 100}


def test_a_snapshot_that_dies_is_taken_again(spark, stream, monkeypatch):
    stream.deliver([(0, "A", 1, "c", None, 1, 5)])
    rows = events(spark, [(2, "SNAPSHOT:R", 1, "c", None, 1, 70)])
    with monkeypatch.context() as m:
        m.setattr(stream.epochs, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            stream.snapshot(rows, "R")
    assert state(stream.mirror()) == {1: 5}
    stream.snapshot(rows, "R")
    assert state(stream.mirror()) == {1: 70} and stream.epoch()[0] == 1


# -- proof windows ---------------------------------------------------------------------------------

SCANS = "stream string, at_us long, previous_us long, event_count long"
HOUR, BASE = 3_600_000_000, 1_700_000_000_000_000


def moved(rows):
    return [(s, at + BASE, None if p is None else p + BASE, n) for s, at, p, n in rows]


def live(spark, tmp_path, batches, schema, make):
    """Runs a stream over batches, one file each, one a micro-batch; its rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
        T.drain(make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_live_windows_equal_the_batch_with_refusals(spark, tmp_path):
    scans = [("s", 0, None, 1), ("s", HOUR, 0, 2), ("s", 2 * HOUR, 2 * HOUR, 4), ("s", 3 * HOUR, HOUR, 8), ("s", 4 * HOUR, 3 * HOUR, 16), ("s", 5 * HOUR, 7, 32), ("s", 6 * HOUR, 5 * HOUR, 64), ("s", 7 * HOUR, None, 128),
             ("s", 8 * HOUR, 7 * HOUR, 256), ("t", HOUR, None, 1), ("t", 9 * HOUR, HOUR, 1)]
    scans = moved(scans)
    by_time = sorted(scans, key=lambda r: r[1])
    got = live(spark, tmp_path, [by_time[:4], by_time[4:7], by_time[7:]], SCANS, lambda d: T.proof_window_stream(d, 2 * 3600, 600))
    batch = T.chained(spark.createDataFrame(scans, SCANS))
    assert {r.at_us - BASE: r.reason for r in got if r.state == "refused"} == {r.at_us - BASE: r.reason for r in batch.where("reason is not null").collect()} == {
        2 * HOUR: "loop", 3 * HOUR: "gap", 5 * HOUR: "unknown_predecessor", 7 * HOUR: "gap"}
    want = T.proof_windows(batch.where("reason is null"), 2 * 3600, 600).where("state <> 'open'").collect()
    assert {tuple(r)[:7] for r in got if r.state in ("closed", "late")} == {tuple(r) for r in want} and len(want) == 4


def test_a_window_whose_scan_never_comes_is_overdue(spark, tmp_path):
    batches = [[("quiet", 0, None, 1), ("busy", 0, None, 1)], [("busy", 3 * HOUR, 0, 1)], [("busy", 4 * HOUR, 3 * HOUR, 1)]]
    got = live(spark, tmp_path, [moved(b) for b in batches], SCANS, lambda d: T.proof_window_stream(d, 2 * 3600, 600))
    assert [(r.window_no, r.start_us - BASE, r.receipts) for r in got if r.stream == "quiet" and r.state == "overdue"] == [(0, 0, 1)]


# -- alerts ----------------------------------------------------------------------------------------

CHECKS = "pipeline string, check string, at_us long, status string, observed double"


def test_live_alerts_equal_the_lifecycle_with_changes(spark, tmp_path):
    rows = [("p", "lag", t, s, o) for t, s, o in [(1, "pass", 1.0), (2, "breach", 5.0), (3, "breach", 5.0), (4, "breach", 6.0), (5, "unobserved", None), (6, "pass", 1.0), (7, "breach", 9.0), (8, "breach", None), (9, "pass", 0.0)]]
    got = live(spark, tmp_path, [rows[:3], rows[3:6], rows[6:], [rows[3], rows[8], ("p", "lag", 9, "breach", 7.0), ("p", "lag", 10, "pass", 0.0)]], CHECKS, T.alert_stream)
    c = spark.createDataFrame(rows, CHECKS).withColumnRenamed("at_us", "at")
    want = {(r.at, r.event, r.occurrence, r.evaluations) for r in S.alert_lifecycle(c).collect()}
    assert {(r.at_us, r.event, r.occurrence, r.evaluations) for r in got if r.event in ("opened", "reopened", "resolved")} == want
    assert {(r.at_us, r.before, r.observed) for r in got if r.event == "changed"} == {(r.at, r.before, r.observed) for r in S.alert_changes(c).collect()} == {(4, 5.0, 6.0), (8, 9.0, None)}
    assert sorted((r.at_us, r.event) for r in got if r.event.startswith("refused")) == [(4, "refused_older"), (9, "refused_conflict")]


# -- state that expires ----------------------------------------------------------------------------

def test_contents_are_forgotten_after_their_time(spark, tmp_path):
    s, inbox = T.LedgerStream(spark, f"file://{tmp_path}/t", horizon_s=600), f"file://{tmp_path}/in"
    for rows in ([(0, "A", 1, "c", None, 1, 5), (1, "A", 2, "c", None, 2, 5)], [(5, "A", 1, "c", None, 1, 6)], [(60, "A", 3, "c", None, 3, 5)], [(61, "A", 4, "c", None, 4, 5)], [(62, "A", 2, "c", None, 2, 7)]):
        s.run(deliver(events(spark, rows), inbox))
    assert [(r.event_id, r.cents) for r in s.rejects().collect()] == [("A-1", 6)]  # A-2 comes anew after its time
    assert s.judgements().where("verdict = 'accepted' and event_id = 'A-2'").count() == 2


def test_state_is_an_id_and_a_digest(spark, stream):
    stream.deliver([(0, "A", 1, "c", None, 1, 5)])
    s = spark.read.format("statestore").option("stateVarName", "content").load(f"{stream.folder}/judge")
    assert [len(r.d) for r in s.select(F.col("value.digest").alias("d")).collect()] == [64]
