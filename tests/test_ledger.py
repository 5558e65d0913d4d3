"""Replay and ordering: hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.sources import fixtures as X
from ledgerloom.sources.raw import EVENT
from ledgerloom.sources.versions import BucketTable
from ledgerloom.streaming.streams import IncrementalReplay

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (minute, receiver, sequence, operation, before, after)."""
    return spark.createDataFrame([(f"{r}-{s}", r, s, op, T0 + dt.timedelta(minutes=m), T0 + dt.timedelta(minutes=m), "f", 0, b, a, s, "x", s) for m, r, s, op, b, a in rows], EVENT)


def state(df):
    return {r.k: r.sequence for r in df.collect()}


def test_key_move(spark):
    e = events(spark, [(0, "A", 100, "c", None, 1), (1, "A", 110, "u", 1, 1), (2, "A", 120, "u", 1, 2), (3, "A", 130, "c", None, 3), (4, "A", 140, "d", 3, None)])
    assert state(L.replay_full(e)) == {2: 120}


def test_technical_images(spark):
    e = events(spark, [(0, "A", 100, "c", None, 1), (1, "A", 120, "u_before", 1, None), (2, "A", 121, "u_after", None, 2)])
    assert state(L.replay_full(e)) == {2: 121}


def test_rotation_restart(spark):
    e = events(spark, [(0, "Z9", 901994124, "c", None, 1), (5, "A1", 1, "u_after", None, 1)])
    assert state(L.replay_full(e)) == {1: 1}


def test_snapshot_loses(spark):
    e = events(spark, [(9, "SNAPSHOT:S", 500, "c", None, 1), (1, "A", 3, "u_after", None, 1)])
    assert state(L.replay_full(e)) == {1: 3}


def test_upsert_beats_delete_on_equal_sequence(spark):
    e = events(spark, [(0, "A", 5, "c", None, 1)]).unionByName(events(spark, [(0, "A", 5, "d", 1, None)]).withColumn("event_id", F.lit("other")))
    assert state(L.replay_full(e)) == {1: 5}


def test_incremental_equals_full_when_a_key_comes_back(spark):
    """c C, c A, u A->B, u C->A, watermark, u B->B: A must stay."""
    a, b, c = 1, 2, 3
    e = events(spark, [(0, "R", 0, "c", None, c), (1, "R", 1, "c", None, a), (2, "R", 2, "u", a, b), (3, "R", 3, "u", c, a), (10, "R", 4, "u", b, b)])
    at = "2024-01-01 00:05:00"
    before = L.replay_full(e.where(F.col("ingested_at") <= F.lit(at).cast("timestamp_ntz")))
    got = L.replay_incremental(e, before, at)
    assert state(got) == state(L.replay_full(e)) == {a: 3, b: 4}


def test_order_of_input_does_not_matter(spark, sf):
    raw = X.raw_events(spark, sf)
    one = L.replay_full(L.dedupe_first(raw))
    two = L.replay_full(L.dedupe_first(raw.orderBy(F.rand(3))))
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_replaying_twice_is_replaying_once(spark, sf):
    raw = X.raw_events(spark, sf)
    once = L.dedupe_first(raw)
    assert L.append_history(raw.unionByName(raw), once).count() == 0


def test_empty_ledger(spark):
    e = events(spark, [])
    assert L.replay_full(e).count() == 0 and L.mirror_winner(e, L.receiver_ranks(e)).count() == 0


def test_a_write_replaces_only_its_buckets(spark, tmp_path):
    v = BucketTable(spark, f"file://{tmp_path}/m", "k long, x long", "k", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, x long")
    assert v.rows().count() == 0
    v.write(rows(*[(k, 0) for k in range(20)]), 0)
    first = {b: p[-1] for b, p in v.versions().items()}
    one = rows((3, 1)).select(v.bucket()).first()[0]
    for i in (1, 2, 3):
        v.write(v.rows(only={one}).where("k <> 3").union(rows((3, i))), i)
    now = v.versions()
    assert all((p[-1] == first[b]) == (b != one) for b, p in now.items()) and len(now[one]) == 2
    assert {r.k: r.x for r in v.rows().collect()} == {k: 3 if k == 3 else 0 for k in range(20)} and v.rows(before=1).where("x > 0").count() == 0
    v.write(rows((7, 9)), 4, whole=True)
    assert [tuple(r) for r in v.rows().collect()] == [(7, 9)]


def test_a_receiver_that_turns_out_older_changes_all_winners(spark, tmp_path):
    """B is known from minute 20 and wins; then an event of B from minute 0 puts B before A.  No stored winner is replayed."""
    rows = [(10, "A", 1, "c", None, 1), (20, "B", 1, "u_after", None, 1), (0, "B", 0, "c", None, 9)]
    r = IncrementalReplay(spark, f"file://{tmp_path}/t")
    seen = []
    for i in range(1, 4):
        led = events(spark, rows[:i]).withColumn("ingested_at", F.timestamp_seconds(F.when(F.col("event_id") == "A-1", 1).when(F.col("event_id") == "B-1", 2).otherwise(3)).cast("timestamp_ntz"))
        seen.append({x.k: x.receiver for x in r.run(led).collect()})
    assert seen == [{1: "A"}, {1: "B"}, {1: "A", 9: "B"}]
    assert state(L.replay_full(events(spark, rows))) == state(r.run(led))
    assert {(x.k, x.receiver) for x in r.winners.rows().collect()} == {(1, "A"), (1, "B"), (9, "B")}


def test_the_watermark_moves_after_success(spark, tmp_path, monkeypatch):
    led = events(spark, [(0, "A", 1, "c", None, 1), (1, "A", 2, "c", None, 2), (2, "A", 3, "d", 1, None), (3, "A", 4, "u", 2, 5)])
    r = IncrementalReplay(spark, f"file://{tmp_path}/r")
    assert state(r.run(led.where("sequence <= 2"))) == {1: 1, 2: 2}
    mark = r.last()
    with monkeypatch.context() as m:
        m.setattr(r.marks, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            r.run(led)
    assert r.last() == mark
    assert state(r.run(led)) == {5: 4} == state(L.replay_full(led)) and r.last()[0] == mark[0] + 1
    assert state(r.run(led)) == {5: 4} and r.last()[0] == mark[0] + 1  # nothing new


def test_snapshot_ordinals_follow_the_key(spark):
    t = spark.createDataFrame([(7, "x"), (3, "y"), (9, None)], "k long, v string")
    got = L.snapshot_as_events(t, "k", "S", "T.T", first=11).orderBy("sequence").collect()
    assert [r.sequence for r in got] == [11, 12, 13] and '"k":3' in got[0].after


@pytest.mark.parametrize("operation,before,after,reason", [
    ("c", None, 1, None), ("c", 1, 1, "create_with_before"), ("c", None, None, "create_without_after"), ("d", 1, None, None), ("d", None, None, "delete_without_before"), ("d", 1, 1, "delete_with_after"),
    ("u", 1, 1, None), ("u", None, 1, "update_without_both_images"), ("u_before", 1, None, None), ("u_before", None, None, "before_image_missing"), ("u_after", None, 1, None), ("u_after", 1, 1, "after_image_with_before"),
    ("x", 1, 1, "operation_unknown"), (None, 1, 1, "operation_unknown")])
def test_contract(spark, operation, before, after, reason):
    from ledgerloom.operators.contract import contract_violations

    e = events(spark, [(0, "A", 1, operation, before, after)])
    got = [r.reason for r in contract_violations(e).collect()]
    assert got == ([reason] if reason else [])
