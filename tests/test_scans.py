"""Scans over ranges, percentiles without a sorted task, offsets dealt once, and a writer that refuses."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import compare as R
from ledgerloom.operators import metrics as M
from ledgerloom.operators.scans import running
from ledgerloom.sources import raw as W


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("most", [10**6, 20])
def test_running_values_equal_a_plain_loop(spark, most):
    rng = random.Random(4)
    data = [(rng.choice([None, "hot", "hot", "hot", "b", "c"]), i, rng.choice([None, None, rng.randrange(9)])) for i in range(600)]
    rng.shuffle(data)
    d = spark.createDataFrame(data, "k string, at int, v int").repartition(4)
    got = running(d, ["k"], ["at"], last={"last": F.col("v")}, total={"total": F.coalesce("v", F.lit(0))}, most=most)
    want, seen = [], {}
    for k, at, v in sorted(data, key=lambda r: r[1]):
        last, total = seen.get(k, (None, 0))
        want.append((k, at, v, last, total + (v or 0)))
        seen[k] = (last if v is None else v, total + (v or 0))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert got.columns == ["k", "at", "v", "last", "total"] and running(d.limit(0), ["k"], ["at"], last={"last": F.col("v")}, most=most).count() == 0


def test_a_hot_key_is_dealt_over_many_tasks(spark):
    d = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), (F.col("id") % 7).alias("v"))
    got = running(d, ["k"], ["at"], last={"last": F.col("v")}, total={"total": F.lit(1)}, most=1000)
    assert got.where("total = at + 1 and (last <=> case when at > 0 then (at - 1) % 7 end)").count() == 20_000
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000


def test_percentiles_of_large_groups_are_the_same(spark):
    d = spark.range(3000).select((F.col("id") % 3).alias("run"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7919) % 1009).alias("ms"))
    assert rows(M.latency_summary(d, ["run"], "ms", most=50)) == rows(M.latency_summary(d, ["run"], "ms"))
    s = d.where("ms is not null").select(F.concat(F.lit("s"), "run").alias("solution"), F.col("ms").alias("elapsed_ms"), F.lit(5).alias("bytes"), F.lit(1).alias("lag"), F.lit(2).alias("cost_cents"), F.lit("a").alias("scope"), F.lit("f").alias("fingerprint"))
    assert rows(M.compare_runs(s, most=50)) == rows(M.compare_runs(s))
    c = spark.range(2000).select(F.to_json(F.struct(F.lit(1e9).alias("cycle_ms"), F.create_map(F.lit("split"), (F.col("id") * 31 % 997).cast("double")).alias("stages_ms"))).alias("line"))
    got = M.stage_durations(c, most=50).first()
    want = spark.range(2000).select((F.col("id") * 31 % 997).cast("double").alias("ms")).agg(F.percentile("ms", 0.5), F.percentile("ms", 0.95), F.max("ms")).first()
    assert (got.stage, got.cycles, got.p50_ms, got.p95_ms, got.most_ms) == ("split", 2000, *want)


def test_before_images_of_hot_keys_are_the_same(spark):
    rng = random.Random(8)
    data = [(rng.choice([1, 1, 1, 2]), rng.choice("AB"), i, rng.choice(["c", "u", "d", "u_before", "u_after"]), rng.choice([None, 1, 2]), rng.choice([1, 2])) for i in range(400)]
    e = spark.createDataFrame(data, "k long, receiver string, sequence long, operation string, before_value long, after_value long")
    ranks = spark.createDataFrame([("A", 1), ("B", 2)], "receiver string, receiver_rank long")
    want = rows(R.before_image_mismatch(e, ranks))
    assert len(want) > 50 and rows(R.before_image_mismatch(e, ranks, most=30)) == want


def test_offsets_move_no_rows(spark):
    hour = 3_600_000
    a = spark.createDataFrame([(i * 1000, "c") for i in range(50)] * 2 + [(5, "d")], "at_ms long, op string")
    b = spark.createDataFrame([(i * 1000 + hour, "c") for i in range(40)], "at_ms long, op string")
    d = R.best_offset(a, b, [-1, 0, 1])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert {r.hours: (r.overlap, r.best) for r in R.best_offset(a, b, [-1, 0, 1]).collect()} == {-1: (0, False), 0: (0, False), 1: (40, True)}
    moved = [x for x in d._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert sum("place" in x for x in moved) == 1 and not any("at_ms" in x or "at#" in x for x in moved)


EVENTS = "event_id string, receiver string, sequence long, operation string, ingested_at timestamp, source_file string, cents long, table_name string"


def some(spark, *more):
    base = [(f"e{i}", "A", i, "c", None, "f", i, "T") for i in range(5)]
    return spark.createDataFrame(base + list(more), EVENTS)


@pytest.mark.parametrize("bad,why", [
    (("", "A", 9, "c", None, "f", 1, "T"), "no_id"), (("x", " ", 9, "c", None, "f", 1, "T"), "no_receiver"), (("x", "A", None, "c", None, "f", 1, "T"), "no_position"), (("x", "A", -1, "c", None, "f", 1, "T"), "negative_position"),
    (("e1", "A", 9, "c", None, "f", 1, "T"), "several_positions"), (("e1", "A", 1, "c", None, "f", 77, "T"), "several_contents")])
def test_a_bad_batch_is_refused_and_leaves_no_manifest(spark, tmp_path, bad, why):
    with pytest.raises(Exception, match=why):
        W.write_raw_batches(some(spark, bad), f"file://{tmp_path}/r")
    assert not (tmp_path / "r" / "manifest").exists()


def test_whole_copies_are_written_once(spark, tmp_path):
    again = ("e1", "A", 1, "c", None, "g", 1, "T")
    assert W.write_raw_batches(some(spark, again), f"file://{tmp_path}/r") == 5
    m = W.read_manifests(spark, f"file://{tmp_path}/r").collect()
    assert [(r.batch_id, r.event_count, r.event_ids, r.high_watermark.sequence) for r in m] == [("T/A/000000", 5, [f"e{i}" for i in range(5)], 4)]
    raw = W.read_raw_events(spark, f"file://{tmp_path}/r")
    assert W.batch_integrity(raw, W.read_manifests(spark, f"file://{tmp_path}/r")).where("reason is not null").count() == 0
    with pytest.raises(ValueError):
        W.write_raw_batches(some(spark).limit(0), f"file://{tmp_path}/empty")
