"""Canonical forms, integrity, metrics and states: edge tables."""

import datetime as dt
import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import forms as P
from ledgerloom.operators import compare as R
from ledgerloom.operators import contract as C
from ledgerloom.operators import metrics as M
from ledgerloom.operators import sequences as S
from ledgerloom.operators import slo as O
from ledgerloom.sources import fixtures as X
from ledgerloom.sources import raw as W
from ledgerloom.streaming import streams as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text,scale,want", [("2.345", 2, "2.34"), ("2.355", 2, "2.36"), ("-99999.99", 2, "-99999.99"), ("2.5", 0, "2"), ("3.5", 0, "4"), (None, 2, None), ("x", 2, None)])
def test_decimal_ties_go_to_even(spark, text, scale, want):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert one(spark, text, lambda c: P.canonical_decimal(c, scale)) == want
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_thirty_eight_digits_survive(spark):
    got = one(spark, json.dumps({"a": "x"}).replace('"x"', "12345678901234567890123456789012345678"), lambda c: F.from_json(c, "a decimal(38,0)")["a"].cast("string"))
    assert got == "12345678901234567890123456789012345678"


@pytest.mark.parametrize("text,day,why", [("2024-02-29", "2024-02-29", None), ("2024-02-29 10:00:00", "2024-02-29", None), ("24-02-29", None, "two_digit_year"), ("2023-02-29", None, "not_a_date"), ("", None, "not_a_date"), (None, None, None)])
def test_dates(spark, text, day, why):
    r = spark.createDataFrame([(text,)], "v string").select(*[x.alias(n) for n, x in zip(("d", "w"), P.canonical_date(F.col("v")))]).first()
    assert (r.d, r.w) == (day, why)


@pytest.mark.parametrize("text,digits,want", [("2026-08-25-22.45.18.021600", 3, "2026-08-25 22:45:18.021"), ("2026-08-25T22:45:18", 6, "2026-08-25 22:45:18.000000"), ("2026-08-25 22:45:18.9999", 0, "2026-08-25 22:45:18"), ("nope", 3, None)])
def test_timestamps_are_cut(spark, text, digits, want):
    assert one(spark, text, lambda c: P.canonical_timestamp(c, digits)) == want


def test_milliseconds_are_cut_and_shifted(spark):
    assert one(spark, "2026-08-25T22:45:18.021600", lambda c: P.epoch_ms(c, 2)) == int(dt.datetime(2026, 8, 25, 20, 45, 18, tzinfo=dt.timezone.utc).timestamp()) * 1000 + 21


@pytest.mark.parametrize("local,why", [("2024-03-31 02:30:00", "nonexistent_hour"), ("2024-10-27 02:30:00", "ambiguous_hour"), ("2024-06-01 12:00:00", None), (None, "missing")])
def test_local_hours(spark, local, why):
    r = spark.createDataFrame([(local,)], "v string").select(P.local_to_utc(F.col("v").cast("timestamp"), "Europe/Paris")[1].alias("w")).first()
    assert r.w == why


def test_absent_image_has_no_fingerprint(spark):
    r = spark.createDataFrame([(None,), (4,)], "k long").select(P.key_fingerprint(F.col("k").isNotNull(), "k").alias("f")).collect()
    assert r[0].f is None and len(r[1].f) == 64


def test_negative_zero_and_trailing_zeros(spark):
    assert [one(spark, v, lambda c: P.plain_decimal(c)) for v in ("-0.00", "10.500", "100", "0")] == ["0", "10.5", "100", "0"]


def test_image_with_record_number(spark):
    d = spark.createDataFrame([({"a": "1"}, 5, "c"), (None, 5, "d"), (None, 5, "c"), ({"_rrn": "1"}, 5, "c"), ({"a": "1"}, 0, "c")], "i map<string,string>, r long, o string")
    full, why = W.with_rrn(F.col("i"), F.col("r"), F.col("o"))
    got = [r.w for r in d.select(why.alias("w")).collect()]
    assert got == [None, None, "image_missing", "reserved_name", None]


def test_variant_null_and_missing_key(spark):
    d = spark.createDataFrame([('{"operation":"c","after":{"k":null}}',), ('{"operation":"c","after":{}}',), ('{"operation":"c","after":{"k":1}}',), ('{"operation":"d","before":{"k":1}}',)], "v string").select(F.parse_json("v").alias("p"))
    assert C.variant_null_keys(d, "p", ["k"]).count() == 2


def test_batches_break_in_known_ways(spark, sf, tmp_path):
    from ledgerloom.plans.ledger_queries import ledger

    out = f"file://{tmp_path}/raw"
    W.write_raw_batches(ledger(spark, sf).withColumn("table_name", F.lit("T")), out)
    raw, m = W.read_raw_events(spark, out), W.read_manifests(spark, out)
    assert W.batch_integrity(raw, m).where("reason is not null").count() == 0
    some = m.first().batch_id
    assert W.batch_integrity(raw.where(F.col("batch_id") != some), m).where("reason is not null").first().reason == "payload_missing"
    assert W.batch_integrity(raw, m.where(F.col("batch_id") != some)).where("reason is not null").first().reason == "manifest_missing"
    with pytest.raises(ValueError):
        W.read_raw_events(spark, out, ["a", "a"])
    with pytest.raises(ValueError):
        W.read_raw_events(spark, out, ["../x"])


def test_key_ranges_cover_every_key_once():
    for least, most, parts in ((1, 10, 3), (5, 5, 4), (0, 99, 7), (-3, 3, 2)):
        got = [k for lo, hi, _ in W.key_ranges(least, most, parts) for k in range(lo, hi + 1)]
        assert got == list(range(least, most + 1))


def test_changes_lead_to_the_state(spark):
    rows = spark.range(1, 101).selectExpr("id AS key", "concat('r', id) AS label", "cast(id AS decimal(15,2)) AS amount")
    events, final = W.generate_changes(rows)
    assert events.where("operation = 'd'").count() == 5 and final.count() == 96  # 60 comes back
    assert {r.key: r.step for r in final.where("key in (3, 4, 21, 51, 60)").collect()} == {3: "1-changes", 4: "0-seed", 21: "1-changes", 51: "3-changes", 60: "2-changes"}


def test_receipt_chain_finds_forks_and_holes(spark):
    d = spark.createDataFrame([("a", "1", None), ("b", "2", "1"), ("c", "3", "2"), ("d", "4", "2"), ("x", "9", "8")], "receipt string, end_key string, previous_key string")
    got = {r.receipt: (r.place, r.reason) for r in W.receipt_chain(d).collect()}
    assert got["a"] == (0, None) and got["b"] == (1, None) and got["c"][1] == got["d"][1] == "fork" and got["x"] == (None, "unreachable")


def test_receipt_chain_finds_cycles(spark):
    d = spark.createDataFrame([("a", "1", None), ("b", "2", "1"), ("x", "8", "9"), ("y", "9", "8")], "receipt string, end_key string, previous_key string")
    got = {r.receipt: (r.place, r.reason) for r in W.receipt_chain(d).collect()}
    assert got == {"a": (0, None), "b": (1, None), "x": (None, "cycle"), "y": (None, "cycle")}


def test_a_long_receipt_chain_ends_soon(spark):
    n = 5000
    d = spark.range(n).selectExpr("cast(id AS string) AS receipt", "cast(id AS string) AS end_key", "case when id > 0 then cast(id - 1 AS string) end AS previous_key").repartition(4)
    start = time.time()
    got = {r.receipt: r.place for r in W.receipt_chain(d).collect()}
    assert got == {str(i): i for i in range(n)} and time.time() - start < 60


@pytest.mark.parametrize("cursor,want", [
    (None, [("a", 0, None), ("b", 1, None), ("c", 2, None)]), (("R", 20), [("c", 0, None)]), (("R", 15), [("b", 0, None), ("c", 1, None)]), (("R", 0), [("a", 0, None), ("b", 1, None), ("c", 2, None)]),
    (("Q", 7), []), (("R", -5), [("a", None, "hole_after_boundary"), ("b", None, "hole_after_boundary"), ("c", None, "hole_after_boundary")])])
def test_pending_receipts(spark, cursor, want):
    rows = [("a", "R", 1, 10, None, None), ("b", "R", 11, 20, "R", 10), ("c", "S", 1, 5, "R", 20)]
    d = spark.createDataFrame(rows, "receipt string, receiver string, start_seq long, end_seq long, previous_receiver string, previous_seq long")
    assert sorted((r.receipt, r.place, r.reason) for r in W.pending_receipts(d, cursor).collect()) == want


def test_nearest_sequence_of_a_hot_key(spark):
    a = spark.range(1, 100_001).selectExpr("'hot' AS key", "id * 7 AS sequence", "id AS n")
    b = spark.range(1, 70_001).selectExpr("'hot' AS key", "id * 10 AS sequence").where("sequence not between 100000 and 300000")
    got = R.nearest_sequence(a, b, "key", width=10_000).toPandas()
    held = np.sort(b.toPandas().sequence.to_numpy())
    at = np.searchsorted(held, got.a_seq)
    low, high = held[np.maximum(at - 1, 0)], held[np.minimum(at, len(held) - 1)]
    want = np.where((abs(high - got.a_seq) < abs(got.a_seq - low)), high, low)
    assert len(got) == 100_000 and (abs(got.b_seq - got.a_seq) == abs(want - got.a_seq)).all()


def test_declared_history_refuses(spark):
    e = spark.createDataFrame([("i", "d", "R", 1, None, '{"a": 12345678901234567890123456.123456789012, "b": {"type": "bytes", "encoding": "base64", "value": "AQI="}, "t": "25:00:00"}', None)], "event_id string, operation string, receiver string, sequence long, commit_ts timestamp_ntz, before string, after string")
    r = W.typed_history(e, {"a": "decimal(38,12)", "b": "binary", "t": "time"}).first()
    assert str(r.a) == "12345678901234567890123456.123456789012" and bytes(r.b) == b"\x01\x02" and r.t is None and r._event_id == "i"
    for bad in ({"a": "variant"}, {"_receiver": "string"}):
        with pytest.raises(ValueError):
            W.typed_history(e, bad)


def test_gap_in_receipts(spark):
    r = spark.createDataFrame([("T", "A", 100, 199, 100), ("T", "A", 250, 299, 50)], "table_name string, receiver string, start_seq long, end_seq long, event_count long")
    ranks = spark.createDataFrame([("A", 1, 100, 299)], "receiver string, receiver_rank long, first_seq long, last_seq long")
    got = [x for x in S.receipt_gaps(r, ranks).collect() if x.kind]
    assert [(x.kind, x.expected) for x in got] == [("gap", 200)]


def test_diverging_lag(spark):
    d = spark.createDataFrame([("p", i, v, i) for i, v in enumerate((1, 1, 133812, 133812, 1377824, 1377824))], "pipeline string, elapsed_s long, lag long, n long")
    assert M.lag_trend(d).first().trend == "DIVERGING"
    assert M.lag_trend(d.limit(2)).first().trend == "INCONCLUSIVE"


def test_multiset_counts(spark):
    a = spark.createDataFrame([(1,)] * 3, "k int")
    b = spark.createDataFrame([(1,)] * 2, "k int")
    r = R.multiset_counts(a, b, ["k"]).first()
    assert (r.overlap, r.missing, r.extra) == (2, 1, 0)


def test_digest_refuses_repeats_and_ignores_order(spark):
    d = spark.createDataFrame([("w", "b"), ("w", "a"), ("v", "a"), ("v", "a")], "w string, id string")
    got = {r.w: r for r in M.identity_digest(d, ["w"], "id").collect()}
    import hashlib

    assert got["w"].digest == hashlib.sha256(b"a\nb").hexdigest() and got["v"].digest is None and got["v"].refused
    many = spark.range(500).selectExpr("cast(id AS string) AS id")
    one = M.tree_digest(many, "id", leaf=5).first()  # four levels
    assert one.digest == M.tree_digest(many.orderBy("id"), "id", leaf=5).first().digest and one["values"] == 500 and not one.refused
    assert M.tree_digest(many.where("id <> '77'"), "id", leaf=5).first().digest != one.digest and M.tree_digest(many.union(many.limit(1)), "id", leaf=5).first().refused


def test_fingerprint_sees_multiplicity(spark):
    a = spark.createDataFrame([("x",), ("x",)], "v string")
    b = spark.createDataFrame([("y",), ("y",)], "v string")
    assert M.set_fingerprint(a, "v").first() != M.set_fingerprint(b, "v").first()


def test_unknown_never_passes(spark):
    d = spark.createDataFrame([(None,), (-1,), (5,), (500,)], "v long").select(O.maximum_check(F.col("v"), F.lit(100)).alias("s"))
    assert [r.s for r in d.collect()] == ["unobserved", "unobserved", "pass", "breach"]
    ages = spark.createDataFrame([(None,), (-120,), (0,), (301,)], "v long").select(O.freshness(F.col("v")).alias("s"))
    assert [r.s for r in ages.collect()] == ["unknown", "clock_untrusted", "fresh", "stale"]
    e = spark.createDataFrame([], "ingested_at timestamp_ntz, commit_ts timestamp_ntz")
    assert M.delivery_latency(e).first().p95_s is None


def test_fleet_is_unmeasured_if_a_table_is(spark):
    d = spark.createDataFrame([("f", 5, 7, 9), ("f", None, 8, 9)], "fleet string, rows long, position long, source_position long")
    r = M.fleet_totals(d).first()
    assert r.rows is None and r.covered == 7


def test_proof_window_closes_at_the_first_scan_past_its_duration():
    r = pd.DataFrame({"at_us": [0, 5, 11, 30], "event_count": [1, 1, 1, 1]})
    rows, state = T.close_windows("s", r, 10, 2, None)
    assert [(x[1], x[2], x[3], x[6]) for x in rows] == [(0, 0, 11, "closed"), (1, 11, 30, "late")] and state == (2, 30, 0, 0)


def test_streams_equal_batches(spark, sf):
    from ledgerloom.plans import QUERIES

    want = {(r.k, r.event_id) for r in QUERIES["rep_1_replay_full"](spark, sf).collect()}
    assert {(r.k, r.event_id) for r in QUERIES["str_3_apply_stream"](spark, sf).collect()} == want
    assert {(r.k, r.event_id) for r in QUERIES["str_4_late_replay"](spark, sf).collect()} == want


def test_schema_drift_names_added_fields(spark):
    d = spark.createDataFrame([("v1", '{"a":1}'), ("v2", '{"a":1,"b":2}'), ("v3", '{"b":2}')], "schema_version string, image string")
    assert [(r.schema_version, r.added) for r in C.schema_drift(d).collect()] == [("v2", ["b"])]


def test_before_image_differs_and_delete_of_absent(spark):
    ranks = spark.createDataFrame([("A", 1)], "receiver string, receiver_rank long")
    e = spark.createDataFrame([(1, "A", 1, "c", None, 10), (1, "A", 2, "u", 11, 12), (1, "A", 3, "d", 12, None), (1, "A", 4, "d", 12, None)], "k long, receiver string, sequence long, operation string, before_value long, after_value long")
    assert [(r.sequence, r.reason) for r in R.before_image_mismatch(e, ranks).orderBy("sequence").collect()] == [(2, "before_image_differs"), (4, "delete_of_absent_key")]


def test_fixture_of_an_empty_table_is_empty(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert X.journal_events(spark, str(tmp_path)).count() == 0
