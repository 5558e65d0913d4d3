"""What the plans must look like at scale."""

from ledgerloom.operators import compare as R
from ledgerloom.operators import contract as C
from ledgerloom.operators import ledger as L
from ledgerloom.plans.ledger_queries import ledger
from ledgerloom.sources import raw as W


def plan(df):
    return df._jdf.queryExecution().toString()


def stored(spark, sf, tmp_path):
    out = f"{tmp_path}/ledger"
    ledger(spark, sf).write.parquet(out)
    return spark.read.parquet(out)


def test_window_predicates_and_columns_reach_the_scan(spark, sf, tmp_path):
    led = stored(spark, sf, tmp_path)
    df = W.journal_window(led, "JRN2", 10, 20).select("event_id")
    p = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "EqualTo(receiver,JRN2)" in p and "GreaterThanOrEqual(sequence,10)" in p and "commit_ts" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_scope_is_two_hash_joins_and_no_nested_loop(spark, sf, tmp_path):
    led = stored(spark, sf, tmp_path)
    assert "NestedLoop" not in plan(L.scope(led, L.touched_keys(led))) and "Cartesian" not in plan(R.best_offset(led.selectExpr("sequence as at_ms", "operation as op"), led.selectExpr("sequence as at_ms", "operation as op"), [0, 1]))


def test_replay_shuffles_once_by_key_on_a_stored_ledger(spark, sf, tmp_path):
    """One exchange by key for the winners; receivers' ranks are a handful of rows."""
    physical = plan(L.replay_full(stored(spark, sf, tmp_path))).split("== Physical Plan ==")[1]
    by = [line for line in physical.split("\n") if "Exchange hashpartitioning(k" in line]
    assert len(by) == 1 and "SortMergeJoin" not in physical


def test_orphans_are_an_equi_anti_join(spark, sf, tmp_path):
    led = stored(spark, sf, tmp_path).withColumnsRenamed({"before_key": "before_rrn", "after_key": "after_rrn"})
    assert "NestedLoop" not in plan(C.orphan_deletes(led))
