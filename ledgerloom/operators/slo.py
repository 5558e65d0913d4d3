"""Service levels and states: every check is pass, breach or unobserved, and unknown never passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default policy (fixed values): the most that each measure may be.
POLICY = {"capture_age_s": 120, "raw_age_s": 180, "destination_age_s": 300, "lag": 1000, "p95_s": 60, "p99_s": 180, "requests_24h": 500000, "pending_files": 10, "credits_cents": 100}


def maximum_check(observed: Column, threshold: Column) -> Column:
    """breach beyond the threshold, unobserved if unknown or negative."""
    return F.when(observed.isNull() | (observed < 0) | threshold.isNull(), "unobserved").when(observed > threshold, "breach").otherwise("pass")


def evaluate_slo(telemetry: DataFrame, key: list[str], policy: dict[str, float] | None = None) -> DataFrame:
    """SLO-1: one row per measure: check, observed, threshold, status."""
    policy = policy or POLICY
    rows = [F.struct(F.lit(m).alias("check"), F.col(m).cast("double").alias("observed"), F.lit(float(t)).alias("threshold"), maximum_check(F.col(m), F.lit(t)).alias("status")) for m, t in policy.items()]
    return telemetry.select(*key, F.explode(F.array(*rows)).alias("c")).select(*key, "c.*")


#: The whole report: check: (stage, rule, threshold); thresholds are defaults (fixed values).
REPORT = {"capture_freshness": ("capture", "capture_age_s", 120), "capture_state": ("capture", None, None), "capture_errors": ("capture", "capture_errors", 0), "checkpoint_lag": ("capture", None, 1000),
          "raw_freshness": ("raw", "raw_age_s", 180), "raw_requests": ("cost", "requests_24h", 500000), "load_queue": ("load", "pending_files", 10), "ledger_freshness": ("ledger", "destination_age_s", 300),
          "delivery_p95": ("delivery", "p95_s", 60), "delivery_p99": ("delivery", "p99_s", 180), "reconciliation": ("reconciliation", None, 0), "credits": ("cost", "credits_cents", 100), "observability": ("observability", "report_age_s", 600)}


def evaluate_report(telemetry: DataFrame, key: list[str], report: dict | None = None) -> DataFrame:
    """SLO-1 in full: one row a report and check: check, stage, observed, threshold, status and, unless it passes, why.
    telemetry: the measures of ``REPORT`` (ages come from the moment of collection, ``report_age_s`` from the clock of the evaluation),
    capture_state; receiver, sequence, source_receiver, source_sequence; state and deviation of the reconciliation;
    metered_hours (credits count only for a whole day of 24 metered hours).  An age below zero is a clock to distrust, not an age;
    credits without their window are not measured; positions of two receivers do not compare."""
    rows = []
    for check, (stage, column, most) in (report or REPORT).items():
        x = F.col(column).cast("double") if column else F.lit(None).cast("double")
        missing = F.when(x.isNull(), "measurement_missing").when(x < 0, "negative_measurement")
        if check == "capture_state":
            ok = capture_state_check(F.col("capture_state"))
            status, why = ok, F.when(F.col("capture_state").isNull(), "measurement_missing").when(ok == "unobserved", "unknown_state").when(ok == "breach", F.col("capture_state"))
        else:
            if check == "checkpoint_lag":
                x = F.when(F.col("receiver") == F.col("source_receiver"), F.col("source_sequence") - F.col("sequence")).cast("double")
                missing = (F.when(F.col("receiver").isNull() | F.col("source_receiver").isNull() | F.col("sequence").isNull() | F.col("source_sequence").isNull(), "measurement_missing")
                           .when(F.col("receiver") != F.col("source_receiver"), "different_receivers").when(x < 0, "checkpoint_ahead"))
            elif check == "reconciliation":
                x = F.col("deviation").cast("double")
                missing = F.when(x.isNull() | F.col("state").isNull(), "measurement_missing").when(~F.col("state").isin("matched", "mismatch"), "not_settled")
            elif check == "credits":
                missing = F.when(F.col("metered_hours").isNull() | (F.col("metered_hours") != 24), "window_missing").otherwise(missing)
            elif column and column.endswith("_age_s"):
                missing = F.when(x.isNull(), "measurement_missing").when(x < 0, "clock_in_future")
            over = (x > most) | ((F.col("state") != "matched") if check == "reconciliation" else F.lit(False))
            status = F.when(missing.isNotNull(), "unobserved").when(over, "breach").otherwise("pass")
            why = F.coalesce(missing, F.when(over, "beyond_threshold"))
        rows.append(F.struct(F.lit(check).alias("check"), F.lit(stage).alias("stage"), x.alias("observed"), F.lit(most).cast("double").alias("threshold"), status.alias("status"), why.alias("reason")))
    return telemetry.select(*key, F.explode(F.array(*rows)).alias("c")).select(*key, "c.*")


def report_status(checks: DataFrame, key: list[str]) -> DataFrame:
    """A report is breach if any check is, else unobserved if any is, else pass."""
    return checks.groupBy(*key).agg(F.count("*").alias("checks"), F.when(F.count_if(F.col("status") == "breach") > 0, "breach").when(F.count_if(F.col("status") == "unobserved") > 0, "unobserved").otherwise("pass").alias("status"))


def reconciliation_check(counters: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """SLO-2: the largest deviation over counter pairs; passes only at 0 and in state matched."""
    apart = [F.abs(F.col(a) - F.col(b)) for a, b in pairs]
    unknown = F.lit(False)
    for x in apart:
        unknown = unknown | x.isNull()
    most = F.when(~unknown, F.greatest(*apart) if len(apart) > 1 else apart[0])
    return counters.withColumn("deviation", most).withColumn("status", F.when(F.col("deviation").isNull() | F.col("state").isNull(), "unobserved").when((F.col("deviation") == 0) & (F.col("state") == "matched"), "pass").otherwise("breach"))


def capture_state_check(state: Column) -> Column:
    """SLO-3: run state to status."""
    return F.when(state.isin("running", "idle"), "pass").when(state.isin("failed", "stopped_on_error"), "breach").otherwise("unobserved")


def checkpoint_lag_check(receiver: Column, sequence: Column, source_receiver: Column, source_sequence: Column, most: int) -> tuple[Column, Column]:
    """SLO-3: lag of a checkpoint; across receivers it is unobserved."""
    lag = F.when(receiver == source_receiver, source_sequence - sequence)
    return lag, maximum_check(lag, F.lit(most))


def freshness(age_s: Column) -> Column:
    """SLO-4: fresh up to five minutes, stale after; more than a minute in the future is a clock to distrust."""
    return F.when(age_s.isNull(), "unknown").when(age_s < -60, "clock_untrusted").when(age_s <= 300, "fresh").otherwise("stale")


def pipeline_status(stages: DataFrame) -> DataFrame:
    """SLO-5: incident > unknown > degraded > planned_stop > healthy over a pipeline's stages."""
    has = lambda s: F.bool_or(F.col("state") == s)
    return stages.groupBy("pipeline").agg(F.when(has("incident"), "incident").when(F.bool_or(F.col("state").isNull() | (F.col("state") == "unknown")), "unknown").when(has("degraded"), "degraded").when(has("planned_stop"), "planned_stop").otherwise("healthy").alias("status"))


def checkpoint_relation(down_receiver: Column, down_seq: Column, up_receiver: Column, up_seq: Column) -> Column:
    """SLO-6: equal, behind, ahead (an incident) or unknown across receivers."""
    unknown = down_receiver.isNull() | up_receiver.isNull() | down_seq.isNull() | up_seq.isNull() | (down_receiver != up_receiver)
    return F.when(unknown, "unknown").when(down_seq == up_seq, "equal").when(down_seq < up_seq, "behind").otherwise("ahead")


def coverage_complete(source: Column, load: Column, apply: Column, window_end: Column, matched: Column) -> Column:
    """SLO-7: all checkpoints stand where the matched window ends; false if anything is unknown."""
    return F.coalesce((source == load) & (load == apply) & (apply == window_end) & matched, F.lit(False))


def destination_status(measures: DataFrame) -> DataFrame:
    """REC-6: matched, mismatch, running or unknown from counters that may be unknown."""
    cols = ["source_rows", "raw_rows", "ledger_rows", "mirror_rows", "missing", "extra", "duplicates", "pending"]
    unknown = F.lit(False)
    for c in cols:
        unknown = unknown | F.col(c).isNull()
    wrong = (F.col("missing") > 0) & (F.col("pending") == 0) | (F.col("extra") > 0) | (F.col("duplicates") > 0) | (F.col("ledger_rows") > F.col("raw_rows"))
    done = (F.col("source_rows") == F.col("raw_rows")) & (F.col("raw_rows") == F.col("ledger_rows")) & (F.col("missing") == 0) & (F.col("pending") == 0)
    return measures.withColumn("state", F.when(unknown, "unknown").when(wrong, "mismatch").when(done, "matched").otherwise("running"))


def destination_progress(measures: DataFrame) -> DataFrame:
    """REC-6: the states of load and apply, and the position that both cover (null unless all three positions of one receiver are
    known; never beyond the source).  measures: id, source_rows, raw_rows, ledger_rows, pending, source_position, loaded_position,
    applied_position."""
    state = lambda have, want: (F.when(F.col(have).isNull() | F.col(want).isNull(), "unknown").when(F.col(have) > F.col(want), "ahead").when(F.col(have) < F.col(want), "running").otherwise("complete"))
    load = F.when(F.col("pending") > 0, F.when(F.col("raw_rows").isNull(), "unknown").otherwise("running")).otherwise(state("raw_rows", "source_rows"))
    places = ["source_position", "loaded_position", "applied_position"]
    known = F.col(places[0]).isNotNull() & F.col(places[1]).isNotNull() & F.col(places[2]).isNotNull()
    return measures.select("id", load.alias("load_state"), state("ledger_rows", "raw_rows").alias("apply_state"), F.when(known, F.least(*places)).alias("covered"))


def certification_verdict(cert: DataFrame, freshness_slo_s: int) -> DataFrame:
    """REC-8: the first reason that a certification fails, or certified."""
    c = F.col
    unknown = c("raw_rows").isNull() | c("ledger_rows").isNull() | c("raw_hash").isNull() | c("ledger_hash").isNull()
    why = (F.when(unknown, "unmeasured").when(c("raw_rows") != c("ledger_rows"), "counts_differ").when(c("raw_hash") != c("ledger_hash"), "hashes_differ").when(c("missing") > 0, "missing").when(c("extra") > 0, "extra")
           .when(c("duplicates") > 0, "duplicates").when(c("freshness_s").isNull(), "freshness_unknown").when(c("freshness_s") > freshness_slo_s, "stale").when(~c("cost_matches").eqNullSafe(True), "cost_differs"))
    return cert.withColumn("reason", why).withColumn("verdict", F.when(F.col("reason").isNull(), "certified").otherwise("refused"))


def archived_window(run: DataFrame, batches: DataFrame) -> DataFrame:
    """REC-10: a finished run's window: stopped by its budget, no errors, counts equal the listing, no id twice,
    one scope.  run: run, stopped_by, errors, batches, events; batches: run, batch_id, event_count, distinct_ids, scope."""
    listed = batches.groupBy("run").agg(F.count("*").alias("n_batches"), F.sum("event_count").alias("n_events"), F.sum("distinct_ids").alias("n_ids"), F.count_distinct("scope").alias("scopes"))
    x = run.join(listed, "run", "left")
    why = (F.when(F.col("stopped_by") != "budget", "not_stopped_by_budget").when(F.col("errors") > 0, "errors").when(F.col("n_batches").isNull(), "no_batches").when(F.col("batches") != F.col("n_batches"), "batch_count")
           .when(F.col("events") != F.col("n_events"), "event_count").when(F.col("n_ids") != F.col("n_events"), "repeated_id").when(F.col("scopes") != 1, "several_scopes"))
    return x.select("run", why.alias("reason"), why.isNull().alias("valid"))
