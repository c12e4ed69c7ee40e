"""Alert rules over a table of health values: predicates, hold times, inhibition, notifications.

All tables here have one row per evaluation time (and rule), so their size follows the
clock and the number of rules, not the log.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.operators import segments
from tidelog.session import cut_lineage

MINUTE_MS = 60_000


@dataclass(frozen=True)
class Rule:
    alert: str
    severity: str
    component: str
    hold_ms: int
    value: str  # health column the alert reports
    above: float | None = None
    equals: float | None = None
    while_positive: str | None = None  # the rule only counts while this column is above 0

    def holds(self) -> Column:
        met = F.col(self.value) > self.above if self.above is not None else F.col(self.value) == self.equals
        return met & (F.col(self.while_positive) > 0) if self.while_positive else met


# The alert rules.
RULES = (
    Rule("IngestorStalled", "critical", "ingestor", 5 * MINUTE_MS, "ingest_rate", equals=0),
    Rule("HighIngestLatency", "warning", "ingestor", 5 * MINUTE_MS, "ingest_p99", above=1),
    Rule("RedisStreamNearCapacity", "warning", "redis", 2 * MINUTE_MS, "buffer_length", above=90_000),
    Rule("ReplayerStalled", "critical", "replayer", 10 * MINUTE_MS, "replay_rate", equals=0, while_positive="active_jobs"),
    Rule("ReplayerHighFailureRate", "warning", "replayer", 5 * MINUTE_MS, "failure_share", above=0.05),
    Rule("HighReplayLatency", "warning", "replayer", 5 * MINUTE_MS, "replay_p99", above=0.5),
    Rule("KafkaConsumerLagCritical", "critical", "kafka", 5 * MINUTE_MS, "consumer_lag", above=10_000),
    Rule("JobLeaseExpiredWithRunningState", "warning", "jobs", 1 * MINUTE_MS, "expired_leases", above=0),
    Rule("ControlPlaneDown", "critical", "control", 2 * MINUTE_MS, "up", equals=0),
)

# Wait before the first notification, check interval, and repeat interval.
ROUTES = {
    "critical": (30_000, 60_000, 15 * MINUTE_MS),
    "warning": (5 * MINUTE_MS, 5 * MINUTE_MS, 60 * MINUTE_MS),
}


def failure_share(failed_rate: Column, replayed_rate: Column) -> Column:
    """Failed per attempt, with the rate of attempts taken as at least 1 per second."""
    return failed_rate / F.greatest(replayed_rate + failed_rate, F.lit(1.0))


def predicates(health: DataFrame, rules=RULES) -> DataFrame:
    """One row per evaluation time and rule whose condition holds (`eval_ms`, alert, ..., value)."""
    cases = [
        F.struct(
            F.lit(r.alert).alias("alert"), F.lit(r.severity).alias("severity"),
            F.lit(r.component).alias("component"), F.col(r.value).cast("double").alias("value"),
            r.holds().alias("_met"),
        )
        for r in rules
    ]
    return health.select("eval_ms", F.inline(F.array(*cases))).where("_met").drop("_met")


def hold_times(rules=RULES, scale: float = 1.0) -> dict[str, int]:
    return {r.alert: int(r.hold_ms * scale) for r in rules}


def islands(rows: DataFrame, step_ms: int, time: str = "eval_ms") -> DataFrame:
    """Add `active_ms`, the start of the unbroken run of evaluations a row belongs to."""
    w = W.partitionBy("alert").orderBy(time)
    breaks = F.col(time) - F.lag(time).over(w) != step_ms
    started = F.when(F.coalesce(breaks, F.lit(True)), F.col(time))
    return rows.withColumn("_start", started).withColumn(
        "active_ms", F.last("_start", True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    ).drop("_start")


def firing(held: DataFrame, step_ms: int, holds: Mapping[str, int]) -> DataFrame:
    """Evaluations at which an alert fires: its condition has held without a break for its hold time."""
    hold = F.create_map(*[F.lit(x) for pair in holds.items() for x in pair])[F.col("alert")]
    return islands(held, step_ms).where(F.col("eval_ms") - F.col("active_ms") >= hold)


def intervals(fired: DataFrame, step_ms: int) -> DataFrame:
    """Firing evaluations as intervals: first firing, and the evaluation that resolves it."""
    runs = islands(fired.drop("active_ms"), step_ms)
    return runs.groupBy("alert", "severity", "component", F.col("active_ms").alias("fires_ms")).agg(
        (F.max("eval_ms") + step_ms).alias("resolved_ms")
    )


def inhibit(fired: DataFrame) -> DataFrame:
    """Firing evaluations without the warnings whose component has a critical alert at the time."""
    critical = fired.where("severity = 'critical'").select("component", "eval_ms").distinct()
    muted = critical.withColumn("severity", F.lit("warning"))
    return fired.join(muted, ["component", "eval_ms", "severity"], "left_anti")


def notifications(active: DataFrame, step_ms: int, routes=ROUTES) -> DataFrame:
    """When each alert notifies: after the wait, at every repeat while it fires, and once resolved.

    Alerts are grouped by name.  A group is looked at every check interval from its first
    notification on; an alert that ends before that is never notified.
    """

    def setting(index):
        return F.create_map(*[x for s, r in routes.items() for x in (F.lit(s), F.lit(r[index]))])[F.col("severity")]

    runs = intervals(active, step_ms)
    first, check = F.col("fires_ms") + setting(0), setting(1)
    repeat = F.ceil(setting(2) / check) * check
    runs = runs.withColumn("_first", first).where(F.col("_first") < F.col("resolved_ms"))
    repeats = F.transform(
        F.sequence(F.col("_first"), F.col("resolved_ms") - 1, repeat),
        lambda t: F.struct(t.alias("notify_ms"), F.lit("firing").alias("status")),
    )
    end = F.col("_first") + F.ceil((F.col("resolved_ms") - F.col("_first")) / check) * check
    resolved = F.array(F.struct(end.alias("notify_ms"), F.lit("resolved").alias("status")))
    return runs.select("alert", "severity", "component", "fires_ms", F.inline(F.concat(repeats, resolved)))


# --- rules that see every series ---------------------------------------------------


def series_predicates(inputs: Mapping[str, DataFrame], rules=RULES) -> DataFrame:
    """One row per evaluation, series and rule whose condition holds.

    `inputs` has, by the name of a health value, its `eval_ms`, `series` and `value`.  A rule that
    only counts while another value is positive is asked whether any series of that one is.  Rules
    without input are left out.
    """
    out = None
    for r in rules:
        if r.value not in inputs or r.while_positive and r.while_positive not in inputs:
            continue
        rows = inputs[r.value].withColumnRenamed("value", r.value)
        if r.while_positive:
            other = inputs[r.while_positive].groupBy("eval_ms").agg(F.max("value").alias(r.while_positive))
            rows = rows.join(other, "eval_ms")
        held = rows.where(r.holds()).select(
            "eval_ms", "series", F.lit(r.alert).alias("alert"), F.lit(r.severity).alias("severity"),
            F.lit(r.component).alias("component"), F.col(r.value).cast("double").alias("value"),
        )
        out = held if out is None else out.unionByName(held)
    if out is None:
        raise ValueError("no rule has an input")
    return out


def series_firing(held: DataFrame, step_ms: int, holds: Mapping[str, int], width: int = 10_000) -> DataFrame:
    """Evaluations at which an alert fires for a series: its condition has held for its hold time.

    Adds `active_ms`, since when.  An unbroken run may be as long as the clock has run, so it is
    found per block of `width` evaluations, with a carry from block to block.
    """
    by = ["alert", "series"]
    # Written once: every scan reads it twice.
    at = cut_lineage(held.withColumn("_at", F.expr(f"eval_ms div {int(step_ms)}")))
    at = segments.previous(at, by, "_at", F.col("_at"), "_before", width)
    started = F.when(F.col("_before").isNull() | (F.col("_at") - F.col("_before") != 1), F.col("eval_ms"))
    runs = segments.running_max(at, by, "_at", started, "active_ms", width).drop("_at", "_before")
    hold = F.create_map(*[F.lit(x) for pair in holds.items() for x in pair])[F.col("alert")]
    return runs.where(F.col("eval_ms") - F.col("active_ms") >= hold)
