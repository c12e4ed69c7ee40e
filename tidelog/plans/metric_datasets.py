"""Counter samples, metric pages and health values derived from the change log.

The log is scraped every 15 minutes (a *slot*).  Counters restart from 0 every 10 days.
Counts per slot are aggregated from the log once and written; all else has one row per
slot and series, which follows the clock and not the size of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidelog.operators import alerts, jobs, metrics
from tidelog.plans import datasets as d
from tidelog.session import cut_lineage

SLOT_MS = 900_000
EPOCH_SLOTS = 960
DAY_SLOTS = 96
WEIGHT = 10_000  # events each row of the sparse test log stands for, in health rates
SAVED = {0: 41, 2: 76}  # what consumers have read of the archive, by partition
HOLD_SCALE = 12  # a rule's 5 minutes of 15 s evaluations become an hour of slots


def slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = d.flat_changes(spark, sf_dir)
    return log.withColumn("slot", F.expr(f"commit_time div {SLOT_MS}"))


def dense(counts: DataFrame, series: list[str], values: list[str]) -> DataFrame:
    """Every slot between the first and the last for every series, with 0 where nothing was counted."""
    first, last = counts.agg(F.min("slot")).scalar(), counts.agg(F.max("slot")).scalar()
    keys = counts.select(*series).distinct() if series else counts.limit(1).select()
    grid = keys.withColumn("slot", F.explode(F.sequence(first, last)))
    return grid.join(counts, [*series, "slot"], "left").fillna(0, values)


def cumulate(counts: DataFrame, series: list[str], count: str) -> DataFrame:
    """Counts per slot as counter samples `value` at `scrape_ms`."""
    w = W.partitionBy(*series, F.expr(f"slot div {EPOCH_SLOTS}")).orderBy("slot")  # 960 rows at most
    return counts.withColumn("value", F.sum(count).over(w)).withColumn(
        "scrape_ms", (F.col("slot") + 1) * SLOT_MS
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples of `ingested`, `replayed` and `failed` per table and operation."""
    failed = F.col("seq") % 11 == 0
    kinds = ["ingested", "replayed", "failed"]
    counted = cut_lineage(
        slotted(spark, sf_dir)
        .groupBy("tbl", "operation", "slot")
        .agg(
            F.count(F.lit(1)).alias("ingested"),
            F.count(F.when(~failed, F.lit(1))).alias("replayed"),
            F.count(F.when(failed, F.lit(1))).alias("failed"),
        )
    )
    full = dense(counted, ["tbl", "operation"], kinds)
    pairs = [F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in kinds]
    rows = full.select("tbl", "operation", "slot", F.inline(F.array(*pairs)))
    return cumulate(rows, ["tbl", "operation", "metric"], "n").select(
        "tbl", "operation", "metric", "scrape_ms", "value"
    )


def latency_seconds():
    return F.col("value") / 100


def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative ingest-latency bucket counters per archive partition."""
    rows = slotted(spark, sf_dir).withColumn("latency_s", latency_seconds())
    counted = cut_lineage(
        metrics.histogram(rows, ["part", "slot"], "latency_s", metrics.INGEST_BUCKETS).select(
            "part", "slot", "le", "count"
        )
    )
    full = dense(counted, ["part", "le"], ["count"])
    return cumulate(full, ["part", "le"], "count").select("part", "le", "scrape_ms", "value")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric page per scrape: the counters of all series, and lines a parser must skip."""
    line = F.format_string(
        'events_%s_total{table="%s",operation="%s"} %d', "metric", "tbl", "operation", "value"
    )
    per_page = samples(spark, sf_dir).groupBy("scrape_ms").agg(  # one line per series
        F.sort_array(F.collect_list(line)).alias("lines"), F.max("value").alias("top")
    )
    names = [f"events_{kind}_total" for kind in ("failed", "ingested", "replayed")]
    head = F.array(*[F.lit(t) for n in names for t in (f"# HELP {n} Total events", f"# TYPE {n} counter")])
    tail = F.array(
        F.lit("events_ingested_total 5 1700000000000"),
        F.lit("# a comment"),
        F.lit(""),
        F.lit("# HELP buffer_length Entries in the buffer"),
        F.lit("# TYPE buffer_length gauge"),
        F.format_string("  buffer_length %d.5e1  ", F.col("top")),
    )
    return per_page.select("scrape_ms", F.array_join(F.concat(head, "lines", tail), "\n").alias("text"))


def _during(first: int, last: int, cycle: int = DAY_SLOTS):
    return (F.col("slot") % cycle).between(first, last)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health values at every slot, with outages and slow hours at fixed times of the day."""
    failed = (F.col("seq") % 11 == 0) | (_during(45, 60) & (F.col("seq") % 3 == 0))
    rows = (
        slotted(spark, sf_dir)
        .withColumn("ingest_s", latency_seconds() + F.when(_during(18, 36), 2.0).otherwise(0.0))
        .withColumn("replay_s", F.col("value") / 1000 + F.when(_during(50, 62), 1.0).otherwise(0.0))
    )
    counted = cut_lineage(
        rows.groupBy("slot").agg(
            F.count(F.when(~_during(20, 31), F.lit(1))).alias("ingested"),
            F.count(F.when(~failed & ~_during(40, 55), F.lit(1))).alias("replayed"),
            F.count(F.when(failed, F.lit(1))).alias("failed"),
        )
    )
    slots = dense(counted, [], ["ingested", "replayed", "failed"])

    def trailing(count, slots_back):
        w = W.orderBy("slot").rowsBetween(1 - slots_back, W.currentRow)  # one row per slot
        return F.sum(count).over(w) * WEIGHT / (slots_back * SLOT_MS / 1000)

    def p99(value, buckets, name):
        per_slot = cut_lineage(metrics.histogram(rows, ["slot"], value, buckets).select("slot", "le", "count"))
        w = W.partitionBy("le").orderBy("slot").rowsBetween(-3, W.currentRow)
        recent = dense(per_slot, ["le"], ["count"]).withColumn("count", F.sum("count").over(w))
        return metrics.percentiles(recent, ["slot"], [0.99]).select("slot", F.col("value").alias(name))

    values = (
        slots.withColumn("ingest_rate", trailing("ingested", 4))
        .withColumn("replay_rate", trailing("replayed", 8))
        .withColumn("failure_share", alerts.failure_share(trailing("failed", 4), trailing("replayed", 4)))
        .withColumn("buffer_length", 85_000 + (F.col("slot") % DAY_SLOTS) * 100)
        .withColumn("active_jobs", F.when(F.col("slot") % DAY_SLOTS < 80, 1).otherwise(0))
        .withColumn("consumer_lag", (F.col("slot") % DAY_SLOTS) * 150)
        .withColumn("expired_leases", F.when(_during(33, 35), 1).otherwise(0))
        .withColumn("up", F.when(_during(5, 8, 48), 0).otherwise(1))
    )
    return (
        values.join(p99("ingest_s", metrics.INGEST_BUCKETS, "ingest_p99"), "slot")
        .join(p99("replay_s", metrics.REPLAY_BUCKETS, "replay_p99"), "slot")
        .withColumn("eval_ms", (F.col("slot") + 1) * SLOT_MS)
    )


def series_health(spark: SparkSession, sf_dir: str, range_ms: int, step_ms: int) -> dict[str, DataFrame]:
    """The inputs of alert rules, by name: `eval_ms`, `series`, `value`, from counters, gauges and jobs."""
    rates = cut_lineage(metrics.range_rate(samples(spark, sf_dir), ["tbl", "operation", "metric"], range_ms, step_ms))
    named = rates.withColumn("series", F.concat_ws(" ", "tbl", "operation"))
    of = lambda metric: named.where(F.col("metric") == metric).select("eval_ms", "series", F.col("rate").alias("value"))
    both = named.groupBy("eval_ms", "series").agg(
        *[F.max(F.when(F.col("metric") == k, F.col("rate"))).alias(k) for k in ("failed", "replayed")]
    )
    share = both.select("eval_ms", "series", alerts.failure_share(F.col("failed"), F.col("replayed")).alias("value"))
    p99 = metrics.quantile_over_rate(bucket_samples(spark, sf_dir), ["part"], range_ms, step_ms, [0.99])
    evaluations = rates.select("eval_ms").distinct()
    produced = _produced(spark, sf_dir, step_ms)
    saved = F.create_map(*[F.lit(x) for pair in SAVED.items() for x in pair])
    lag = produced.withColumn("value", F.col("n") - F.coalesce(F.try_element_at(saved, F.col("part")), F.lit(0)))
    length = produced.groupBy("eval_ms").agg(F.least(F.sum("n"), F.lit(metrics.BUFFER_CAPACITY)).alias("value"))
    rows = d.jobs(spark, sf_dir)
    active = jobs.active_counts(rows).select(F.col("state").alias("series"), F.col("jobs").alias("value"))
    lost = jobs.lease_expired(rows, d.JOBS_NOW_MS).select(F.lit("running").alias("series"), F.col("jobs").alias("value"))
    # Of jobs only the present is known, one or two values: they hold at every evaluation.
    listed = lambda now: now.agg(F.collect_list(F.struct("series", "value"))).scalar()
    always = lambda now: evaluations.select("eval_ms", F.inline(listed(now)))
    return {
        "ingest_rate": of("ingested"), "replay_rate": of("replayed"), "failure_share": share,
        "ingest_p99": p99.select("eval_ms", F.lit("all").alias("series"), "value"),
        "consumer_lag": lag.select("eval_ms", F.col("part").cast("string").alias("series"), "value"),
        "buffer_length": length.select("eval_ms", F.lit("hot").alias("series"), "value"),
        "active_jobs": always(active), "expired_leases": always(lost),
    }


def _produced(spark: SparkSession, sf_dir: str, step_ms: int) -> DataFrame:
    """How many rows of each archive partition are there at every evaluation (`eval_ms`, `part`, `n`)."""
    log = d.flat_changes(spark, sf_dir).withColumn("slot", F.expr(f"commit_time div {int(step_ms)}"))
    counted = cut_lineage(log.groupBy("part", "slot").agg(F.count(F.lit(1)).alias("count")))
    full = dense(counted, ["part"], ["count"])
    total = F.sum("count").over(W.partitionBy("part").orderBy("slot"))  # a row per evaluation
    return full.select("part", ((F.col("slot") + 1) * int(step_ms)).alias("eval_ms"), total.alias("n"))


def _bounds(buckets) -> str:
    return ", ".join(f"({b}::DOUBLE)" for b in buckets) + ", ('inf'::DOUBLE)"


def percentile_sql(source: str, label: str, points: str, last: str = "low") -> str:
    """Percentiles of the cumulative buckets (label, le, n) in `source`; `last` in the unbounded one."""
    return f"""SELECT {label}, p, CASE WHEN max(total) > 0 THEN arg_min(val, le) FILTER (n >= total * p) ELSE 0.0 END AS value FROM (
  SELECT *, CASE WHEN le <> 'inf'::DOUBLE AND n > below THEN low + (total * p - below) / (n - below) * (le - low)
      WHEN le <> 'inf'::DOUBLE THEN le ELSE {last} END AS val FROM (
    SELECT {label}, le, n, coalesce(lag(le) OVER (PARTITION BY {label} ORDER BY le), 0.0::DOUBLE) AS low,
      coalesce(lag(n) OVER (PARTITION BY {label} ORDER BY le), 0) AS below, max(n) OVER (PARTITION BY {label}) AS total
    FROM {source}) CROSS JOIN (VALUES {points}) t(p)) GROUP BY {label}, p"""


_INGEST, _REPLAY = _bounds(metrics.INGEST_BUCKETS), _bounds(metrics.REPLAY_BUCKETS)

CTE = {
    "slotted": f"slotted AS (SELECT *, commit_time // {SLOT_MS} AS slot FROM changes)",
    "slots": "slots AS (SELECT unnest(range((SELECT min(slot) FROM slotted), (SELECT max(slot) FROM slotted) + 1)) AS slot)",
    "samples": f"""samples AS (
  SELECT tbl, operation, metric, (slot + 1) * {SLOT_MS} AS scrape_ms, CAST(sum(n) OVER (
    PARTITION BY tbl, operation, metric, slot // {EPOCH_SLOTS} ORDER BY slot) AS BIGINT) AS value
  FROM (SELECT s.tbl, s.operation, m.metric, g.slot, count(c.seq) AS n
    FROM (SELECT DISTINCT tbl, operation FROM slotted) s CROSS JOIN slots g
    CROSS JOIN (VALUES ('ingested'), ('replayed'), ('failed')) m(metric)
    LEFT JOIN slotted c ON c.tbl = s.tbl AND c.operation = s.operation AND c.slot = g.slot
      AND (m.metric = 'ingested' OR (m.metric = 'failed') = (c.seq % 11 = 0))
    GROUP BY ALL))""",
    "bucket_samples": f"""bucket_samples AS (
  SELECT part, le, (slot + 1) * {SLOT_MS} AS scrape_ms, CAST(sum(n) OVER (
    PARTITION BY part, le, slot // {EPOCH_SLOTS} ORDER BY slot) AS BIGINT) AS value
  FROM (SELECT s.part, b.le, g.slot, count(c.seq) AS n
    FROM (SELECT DISTINCT part FROM slotted) s CROSS JOIN slots g CROSS JOIN (VALUES {_INGEST}) b(le)
    LEFT JOIN slotted c ON c.part = s.part AND c.slot = g.slot AND c.value / 100 <= b.le GROUP BY ALL))""",
    "health": f"""by_slot AS (SELECT g.slot,
    count(c.seq) FILTER (g.slot % 96 NOT BETWEEN 20 AND 31) AS ingested,
    count(c.seq) FILTER (NOT c.bad AND g.slot % 96 NOT BETWEEN 40 AND 55) AS replayed, count(c.seq) FILTER (c.bad) AS failed
  FROM slots g LEFT JOIN (SELECT *, seq % 11 = 0 OR (slot % 96 BETWEEN 45 AND 60 AND seq % 3 = 0) AS bad FROM slotted) c USING (slot)
  GROUP BY g.slot),
rates AS (SELECT slot, sum(ingested) OVER four * {WEIGHT} / 3600.0::DOUBLE AS ingest_rate,
    sum(replayed) OVER eight * {WEIGHT} / 7200.0::DOUBLE AS replay_rate,
    sum(failed) OVER four * {WEIGHT} / 3600.0::DOUBLE AS failed_rate, sum(replayed) OVER four * {WEIGHT} / 3600.0::DOUBLE AS replayed_rate
  FROM by_slot WINDOW four AS (ORDER BY slot ROWS 3 PRECEDING), eight AS (ORDER BY slot ROWS 7 PRECEDING)),
ingest_b AS (SELECT slot, le, sum(n) OVER (PARTITION BY le ORDER BY slot ROWS 3 PRECEDING) AS n FROM (
  SELECT g.slot, b.le, count(c.seq) AS n FROM slots g CROSS JOIN (VALUES {_INGEST}) b(le) LEFT JOIN slotted c ON c.slot = g.slot
    AND c.value / 100 + CASE WHEN c.slot % 96 BETWEEN 18 AND 36 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END <= b.le GROUP BY ALL)),
replay_b AS (SELECT slot, le, sum(n) OVER (PARTITION BY le ORDER BY slot ROWS 3 PRECEDING) AS n FROM (
  SELECT g.slot, b.le, count(c.seq) AS n FROM slots g CROSS JOIN (VALUES {_REPLAY}) b(le) LEFT JOIN slotted c ON c.slot = g.slot
    AND c.value / 1000 + CASE WHEN c.slot % 96 BETWEEN 50 AND 62 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END <= b.le GROUP BY ALL)),
ingest_p AS ({percentile_sql("ingest_b", "slot", "(0.99::DOUBLE)")}),
replay_p AS ({percentile_sql("replay_b", "slot", "(0.99::DOUBLE)")}),
health AS (SELECT (r.slot + 1) * {SLOT_MS} AS eval_ms, r.slot % 96 AS s, r.slot, ingest_rate, replay_rate,
    failed_rate / greatest(failed_rate + replayed_rate, 1.0::DOUBLE) AS failure_share, i.value AS ingest_p99, p.value AS replay_p99
  FROM rates r JOIN ingest_p i USING (slot) JOIN replay_p p ON p.slot = r.slot)""",
    "held": """held AS (
  SELECT eval_ms, 'IngestorStalled' AS alert, 'critical' AS severity, 'ingestor' AS component, ingest_rate AS value, 60 AS hold_min
    FROM health WHERE ingest_rate = 0
  UNION ALL SELECT eval_ms, 'HighIngestLatency', 'warning', 'ingestor', ingest_p99, 60 FROM health WHERE ingest_p99 > 1
  UNION ALL SELECT eval_ms, 'RedisStreamNearCapacity', 'warning', 'redis', 85000 + s * 100, 24 FROM health WHERE s > 50
  UNION ALL SELECT eval_ms, 'ReplayerStalled', 'critical', 'replayer', replay_rate, 120 FROM health WHERE replay_rate = 0 AND s < 80
  UNION ALL SELECT eval_ms, 'ReplayerHighFailureRate', 'warning', 'replayer', failure_share, 60 FROM health WHERE failure_share > 0.05::DOUBLE
  UNION ALL SELECT eval_ms, 'HighReplayLatency', 'warning', 'replayer', replay_p99, 60 FROM health WHERE replay_p99 > 0.5::DOUBLE
  UNION ALL SELECT eval_ms, 'KafkaConsumerLagCritical', 'critical', 'kafka', s * 150, 60 FROM health WHERE s * 150 > 10000
  UNION ALL SELECT eval_ms, 'JobLeaseExpiredWithRunningState', 'warning', 'jobs', 1, 12 FROM health WHERE s BETWEEN 33 AND 35
  UNION ALL SELECT eval_ms, 'ControlPlaneDown', 'critical', 'control', 0, 24 FROM health WHERE slot % 48 BETWEEN 5 AND 8)""",
    "firing": f"""firing AS (SELECT * FROM (SELECT *, min(eval_ms) OVER (PARTITION BY alert, run) AS active_ms FROM (
    SELECT *, eval_ms - {SLOT_MS} * row_number() OVER (PARTITION BY alert ORDER BY eval_ms) AS run FROM held))
  WHERE eval_ms - active_ms >= hold_min * 60000)""",
    "active": """active AS (SELECT * FROM firing f WHERE severity = 'critical' OR NOT EXISTS (SELECT 1 FROM firing c
  WHERE c.severity = 'critical' AND c.component = f.component AND c.eval_ms = f.eval_ms))""",
}


def with_ctes(*names: str) -> str:
    return "WITH " + ",\n".join([d.CTE["changes"]] + [CTE[n] for n in names]) + "\n"
