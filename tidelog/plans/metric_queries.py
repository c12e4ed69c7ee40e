"""Queries over counters, histograms, rates and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import alerts, dedup, metrics, replay
from tidelog.plans import datasets as d, metric_datasets as m
from tidelog.plans.registry import query

_CHANGES = d.with_ctes("changes")
_DELIVERIES = d.with_ctes("changes", "images", "keyed", "ledger", "deliveries")
_SAMPLES = m.with_ctes("slotted", "slots", "samples")
_HEALTH = ["slotted", "slots", "health", "held"]
_LE = "CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE CAST(le AS VARCHAR) END"
RANGE_MS = 5 * m.SLOT_MS
STEP_MS = 2 * m.SLOT_MS


def _le_text():
    return F.when(F.col("le") == float("inf"), F.lit("+Inf")).otherwise(F.col("le").cast("string")).alias("le")


@query(
    "event_counts",
    _DELIVERIES.rstrip()
    + """,
counted AS (SELECT tbl, operation, x.metric, count(*)::BIGINT AS value FROM deliveries
  JOIN (VALUES ('ingested'), ('duplicates'), ('replayed'), ('failed')) x(metric) ON CASE x.metric
    WHEN 'ingested' THEN copy = 0 WHEN 'duplicates' THEN copy = 1 WHEN 'replayed' THEN copy = 0 AND seq % 11 <> 0
    ELSE copy = 0 AND seq % 11 = 0 END GROUP BY ALL)
SELECT tbl, operation, metric, value FROM counted""",
)
def event_counts(spark, sf_dir):
    first, failed = F.col("copy") == 0, F.col("seq") % 11 == 0
    conditions = {"ingested": first, "duplicates": ~first, "replayed": first & ~failed, "failed": first & failed}
    rows = d.deliveries(spark, sf_dir).select("tbl", "operation", "copy", "seq")
    return metrics.counters(rows, ["tbl", "operation"], conditions)


_HISTOGRAM = (
    _CHANGES.rstrip()
    + f""",
hist AS (SELECT part, le, count(*) FILTER (value / 100 <= le) AS n, count(value) AS total, round(sum(value / 100), 4) AS sum
  FROM changes CROSS JOIN (VALUES {m._INGEST}) b(le) GROUP BY part, le)
"""
)


def _histogram(spark, sf_dir):
    rows = d.flat_changes(spark, sf_dir).withColumn("latency_s", m.latency_seconds())
    return metrics.histogram(rows, ["part"], "latency_s", metrics.INGEST_BUCKETS)


@query("latency_histogram", _HISTOGRAM + f"SELECT part, {_LE} AS le, n::BIGINT AS count, total::BIGINT AS total, sum FROM hist")
def latency_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir).select("part", _le_text(), "count", "total", F.round("sum", 4).alias("sum"))


@query(
    "histogram_percentiles",
    f"{_HISTOGRAM.rstrip()},\npct AS ({m.percentile_sql('hist', 'part', '(0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)', last="'inf'::DOUBLE")}) SELECT part, p, round(value, 9) AS value FROM pct",
)
def histogram_percentiles(spark, sf_dir):
    found = metrics.percentiles(_histogram(spark, sf_dir), ["part"], unbounded=float("inf"))
    return found.select("part", "p", F.round("value", 9).alias("value"))


@query(
    "buffer_length_samples",
    """SELECT seq, n, least(n, 2000) AS length FROM (
  SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n % 100 = 0""",
)
def buffer_length_samples(spark, sf_dir):
    sampled = metrics.sampled_gauge(d.flat_changes(spark, sf_dir).select("seq"), 2000)
    return sampled.select("seq", "n", F.col("length").cast("bigint").alias("length"))


_PARSED = (
    _SAMPLES.rstrip()
    + """,
parsed AS (
  SELECT scrape_ms, 'events_' || metric || '_total' AS name, tbl, operation, value::DOUBLE AS value, 'Total events' AS help,
    'counter' AS type, row_number() OVER (PARTITION BY scrape_ms ORDER BY metric, tbl, operation) + 5 AS pos
  FROM samples
  UNION ALL SELECT scrape_ms, 'buffer_length', NULL, NULL, (max(value)::VARCHAR || '.5e1')::DOUBLE, 'Entries in the buffer', 'gauge', count(*) + 11
  FROM samples GROUP BY scrape_ms)
"""
)


def _parsed(spark, sf_dir):
    return metrics.parse_pages(m.pages(spark, sf_dir), ["scrape_ms"])


@query(
    "metrics_parse",
    _PARSED + "SELECT scrape_ms, CAST(pos AS INT) AS pos, name, tbl, operation, value, help, type FROM parsed",
)
def metrics_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "scrape_ms", "pos", "name", F.col("labels")["table"].alias("tbl"),
        F.col("labels")["operation"].alias("operation"), "value", "help", "type",
    )


@query(
    "metric_families",
    _PARSED
    + """SELECT scrape_ms, replace(name, '_total', '') AS family, help, type, count(*)::BIGINT AS samples
FROM parsed GROUP BY ALL""",
)
def metric_families(spark, sf_dir):
    return metrics.families(_parsed(spark, sf_dir), ["scrape_ms"])


@query(
    "metric_by_label",
    _PARSED
    + """SELECT l.scrape_ms, l.operation, l.value, f.value AS first_value FROM (
  SELECT scrape_ms, operation, max_by(value, pos) AS value FROM parsed WHERE operation IS NOT NULL
    AND name = 'events_ingested_total' GROUP BY ALL) l
JOIN (SELECT scrape_ms, min_by(value, pos) AS value FROM parsed WHERE tbl = 'public.t1' AND name = 'events_ingested_total' GROUP BY ALL) f USING (scrape_ms)""",
)
def metric_by_label(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    last = metrics.by_label(parsed, ["scrape_ms"], "events_ingested_total", "operation")
    first = metrics.lookup(parsed, ["scrape_ms"], "events_ingested_total", {"table": "public.t1"})
    return last.join(first.withColumnRenamed("value", "first_value"), "scrape_ms")


@query(
    "snapshot_rate",
    _SAMPLES
    + """SELECT tbl, operation, metric, scrape_ms, CASE WHEN d IS NULL OR d < 0 THEN 0.0 ELSE d / ms * 1000 END AS rate FROM (
  SELECT *, value - lag(value) OVER w AS d, scrape_ms - lag(scrape_ms) OVER w AS ms FROM samples
  WINDOW w AS (PARTITION BY tbl, operation, metric ORDER BY scrape_ms))""",
)
def snapshot_rate(spark, sf_dir):
    rates = metrics.snapshot_rate(m.samples(spark, sf_dir), ["tbl", "operation", "metric"])
    return rates.select("tbl", "operation", "metric", "scrape_ms", "rate")


def _total(condition):
    return f"coalesce(sum(value) FILTER ({condition}), 0)::BIGINT"


@query(
    "metrics_snapshot",
    _SAMPLES.rstrip()
    + f""",
wide AS (SELECT scrape_ms, {_total("metric = 'ingested'")} AS ingested, {_total("metric = 'replayed'")} AS replayed,
  {_total("metric = 'failed'")} AS failed,
  {_total("metric = 'ingested' AND operation = 'INSERT'")} AS ingested_insert,
  {_total("metric = 'ingested' AND operation = 'UPDATE'")} AS ingested_update,
  {_total("metric = 'ingested' AND operation = 'DELETE'")} AS ingested_delete,
  {_total("metric = 'ingested' AND operation = 'TRUNCATE'")} AS ingested_truncate FROM samples GROUP BY scrape_ms)
SELECT *, CASE WHEN ingested < lag(ingested) OVER w OR lag(ingested) OVER w IS NULL THEN 0.0
    ELSE (ingested - lag(ingested) OVER w) / (scrape_ms - lag(scrape_ms) OVER w) * 1000 END AS ingested_rate,
  CASE WHEN replayed < lag(replayed) OVER w OR lag(replayed) OVER w IS NULL THEN 0.0
    ELSE (replayed - lag(replayed) OVER w) / (scrape_ms - lag(scrape_ms) OVER w) * 1000 END AS replayed_rate
FROM wide WINDOW w AS (ORDER BY scrape_ms) ORDER BY scrape_ms DESC LIMIT 60""",
)
def metrics_snapshot(spark, sf_dir):
    return metrics.snapshots(m.samples(spark, sf_dir))


@query(
    "replay_shares",
    _DELIVERIES.rstrip()
    + f""",
outcomes AS (SELECT CASE WHEN l.idempotency_key IS NOT NULL THEN 'duplicate_skipped' WHEN d.seq % 37 = 0 THEN 'failed'
    ELSE 'applied' END AS outcome FROM deliveries d
  LEFT JOIN ledger l ON l.idempotency_key = d.idempotency_key AND l.expires_at > {d.NOW_MS})
SELECT outcome, count(*)::BIGINT AS events, round(count(*) / (SELECT count(*) FROM outcomes) * 100, 1) AS share,
  (SELECT round(count(*) FILTER (outcome = 'failed') / count(*) FILTER (outcome <> 'duplicate_skipped') * 100, 3) FROM outcomes) AS failure_rate
FROM outcomes GROUP BY outcome""",
)
def replay_shares(spark, sf_dir):
    operation = F.when(F.col("seq") % 37 == 0, F.lit("MERGE")).otherwise(F.col("operation"))
    rows = d.deliveries(spark, sf_dir).withColumn("operation", operation)
    return metrics.replay_shares(dedup.classify(rows, d.ledger(spark, sf_dir), d.NOW_MS))


@query(
    "buffer_utilisation",
    _SAMPLES
    + """SELECT scrape_ms, used, CASE WHEN used < 50 THEN 'green' WHEN used < 80 THEN 'yellow' ELSE 'red' END AS buffer_band,
  CASE WHEN load < 33 THEN 'green' WHEN load < 66 THEN 'yellow' ELSE 'red' END AS load_band FROM (
  SELECT scrape_ms, least(sum(value) / 30000 * 100, 100.0) AS used, least(sum(value) / 20000 * 100, 100.0) AS load
  FROM samples WHERE metric = 'ingested' GROUP BY scrape_ms)""",
)
def buffer_utilisation(spark, sf_dir):
    per_scrape = m.samples(spark, sf_dir).where("metric = 'ingested'").groupBy("scrape_ms").agg(F.sum("value").alias("n"))
    used, load = metrics.utilisation(F.col("n"), 30_000), metrics.utilisation(F.col("n"), 20_000)
    return per_scrape.select(
        "scrape_ms", used.alias("used"), metrics.band(used, metrics.BUFFER_BANDS).alias("buffer_band"),
        metrics.band(load, metrics.THROUGHPUT_BANDS).alias("load_band"),
    )


def _range_rate_sql(source: str, series: str) -> str:
    return f"SELECT {series}, eval_ms, rise::BIGINT / (span_ms / 1000) AS rate FROM ({_range_rise_sql(source, series)})"


def _range_rise_sql(source: str, series: str) -> str:
    return f"""SELECT {series}, e.eval_ms, sum(rise)::HUGEINT AS rise, max(scrape_ms) - min(prev_ms) AS span_ms FROM (
  SELECT *, lag(scrape_ms) OVER w AS prev_ms, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS rise
  FROM {source} WINDOW w AS (PARTITION BY {series} ORDER BY scrape_ms)) c
JOIN (SELECT unnest(range((SELECT min(scrape_ms) // {STEP_MS} * {STEP_MS} FROM {source}),
  (SELECT max(scrape_ms) FROM {source}) + {RANGE_MS} + {STEP_MS}, {STEP_MS})) AS eval_ms) e
  ON c.prev_ms > e.eval_ms - {RANGE_MS} AND c.scrape_ms <= e.eval_ms
GROUP BY {series}, e.eval_ms"""


@query("range_rate", _SAMPLES + _range_rate_sql("samples", "tbl, operation, metric"))
def range_rate(spark, sf_dir):
    return metrics.range_rate(m.samples(spark, sf_dir), ["tbl", "operation", "metric"], RANGE_MS, STEP_MS)


@query(
    "quantile_over_rate",
    m.with_ctes("slotted", "slots", "bucket_samples").rstrip()
    + f""",
rises AS ({_range_rise_sql("bucket_samples", "part, le")}),
summed AS (SELECT eval_ms, le, CAST(sum((rise * 1000000000000 + span_ms // 2) // span_ms) AS BIGINT) AS n FROM rises GROUP BY eval_ms, le),
pct AS ({m.percentile_sql("summed", "eval_ms", "(0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)")})
SELECT eval_ms, p, round(value, 6) AS value FROM pct""",
)
def quantile_over_rate(spark, sf_dir):
    found = metrics.quantile_over_rate(m.bucket_samples(spark, sf_dir), ["part"], RANGE_MS, STEP_MS)
    return found.select("eval_ms", "p", F.round("value", 6).alias("value"))


def _held(spark, sf_dir):
    return alerts.predicates(m.health(spark, sf_dir))


def _firing(spark, sf_dir):
    return alerts.firing(_held(spark, sf_dir), m.SLOT_MS, alerts.hold_times(scale=m.HOLD_SCALE))


@query(
    "alert_predicates",
    m.with_ctes(*_HEALTH) + "SELECT eval_ms, alert, severity, component, round(value, 9)::DOUBLE AS value FROM held",
)
def alert_predicates(spark, sf_dir):
    return _held(spark, sf_dir).withColumn("value", F.round("value", 9))


@query("alert_firing", m.with_ctes(*_HEALTH, "firing") + "SELECT eval_ms, alert, severity, component, active_ms FROM firing")
def alert_firing(spark, sf_dir):
    return _firing(spark, sf_dir).drop("value")


@query("alert_inhibition", m.with_ctes(*_HEALTH, "firing", "active") + "SELECT eval_ms, alert, severity, component FROM active")
def alert_inhibition(spark, sf_dir):
    return alerts.inhibit(_firing(spark, sf_dir)).select("eval_ms", "alert", "severity", "component")


@query(
    "alert_notifications",
    m.with_ctes(*_HEALTH, "firing", "active").rstrip()
    + f""",
runs AS (SELECT alert, severity, component, min(eval_ms) AS fires_ms, max(eval_ms) + {m.SLOT_MS} AS resolved_ms,
  CASE severity WHEN 'critical' THEN 30000 ELSE 300000 END AS wait, CASE severity WHEN 'critical' THEN 60000 ELSE 300000 END AS chk,
  CASE severity WHEN 'critical' THEN 900000 ELSE 3600000 END AS rep FROM (
  SELECT *, eval_ms - {m.SLOT_MS} * row_number() OVER (PARTITION BY alert ORDER BY eval_ms) AS island FROM active)
  GROUP BY alert, severity, component, island)
SELECT alert, severity, component, fires_ms, unnest(range(fires_ms + wait, resolved_ms, rep)) AS notify_ms, 'firing' AS status
FROM runs WHERE fires_ms + wait < resolved_ms
UNION ALL SELECT alert, severity, component, fires_ms,
  (fires_ms + wait + ceil((resolved_ms - fires_ms - wait) / chk) * chk)::BIGINT, 'resolved' FROM runs WHERE fires_ms + wait < resolved_ms""",
)
def alert_notifications(spark, sf_dir):
    return alerts.notifications(alerts.inhibit(_firing(spark, sf_dir)), m.SLOT_MS)


@query(
    "alert_series",
    m.with_ctes("slotted", "slots", "samples", "bucket_samples").rstrip()
    + f""",
{d.CTE["jobs"]},
rates AS ({_range_rate_sql("samples", "tbl, operation, metric")}),
named AS (SELECT eval_ms, tbl || ' ' || operation AS series, max(rate) FILTER (metric = 'ingested') AS ingested,
  max(rate) FILTER (metric = 'replayed') AS replayed, max(rate) FILTER (metric = 'failed') AS failed FROM rates GROUP BY ALL),
rises AS ({_range_rise_sql("bucket_samples", "part, le")}),
summed AS (SELECT eval_ms, le, CAST(sum((rise * 1000000000000 + span_ms // 2) // span_ms) AS BIGINT) AS n FROM rises GROUP BY eval_ms, le),
pct AS ({m.percentile_sql("summed", "eval_ms", "(0.99::DOUBLE)")}),
steps AS (SELECT DISTINCT eval_ms FROM rates),
ends AS (SELECT (unnest(range((SELECT min(commit_time) // {STEP_MS} FROM changes), (SELECT max(commit_time) // {STEP_MS} FROM changes) + 1)) + 1) * {STEP_MS} AS eval_ms),
produced AS (SELECT e.eval_ms, p.part, count(c.seq) AS n FROM ends e CROSS JOIN (SELECT DISTINCT part FROM changes) p
  LEFT JOIN changes c ON c.part = p.part AND c.commit_time < e.eval_ms GROUP BY ALL),
held AS (
  SELECT eval_ms, series, 'IngestorStalled' AS alert, 'critical' AS severity, 'ingestor' AS component, 5 AS hold_min FROM named WHERE ingested = 0
  UNION ALL SELECT eval_ms, 'all', 'HighIngestLatency', 'warning', 'ingestor', 5 FROM pct WHERE value > 1
  UNION ALL SELECT eval_ms, 'hot', 'RedisStreamNearCapacity', 'warning', 'redis', 2 FROM produced GROUP BY eval_ms HAVING least(sum(n), 100000) > 90000
  UNION ALL SELECT eval_ms, series, 'ReplayerStalled', 'critical', 'replayer', 10 FROM named
    WHERE replayed = 0 AND (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')) > 0
  UNION ALL SELECT eval_ms, series, 'ReplayerHighFailureRate', 'warning', 'replayer', 5 FROM named
    WHERE failed / greatest(replayed + failed, 1.0::DOUBLE) > 0.05::DOUBLE
  UNION ALL SELECT eval_ms, part::VARCHAR, 'KafkaConsumerLagCritical', 'critical', 'kafka', 5 FROM produced
    WHERE n - CASE part WHEN 0 THEN 41 WHEN 2 THEN 76 ELSE 0 END > 10000
  UNION ALL SELECT eval_ms, 'running', 'JobLeaseExpiredWithRunningState', 'warning', 'jobs', 1 FROM steps
    WHERE (SELECT count(*) FROM jobs WHERE status = 'running' AND lease_expires_ms < {d.JOBS_NOW_MS}) > 0),
fired AS (SELECT * FROM (SELECT *, min(eval_ms) OVER (PARTITION BY alert, series, run) AS active_ms FROM (
    SELECT *, eval_ms - {STEP_MS} * row_number() OVER (PARTITION BY alert, series ORDER BY eval_ms) AS run FROM held))
  WHERE eval_ms - active_ms >= hold_min * 60000)
SELECT eval_ms, alert, severity, component, series, active_ms FROM fired f WHERE severity = 'critical' OR NOT EXISTS (
  SELECT 1 FROM fired c WHERE c.severity = 'critical' AND c.component = f.component AND c.eval_ms = f.eval_ms)""",
)
def alert_series(spark, sf_dir):
    """Rules over every series of real inputs, with their own hold times; critical alerts mute warnings of their component."""
    held = alerts.series_predicates(m.series_health(spark, sf_dir, RANGE_MS, STEP_MS))
    fired = alerts.series_firing(held, STEP_MS, alerts.hold_times())
    return alerts.inhibit(fired).select("eval_ms", "alert", "severity", "component", "series", "active_ms")


@query(
    "consumer_lag",
    _CHANGES
    + """SELECT part, lag, lag > 100 AS critical FROM (SELECT part, max(off) + 1 - CASE part WHEN 0 THEN 41 WHEN 2 THEN 76 ELSE 0 END AS lag
  FROM changes GROUP BY part)""",
)
def consumer_lag(spark, sf_dir):
    saved = [(int(p), int(o)) for p, o in replay.checkpoint_map('{"0": 40, "2": 75}').items()]
    checkpoint = spark.createDataFrame(saved, "part int, checkpoint_off bigint")
    return metrics.consumer_lag(d.archive(spark, sf_dir), checkpoint, threshold=100)
