"""Queries over jobs, recent events and the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import browse, jobs, requests
from tidelog.plans import datasets as d
from tidelog.plans.registry import query

_JOBS = d.with_ctes("jobs")
_CHANGES = d.with_ctes("changes")
_HOT = d.with_ctes("changes", "hot")
_REQUESTS = d.with_ctes("requests")
_NOW = d.JOBS_NOW_MS
PAGED_MS = 820_454_400_000  # 1996-01-01 00:00:00 UTC, where a deep page of jobs begins


@query(
    "jobs_page",
    _JOBS
    + """SELECT job_id, created_ms, status, (SELECT count(*) FROM jobs WHERE status = 'failed')::BIGINT AS total,
  (SELECT ceil(count(*) / 20) FROM jobs WHERE status = 'failed')::BIGINT AS pages
FROM jobs WHERE status = 'failed' ORDER BY created_ms DESC, job_id DESC LIMIT 20 OFFSET 40""",
)
def jobs_page(spark, sf_dir):
    rows = jobs.page(d.jobs(spark, sf_dir), "failed", number=3)
    return rows.select("job_id", "created_ms", "status", "total", "pages")


@query(
    "jobs_page_after",
    _JOBS
    + f"""SELECT job_id, created_ms, status FROM jobs
WHERE created_ms < {PAGED_MS} OR (created_ms = {PAGED_MS} AND job_id < 5000)
ORDER BY created_ms DESC, job_id DESC LIMIT 50""",
)
def jobs_page_after(spark, sf_dir):
    rows = jobs.page_after(d.jobs(spark, sf_dir), None, PAGED_MS, 5000, size=50)
    return rows.select("job_id", "created_ms", "status")


@query(
    "jobs_active",
    _JOBS
    + """SELECT state, count(j.job_id)::BIGINT AS jobs FROM (VALUES ('queued'), ('running')) s(state)
LEFT JOIN jobs j ON j.status = s.state GROUP BY state""",
)
def jobs_active(spark, sf_dir):
    return jobs.active_counts(d.jobs(spark, sf_dir))


@query(
    "lease_expired",
    _JOBS + f"SELECT count(*)::BIGINT AS jobs FROM jobs WHERE status = 'running' AND lease_expires_ms < {_NOW}",
)
def lease_expired(spark, sf_dir):
    return jobs.lease_expired(d.jobs(spark, sf_dir), _NOW)


@query(
    "jobs_eligible",
    _JOBS
    + f"""SELECT job_id, status, created_ms FROM jobs
WHERE (status = 'queued' AND (lease_expires_ms IS NULL OR lease_expires_ms < {_NOW}))
  OR (status = 'running' AND lease_expires_ms < {_NOW})""",
)
def jobs_eligible(spark, sf_dir):
    return jobs.eligible(d.jobs(spark, sf_dir), _NOW).select("job_id", "status", "created_ms")


def job_commands(spark, sf_dir):
    """A command log: the job is the user, the command follows from the event."""
    e = d.flat_changes(spark, sf_dir)
    names = ["start", "acquire", "pause", "resume", "complete", "fail", "set_speed", "start", "cancel", "delete"]
    pick = F.when(e.kind == "error", (F.col("seq") % 10) + 1).otherwise((F.col("seq") % 8) + 1).cast("int")
    return e.select(
        F.col("id").alias("job_id"), "seq", F.col("commit_time").alias("ts_ms"),
        F.element_at(F.array(*[F.lit(n) for n in names]), pick).alias("command"),
    )


_LIFECYCLE_SQL = (
    "WITH RECURSIVE "
    + d.CTE["changes"]
    + """,
moves(command, s, t) AS (VALUES ('start', 'pending', 'queued'), ('acquire', 'queued', 'running'),
  ('pause', 'running', 'paused'), ('resume', 'paused', 'queued'), ('cancel', 'pending', 'cancelled'),
  ('cancel', 'queued', 'cancelled'), ('cancel', 'running', 'cancelled'), ('cancel', 'paused', 'cancelled'),
  ('complete', 'running', 'completed'), ('fail', 'running', 'failed'), ('delete', 'completed', 'deleted'),
  ('delete', 'failed', 'deleted'), ('delete', 'cancelled', 'deleted'), ('set_speed', 'running', 'running'),
  ('set_speed', 'paused', 'paused'), ('set_speed', 'pending', 'pending')),
commands AS (SELECT id AS job_id, seq, commit_time AS ts_ms, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn,
  ['start', 'acquire', 'pause', 'resume', 'complete', 'fail', 'set_speed', 'start', 'cancel', 'delete'][
    CASE WHEN kind = 'error' THEN seq % 10 + 1 ELSE seq % 8 + 1 END] AS command FROM changes),
walk AS (
  SELECT DISTINCT job_id, -1::BIGINT AS seq, NULL::BIGINT AS ts_ms, 0::BIGINT AS rn, NULL::VARCHAR AS command,
    'pending' AS state, NULL::BOOLEAN AS accepted FROM commands
  UNION ALL SELECT c.job_id, c.seq, c.ts_ms, c.rn, c.command, coalesce(m.t, w.state), m.t IS NOT NULL
  FROM walk w JOIN commands c ON c.job_id = w.job_id AND c.rn = w.rn + 1
  LEFT JOIN moves m ON m.command = c.command AND m.s = w.state)
SELECT job_id, max_by(state, seq) AS state, count(*) FILTER (accepted)::BIGINT AS accepted,
  count(*) FILTER (NOT accepted)::BIGINT AS rejected,
  max(ts_ms) FILTER (accepted AND state IN ('completed', 'failed', 'cancelled')) AS completed_ms,
  coalesce(max_by(command, seq) FILTER (accepted) IN ('pause', 'cancel'), FALSE) AS lease_cleared
FROM walk WHERE rn > 0 GROUP BY job_id"""
)


@query("job_lifecycle", _LIFECYCLE_SQL)
def job_lifecycle(spark, sf_dir):
    commands = job_commands(spark, sf_dir)
    return jobs.lifecycle_state(jobs.lifecycle(commands, carry=("ts_ms",)))


@query(
    "recent_events",
    _CHANGES + "SELECT seq, tbl, operation, commit_time FROM changes WHERE contains(tbl, 't1') ORDER BY seq DESC LIMIT 50",
)
def recent_events(spark, sf_dir):
    return browse.recent_events(d.flat_changes(spark, sf_dir), 50, "t1").select("seq", "tbl", "operation", "commit_time")


_COMMITTED = {"worker": (1_705_000_000_000, 0), "audit": (1_706_500_000_000, 0)}


@query(
    "stream_stats",
    _HOT
    + """SELECT (SELECT count(*) FROM hot)::BIGINT AS length,
  (SELECT stream_ms || '-' || stream_seq FROM hot ORDER BY stream_ms, stream_seq LIMIT 1) AS first_id,
  (SELECT stream_ms || '-' || stream_seq FROM hot ORDER BY stream_ms DESC, stream_seq DESC LIMIT 1) AS last_id,
  consumer, (SELECT count(*) FROM hot WHERE stream_ms > at_ms OR (stream_ms = at_ms AND stream_seq > 0))::BIGINT AS pending
FROM (VALUES ('worker', 1705000000000), ('audit', 1706500000000)) c(consumer, at_ms)""",
)
def stream_stats(spark, sf_dir):
    return browse.stream_stats(d.hot_buffer(spark, sf_dir), _COMMITTED)


@query(
    "idle_gaps",
    _CHANGES
    + """SELECT seq, gap_ms, gap_ms // 5000 AS heartbeats FROM (
  SELECT seq, commit_time - lag(commit_time) OVER (ORDER BY seq) AS gap_ms FROM changes) WHERE gap_ms >= 5000""",
)
def idle_gaps(spark, sf_dir):
    return browse.idle_gaps(d.flat_changes(spark, sf_dir)).select("seq", "gap_ms", "heartbeats")


@query(
    "event_search",
    _CHANGES
    + """SELECT seq, tbl, operation FROM changes WHERE tbl IN ('public.t0', 'public.t2') AND operation IN ('UPDATE', 'INSERT')
  AND kind = 'purchase'""",
)
def event_search(spark, sf_dir):
    found = browse.search(
        d.changes(spark, sf_dir), ["public.t0", "public.t2"], ["UPDATE", "INSERT"], '"KIND":"Purchase"'
    )
    return found.select("seq", "tbl", "operation")


@query(
    "event_facets",
    _CHANGES
    + "SELECT DISTINCT 'table' AS facet, tbl AS value FROM changes UNION SELECT DISTINCT 'operation', operation FROM changes",
)
def event_facets(spark, sf_dir):
    return browse.facets(d.flat_changes(spark, sf_dir))


_RESOURCE = """CASE WHEN path LIKE '%auth%' THEN 'auth' WHEN path LIKE '%/health' THEN 'health'
  WHEN path LIKE '%/events/%' THEN 'events' WHEN path = '/' THEN 'unknown' ELSE 'replay_job' END"""
_RESOURCE_ID = """CASE WHEN path LIKE '%/events/%' OR path LIKE '%/jobs/_%'
  THEN regexp_extract(path, '(?:events|jobs)/([^/]+)', 1) END"""
_ACTION = f"""CASE WHEN path LIKE '%auth%' THEN 'auth.register'
  WHEN regexp_matches(path, 'jobs/[0-9]+/(start|pause|resume|cancel)$') AND method = 'POST' THEN 'replay_job.' || regexp_extract(path, '[a-z]+$')
  WHEN method = 'POST' THEN {_RESOURCE} || '.create' WHEN method IN ('PATCH', 'PUT') THEN {_RESOURCE} || '.update'
  WHEN method = 'DELETE' THEN {_RESOURCE} || '.delete' ELSE {_RESOURCE} || '.get' END"""


@query("audit_resource", _REQUESTS + f"SELECT seq, {_RESOURCE} AS resource_type, {_RESOURCE_ID} AS resource_id FROM requests")
def audit_resource(spark, sf_dir):
    path = F.col("path")
    return d.requests(spark, sf_dir).select(
        "seq", requests.resource_type(path).alias("resource_type"), requests.resource_id(path).alias("resource_id")
    )


@query("audit_action", _REQUESTS + f"SELECT {_ACTION} AS action, count(*)::BIGINT AS n FROM requests GROUP BY 1")
def audit_action(spark, sf_dir):
    action = requests.action(F.col("method"), F.col("path")).alias("action")
    return d.requests(spark, sf_dir).groupBy(action).agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_log",
    _REQUESTS
    + f"""SELECT seq, ts_ms AS timestamp_ms, username, {_ACTION} AS action, {_RESOURCE} AS resource_type,
  {_RESOURCE_ID} AS resource_id, ip AS ip_address, method, path, status_code FROM requests WHERE method <> 'GET'""",
)
def audit_log(spark, sf_dir):
    return requests.audit_log(d.requests(spark, sf_dir))


# A bucket of 5 refilled by 0.2 per second: 5,000 units a token, one unit per ms.
_LIMIT_SQL = (
    "WITH RECURSIVE "
    + d.CTE["requests"]
    + """,
limited AS (SELECT seq, ip, ts_ms // 10000 AS ts_ms, row_number() OVER (PARTITION BY ip ORDER BY ts_ms // 10000, seq) AS rn
  FROM requests WHERE path NOT LIKE '/api/v1/health%'),
walk AS (
  SELECT DISTINCT ip, -1::BIGINT AS seq, 0::BIGINT AS ts_ms, 0::BIGINT AS rn, 25000::BIGINT AS level, TRUE AS allowed FROM limited
  UNION ALL SELECT l.ip, l.seq, l.ts_ms, l.rn,
    least(25000, w.level + l.ts_ms - w.ts_ms) - CASE WHEN least(25000, w.level + l.ts_ms - w.ts_ms) >= 5000 THEN 5000 ELSE 0 END,
    least(25000, w.level + l.ts_ms - w.ts_ms) >= 5000
  FROM walk w JOIN limited l ON l.ip = w.ip AND l.rn = w.rn + 1)
SELECT seq, ip, ts_ms, allowed, CASE WHEN allowed THEN level // 5000 ELSE 0 END AS remaining FROM walk WHERE rn > 0"""
)


@query("rate_limit", _LIMIT_SQL)
def rate_limit(spark, sf_dir):
    """The sparse request log, run 10,000 times as fast so that clients hit the limit."""
    fast = d.requests(spark, sf_dir).withColumn("ts_ms", F.expr("ts_ms div 10000"))
    limited = requests.rate_limit(fast, capacity=5, refill_per_s=0.2)
    return limited.select("seq", "ip", "ts_ms", "allowed", "remaining")
