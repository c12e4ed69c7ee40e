"""Queries over replay windows, requests, schedules and run outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import replay
from tidelog.plans import datasets as d
from tidelog.plans.registry import query
from tidelog.session import cut_lineage
from tidelog.sources import archive

# 2024-01-10 00:00 to 2024-01-17 00:00 UTC.
START_MS = 1_704_844_800_000
END_MS = 1_705_449_600_000
T0_MS = 1_706_745_600_000
CHECKPOINT = '{"0": 40, "2": 75}'
HOT_RESUME = f"{END_MS}-3"

_HOT = d.with_ctes("changes", "hot")
_CHANGES = d.with_ctes("changes")
_FRONTIER = f"""ends AS (SELECT part, max(off) + 1 AS end_off,
  min(off) FILTER (publish_ms >= {START_MS}) AS first_off FROM changes GROUP BY part),
frontier AS (SELECT part, CAST(CASE part WHEN 0 THEN 41 WHEN 2 THEN 76
  ELSE coalesce(first_off, end_off) END AS BIGINT) AS frontier, end_off FROM ends)"""


@query(
    "hot_range",
    _HOT + f"SELECT stream_ms, stream_seq, seq, tbl, operation FROM hot WHERE stream_ms BETWEEN {START_MS} AND {d.NOW_MS + 7 * d.DAY_MS}",
)
def hot_range(spark, sf_dir):
    rows = replay.hot_range(d.hot_buffer(spark, sf_dir), START_MS, d.NOW_MS + 7 * d.DAY_MS)
    return rows.select("stream_ms", "stream_seq", "seq", "tbl", "operation")


@query(
    "hot_resume",
    _HOT + f"""SELECT stream_ms, stream_seq, seq, tbl, operation FROM hot
WHERE (stream_ms > {END_MS} OR (stream_ms = {END_MS} AND stream_seq > 3)) AND stream_ms <= {d.NOW_MS + 7 * d.DAY_MS}""",
)
def hot_resume(spark, sf_dir):
    rows = replay.hot_resume(d.hot_buffer(spark, sf_dir), HOT_RESUME, d.NOW_MS + 7 * d.DAY_MS)
    return rows.select("stream_ms", "stream_seq", "seq", "tbl", "operation")


@query("archive_frontier", f"{_CHANGES.rstrip()},\n{_FRONTIER} SELECT part, frontier FROM frontier")
def archive_frontier(spark, sf_dir):
    saved = replay.checkpoint_map(CHECKPOINT)
    return archive.read_frontier(spark, d.stored_archive(spark, sf_dir), START_MS, saved).select("part", "frontier")


@query(
    "archive_range",
    f"""{_CHANGES.rstrip()},
{_FRONTIER},
stops AS (SELECT c.part, min(c.off) AS stop FROM changes c JOIN frontier f USING (part)
  WHERE c.publish_ms > {END_MS} AND c.off >= f.frontier GROUP BY c.part)
SELECT c.part, c.off, c.seq, c.publish_ms FROM changes c JOIN frontier f USING (part)
LEFT JOIN stops s ON s.part = c.part
WHERE c.off >= f.frontier AND c.off < coalesce(s.stop, f.end_off)""",
)
def archive_range(spark, sf_dir):
    saved = replay.checkpoint_map(CHECKPOINT)
    rows = archive.read_range(spark, d.stored_archive(spark, sf_dir), START_MS, END_MS, saved)
    return rows.select("part", "off", "seq", "publish_ms")


@query(
    "checkpoint_parse",
    _CHANGES
    + """SELECT seq, part AS p, off AS o FROM changes WHERE seq % 3 <> 2
UNION ALL SELECT seq, part + 10, seq FROM changes WHERE seq % 3 = 0
UNION ALL SELECT seq, NULL, NULL FROM changes WHERE seq % 3 = 2""",
)
def checkpoint_parse(spark, sf_dir):
    part, off, seq = (F.col(c).cast("string") for c in ("part", "off", "seq"))
    text = (
        F.when(F.col("seq") % 3 == 0, F.format_string('{"%s": %s, "%s": %s}', part, off, (F.col("part") + 10).cast("string"), seq))
        .when(F.col("seq") % 3 == 1, F.concat(part, F.lit(":"), off))
        .otherwise(F.lit("{}"))
    )
    parsed = d.archive(spark, sf_dir).select("seq", replay.parse_checkpoint(text).alias("m"))
    return parsed.select("seq", F.explode_outer("m").alias("p", "o"))


@query(
    "checkpoint_advance",
    _CHANGES.rstrip()
    + """,
last AS (SELECT seq % 3 AS job_id, part, max_by(off, seq) AS off, max(seq) AS last_seq FROM changes GROUP BY 1, 2),
ids AS (SELECT job_id, max_by(part || ':' || off, last_seq) AS last_processed_id FROM last GROUP BY 1)
SELECT l.job_id, l.part, l.off, i.last_processed_id FROM last l JOIN ids i USING (job_id)""",
)
def checkpoint_advance(spark, sf_dir):
    rows = d.archive(spark, sf_dir).withColumn("job_id", F.col("seq") % 3)
    advanced = replay.checkpoint_advance(rows)
    return advanced.select("job_id", F.explode("checkpoint").alias("part", "off"), "last_processed_id")


@query(
    "window_count",
    _CHANGES + f"SELECT count(*)::BIGINT AS events FROM changes WHERE publish_ms BETWEEN {START_MS} AND {END_MS}",
)
def window_count(spark, sf_dir):
    return replay.window_count(d.flat_changes(spark, sf_dir), START_MS, END_MS)


@query(
    "offset_count",
    _CHANGES
    + f"""SELECT CAST(sum(coalesce(CASE WHEN b > a THEN b - a END, 0)) AS BIGINT) AS events FROM (
  SELECT part, min(off) FILTER (publish_ms >= {START_MS}) AS a, min(off) FILTER (publish_ms >= {END_MS}) AS b
  FROM changes GROUP BY part)""",
)
def offset_count(spark, sf_dir):
    return replay.offset_count(d.archive(spark, sf_dir), START_MS, END_MS)


@query(
    "route_requests",
    d.with_ctes("jobs")
    + """SELECT job_id, coalesce(pinned, CASE WHEN now_ms - start_ms < 3600000 AND end_ms - start_ms < 3600000
  THEN 'hot' ELSE 'archive' END) AS source FROM jobs""",
)
def route_requests(spark, sf_dir):
    return replay.route(d.jobs(spark, sf_dir)).select("job_id", "source")


@query(
    "validate_requests",
    d.with_ctes("jobs")
    + """SELECT job_id, concat_ws('; ', CASE WHEN NOT end_ms > start_ms THEN 'end_time must be after start_time' END,
  CASE WHEN speed < 0.1 OR speed > 100 THEN 'speed_factor out of range' END,
  CASE WHEN target NOT IN ('grpc', 'http') THEN 'unknown target_type' END) AS violations FROM jobs""",
)
def validate_requests(spark, sf_dir):
    checked = replay.validate(d.jobs(spark, sf_dir))
    return checked.select("job_id", F.concat_ws("; ", "violations").alias("violations"))


@query(
    "replay_table_filter",
    _CHANGES + "SELECT seq, tbl FROM changes WHERE regexp_matches(tbl, 't[13]$')",
)
def replay_table_filter(spark, sf_dir):
    return replay.filter_tables(d.flat_changes(spark, sf_dir), "t[13]$").select("seq", "tbl")


_SCHEDULE = (
    _CHANGES.rstrip()
    + f""",
due AS (SELECT part, seq, {T0_MS}::DOUBLE + (publish_ms - first_value(publish_ms) OVER w)
    / (CASE part WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END)::DOUBLE AS due_ms
  FROM changes WINDOW w AS (PARTITION BY part ORDER BY seq)),
scheduled AS (SELECT *, greatest({T0_MS}::DOUBLE, max(due_ms) OVER (PARTITION BY part ORDER BY seq)) AS release_ms FROM due)
"""
)


def _scheduled(spark, sf_dir):
    log = d.flat_changes(spark, sf_dir).select("part", "seq", "publish_ms")
    speed = F.pow(F.lit(2.0), F.col("part"))
    return replay.schedule(log, speed, T0_MS, ["part"], time_col="publish_ms")


@query("replay_schedule", _SCHEDULE + "SELECT part, seq, due_ms, release_ms FROM scheduled")
def replay_schedule(spark, sf_dir):
    return _scheduled(spark, sf_dir).select("part", "seq", "due_ms", "release_ms")


@query(
    "release_slots",
    _SCHEDULE
    + f"""SELECT part, CAST(floor((release_ms - {T0_MS}) / 60000) AS BIGINT) AS slot, count(*)::BIGINT AS events,
  min(seq) AS first_seq, max(seq) AS last_seq FROM scheduled GROUP BY ALL""",
)
def release_slots(spark, sf_dir):
    slots = replay.release_slots(_scheduled(spark, sf_dir), 60_000, T0_MS)
    return slots.groupBy("part", "slot").agg(
        F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


_FOLDED = (
    d.with_ctes("changes", "attempts").rstrip()
    + """,
won AS (SELECT seq, part, min(attempt) FILTER (ok OR dup) AS a, bool_or(dup) AS any_dup FROM attempts GROUP BY ALL),
folded AS (SELECT seq, part AS job_id, coalesce(a, 4)::INT AS attempts, a IS NOT NULL AS success,
  a IS NOT NULL AND seq % 23 = 0 AS was_duplicate,
  CASE coalesce(a, 4) WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 3.0 ELSE 7.0 END::DOUBLE AS backoff_s FROM won),
fails AS (SELECT job_id, min(seq) AS fail_seq FROM folded WHERE NOT success GROUP BY job_id)
"""
)


def _folded(spark, sf_dir):
    log = d.attempts(spark, sf_dir).withColumnRenamed("part", "job_id")
    return replay.fold_retries(log, ["job_id", "seq"]).drop("finished")


def _folded_once(spark, sf_dir):
    """The folded attempts, written once: they are read for the first failures and again."""
    return cut_lineage(_folded(spark, sf_dir))


@query("retry_outcome", _FOLDED + "SELECT job_id, seq, attempts, success, was_duplicate, backoff_s FROM folded")
def retry_outcome(spark, sf_dir):
    return _folded(spark, sf_dir)


@query(
    "fail_fast_prefix",
    _FOLDED
    + "SELECT f.job_id, f.seq FROM folded f LEFT JOIN fails x USING (job_id) WHERE x.fail_seq IS NULL OR f.seq < x.fail_seq",
)
def fail_fast_prefix(spark, sf_dir):
    return replay.fail_fast(_folded_once(spark, sf_dir), ~F.col("success")).select("job_id", "seq")


@query(
    "run_summary",
    _FOLDED
    + """SELECT *, CASE WHEN total > 0 THEN round(processed / total * 100, 2) ELSE 0 END AS progress,
  CASE WHEN total > 0 THEN round((processed + duplicates) / total * 100, 2) ELSE 0 END AS handled_percent,
  true AS is_terminal FROM (
  SELECT job_id, count(*)::BIGINT AS total,
    count(*) FILTER (success AND NOT was_duplicate AND (fail_seq IS NULL OR seq <= fail_seq))::BIGINT AS processed,
    count(*) FILTER (was_duplicate AND (fail_seq IS NULL OR seq <= fail_seq))::BIGINT AS duplicates,
    count(*) FILTER (NOT success AND seq <= fail_seq)::BIGINT AS failed,
    CASE WHEN max(fail_seq) IS NULL THEN 'completed' ELSE 'failed' END AS status,
    'Event ' || max(fail_seq) || ' failed after 4 attempts' AS error
  FROM folded LEFT JOIN fails USING (job_id) GROUP BY job_id)""",
)
def run_summary(spark, sf_dir):
    return replay.run_summary(_folded_once(spark, sf_dir))
