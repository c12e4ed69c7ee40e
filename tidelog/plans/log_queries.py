"""Queries over payloads, envelopes, the archive layout and the hot buffer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import decode, layout, segments, wire
from tidelog.plans import datasets as d
from tidelog.plans.registry import query

_DECODED = d.with_ctes("changes", "decoded")


def _decoded(spark, sf_dir):
    return decode.decode_payloads(d.payloads(spark, sf_dir))


@query(
    "wal_decode",
    _DECODED
    + """SELECT lsn, change_idx, commit_time, tbl, operation, new_id, new_amt, new_kind, old_id
FROM decoded""",
)
def wal_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select(
        "lsn", "change_idx", "commit_time", "tbl", "operation", *_image_columns()
    )


def _image_columns():
    return [
        F.col("new")["id"].alias("new_id"),
        F.col("new")["amt"].alias("new_amt"),
        F.col("new")["kind"].alias("new_kind"),
        F.col("old")["id"].alias("old_id"),
    ]


@query(
    "wal_op_counts",
    _DECODED + "SELECT operation, count(*)::BIGINT AS n FROM decoded GROUP BY operation",
)
def wal_op_counts(spark, sf_dir):
    return _decoded(spark, sf_dir).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "wal_commit_time",
    _DECODED + "SELECT DISTINCT lsn, commit_time, commit_time_missing FROM decoded",
)
def wal_commit_time(spark, sf_dir):
    return _decoded(spark, sf_dir).where("change_idx = 0").select("lsn", "commit_time", "commit_time_missing")


@query(
    "wal_row_images",
    _DECODED
    + """SELECT lsn, change_idx, new_id, new_amt, new_kind, old_id,
  CAST((new_id IS NOT NULL)::INT + (new_amt IS NOT NULL)::INT + (new_kind IS NOT NULL)::INT AS INT) AS n_new,
  CAST((old_id IS NOT NULL)::INT AS INT) AS n_old
FROM decoded""",
)
def wal_row_images(spark, sf_dir):
    return _decoded(spark, sf_dir).select(
        "lsn", "change_idx", *_image_columns(), F.size("new").alias("n_new"), F.size("old").alias("n_old")
    )


@query(
    "wal_tables",
    _DECODED
    + "SELECT tbl, count(*)::BIGINT AS n, count(DISTINCT lsn)::BIGINT AS payloads FROM decoded GROUP BY tbl",
)
def wal_tables(spark, sf_dir):
    per_payload = _decoded(spark, sf_dir).groupBy("tbl", "lsn").agg(F.count(F.lit(1)).alias("n"))
    return per_payload.groupBy("tbl").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("payloads"))


@query(
    "capture_filter",
    d.with_ctes("changes")
    + """SELECT seq, tbl, operation FROM changes
WHERE tbl IN ('public.t1', 'public.t3')""",
)
def capture_filter(spark, sf_dir):
    kept = decode.capture_filter(d.flat_changes(spark, sf_dir), "public.t1,*c.?3,audit.*")
    return kept.select("seq", "tbl", "operation")


@query(
    "envelope_defaults",
    d.with_ctes("changes")
    + """SELECT seq, CASE WHEN seq % 5 = 0 THEN '' ELSE lsn END AS lsn,
  CASE WHEN seq % 7 = 0 THEN 0 ELSE commit_time END AS commit_time,
  CASE WHEN seq % 11 = 0 THEN '' ELSE tbl END AS tbl,
  CASE WHEN seq % 3 = 0 THEN 'INSERT' ELSE operation END AS operation,
  CASE WHEN seq % 2 = 0 OR operation NOT IN ('UPDATE', 'DELETE') THEN 0 ELSE 1 END AS n_old,
  CASE WHEN operation NOT IN ('INSERT', 'UPDATE') THEN 0
    ELSE 1 + (amt IS NOT NULL)::INT + (kind IS NOT NULL)::INT END AS n_new
FROM changes""",
)
def envelope_defaults(spark, sf_dir):
    seq = F.col("seq")
    fields = F.struct(
        F.when(seq % 5 != 0, F.col("lsn")).alias("lsn"),
        F.when(seq % 7 != 0, F.col("commit_time")).alias("commit_time"),
        F.when(seq % 11 != 0, F.col("tbl")).alias("table"),
        F.when(seq % 3 == 1, F.col("operation")).when(seq % 3 == 0, F.when(seq % 2 == 0, F.lit(""))).otherwise(
            F.col("operation")
        ).alias("operation"),
        F.when(seq % 2 != 0, F.col("old")).alias("old"),
        F.col("new"),
        F.lit("x").alias("unknown_field"),
    )
    envelopes = d.changes(spark, sf_dir).select("seq", F.to_json(fields).alias("envelope"))
    return decode.decode_envelopes(envelopes).select(
        "seq", "lsn", "commit_time", "tbl", "operation", F.size("old").alias("n_old"), F.size("new").alias("n_new")
    )


@query(
    "bad_envelopes",
    d.with_ctes("changes")
    + """SELECT seq, 'parse_error' AS error_type FROM changes WHERE seq % 13 IN (3, 5, 7)
UNION ALL SELECT seq, 'decoded' FROM changes WHERE seq % 13 NOT IN (3, 5, 7)""",
)
def bad_envelopes(spark, sf_dir):
    """Stored envelopes, some of them cut off, no JSON or missing: each is decoded or quarantined."""
    seq = F.col("seq")
    text = F.to_json(F.struct("lsn", "commit_time", F.col("tbl").alias("table"), "operation", "old", "new"))
    envelope = F.when(seq % 13 == 3, F.substring(text, F.lit(1), F.length(text) - 2)).when(seq % 13 == 5, F.lit("no json"))
    envelope = envelope.when(seq % 13 != 7, text)
    stored = d.changes(spark, sf_dir).select("seq", envelope.alias("envelope"))
    good = decode.decode_envelopes(stored).select("seq", F.lit("decoded").alias("error_type"))
    return decode.quarantine_envelopes(stored).select("seq", "error_type").unionByName(good)


@query(
    "binary_envelopes",
    d.with_ctes("changes")
    + """SELECT seq, lsn, commit_time, tbl, operation, CASE WHEN operation IN ('UPDATE', 'DELETE') THEN CAST(id AS VARCHAR) END AS old_id,
  CASE WHEN operation IN ('INSERT', 'UPDATE') THEN CAST(id AS VARCHAR) END AS new_id,
  CASE WHEN operation IN ('INSERT', 'UPDATE') THEN kind END AS new_kind, NULL AS error_type
FROM changes WHERE seq % 17 NOT IN (2, 9)
UNION ALL SELECT seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parse_error' FROM changes WHERE seq % 17 IN (2, 9)""",
)
def binary_envelopes(spark, sf_dir):
    """The log as binary envelopes, some of them cut off or missing: each is decoded or quarantined."""
    seq = F.col("seq")
    raw = wire.written(d.changes(spark, sf_dir).select("seq", "lsn", "commit_time", "tbl", "operation", "old", "new"))
    cut = F.substring(F.col("value"), F.lit(1), F.octet_length("value") - 1)
    stored = raw.select("seq", F.when(seq % 17 == 2, cut).when(seq % 17 != 9, F.col("value")).alias("value"))
    good = decode.decode_binary_envelopes(stored).select(
        "seq", "lsn", "commit_time", "tbl", "operation", F.col("old")["id"].alias("old_id"),
        F.col("new")["id"].alias("new_id"), F.col("new")["kind"].alias("new_kind"), F.lit(None).cast("string").alias("error_type"),
    )
    bad = decode.quarantine_binary_envelopes(stored).select("seq", "error_type")
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "bad_rows",
    """SELECT CAST(seq AS VARCHAR) AS lsn, 'json_parse' AS error_type FROM (
  SELECT min(event_id) AS seq FROM events GROUP BY event_id // 3 HAVING (event_id // 3) % 101 = 0)""",
)
def bad_rows(spark, sf_dir):
    return decode.quarantine(d.payloads(spark, sf_dir)).select("lsn", "error_type")


@query(
    "archive_layout",
    d.with_ctes("changes") + "SELECT part, off, seq, tbl, operation FROM changes",
)
def archive_layout(spark, sf_dir):
    numbered = segments.running_count(d.flat_changes(spark, sf_dir), ["tbl"], "seq", "position")
    rows = numbered.select("part", (F.col("position") - 1).alias("off"), "seq", "tbl", "operation")
    return layout.layout_archive(rows, files=16)


@query(
    "hot_buffer",
    d.with_ctes("changes") + "SELECT seq, tbl, operation, publish_ms FROM changes ORDER BY seq DESC LIMIT 100000",
)
def hot_buffer(spark, sf_dir):
    return layout.retain_newest(d.flat_changes(spark, sf_dir), 100_000).select("seq", "tbl", "operation", "publish_ms")
