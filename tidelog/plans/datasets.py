"""Change logs and related inputs derived from the given tables.

`events` is read as a change log: `event_id` is the log sequence, `user_id` the
row key, `user_id % 4` the table and the archive partition.  All derivations are
deterministic functions of the rows, so any engine can repeat them; `CTE` holds
the same definitions as SQL text for the oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidelog.functions import keys, wal
from tidelog.operators import segments
from tidelog.session import checkpoint_root
from tidelog.sources import archive as stored
from tidelog.sources.tables import table

DAY_MS = 86_400_000
TTL_MS = 7 * DAY_MS
NOW_MS = 1_705_708_800_000  # 2024-01-20 00:00:00 UTC, the "now" of every query on the log
IMAGE_COLUMNS = ("id", "amt", "kind")
GAPS_MS = (TTL_MS // 3, TTL_MS - 1, TTL_MS, TTL_MS * 3 // 5, 0)
STORED_FILE_ROWS = 500  # so that the small inputs have several files a partition, too
JOBS_NOW_MS = 946_684_800_000  # 2000-01-01 00:00:00 UTC, the "now" of every query on jobs

def epoch_ms(column: str):
    """Epoch milliseconds (floor) of a timestamp without time zone, whatever the session zone."""
    return F.expr(
        f"datediff(cast({column} AS date), DATE'1970-01-01') * 86400000L + hour({column}) * 3600000L"
        f" + minute({column}) * 60000L + cast(floor(extract(SECOND FROM {column}) * 1000) AS bigint)"
    )


def flat_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log, one row per change, with the row values as typed columns."""
    return flat_changes_of(table(spark, sf_dir, "events"))


def flat_changes_of(e: DataFrame) -> DataFrame:
    """The change log of an `events` table or stream."""
    seq, ms = F.col("event_id"), epoch_ms("ts")
    slot = F.expr("user_id % 4")
    operation = (
        F.when(seq % 997 == 996, F.lit("TRUNCATE"))
        .when(F.col("event_type") == "signup", F.lit("INSERT"))
        .when(F.col("event_type") == "error", F.lit("DELETE"))
        .otherwise(F.lit("UPDATE"))
    )
    return e.select(
        seq.alias("seq"),
        seq.cast("string").alias("lsn"),
        ms.alias("commit_time"),
        F.concat(F.lit("public.t"), slot.cast("string")).alias("tbl"),
        slot.cast("int").alias("part"),
        (ms + (seq * 7919) % 600000).alias("publish_ms"),
        operation.alias("operation"),
        F.col("user_id").alias("id"),
        F.when(seq % 10 != 0, F.col("value")).alias("amt"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
        "value",
        "ts",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as change records: with the row images `new` and `old`."""
    return with_images(flat_changes(spark, sf_dir), new_image(), old_image())


def with_images(df: DataFrame, new, old) -> DataFrame:
    """Add row images, each built once per row.

    As plain columns they would be built anew in every condition on them that is pushed
    down.  A stored log has no such cost, and needs none of this.
    """
    images = F.inline(F.array(F.struct(new.alias("new"), old.alias("old"))))
    return df.select(*[c for c in df.columns if c not in ("new", "old")], images)


def new_image():
    has_new = F.col("operation").isin("INSERT", "UPDATE")
    names = F.array(F.lit("id"), F.lit("amt"), F.lit("kind"))
    values = F.array(F.col("id").cast("string"), F.col("amt").cast("string"), F.col("kind"))
    full = F.map_filter(F.map_from_arrays(names, values), lambda _, v: v.isNotNull())
    return F.when(has_new, full).otherwise(wal.empty_image())


def old_image():
    has_old = F.col("operation").isin("UPDATE", "DELETE")
    full = F.map_from_arrays(F.array(F.lit("id")), F.array(F.col("id").cast("string")))
    return F.when(has_old, full).otherwise(wal.empty_image())


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its offset within each archive partition."""
    numbered = segments.running_count(flat_changes(spark, sf_dir), ["part"], "seq", "position")
    return numbered.withColumn("off", F.col("position") - 1).drop("position")


_stored: dict[tuple[str, str], str] = {}


def stored_archive(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the stored archive, written once per application and input."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stored:
        path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
        stored.store(archive(spark, sf_dir).drop("ts"), path, file_rows=STORED_FILE_ROWS)
        _stored[at] = path
    return _stored[at]


def content_key():
    return keys.content_key(F.col("lsn"), F.col("tbl"), F.col("old"), F.col("new"), IMAGE_COLUMNS)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-least-once deliveries: every 7th change again after 1 h, every 21st after 8 days."""
    log = changes(spark, sf_dir).drop("ts")
    copies = F.when(F.col("seq") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    late = F.when(F.col("seq") % 21 == 0, F.lit(8 * DAY_MS)).otherwise(F.lit(3_600_000))
    return (
        log.withColumn("copy", F.explode(copies))
        .withColumn("delivered_ms", F.col("publish_ms") + F.when(F.col("copy") == 1, late).otherwise(0))
        .withColumn("delivery", F.col("seq") * 2 + F.col("copy"))
        .withColumn("idempotency_key", content_key())
    )


def redeliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries again and again: every change one to twelve times, a third of them under one key.

    By change the gaps are a third of the time to live, 1 ms short of it, exactly it, and
    0.6 times it (so that every second one applies); a few copies come at one instant.
    """
    gap = F.element_at(F.array(*[F.lit(g).cast("bigint") for g in GAPS_MS]), (F.col("seq") % 5 + 1).cast("int"))
    copies = F.sequence(F.lit(0), (F.col("seq") % 12).cast("int"))
    key = F.when(F.col("seq") % 3 == 0, F.lit("key-hot")).otherwise(F.concat(F.lit("key-"), F.col("seq").cast("string")))
    return (
        flat_changes(spark, sf_dir)
        .select("publish_ms", "seq", F.explode(copies).alias("copy"))
        .select(
            key.alias("idempotency_key"),
            (F.col("publish_ms") + F.col("copy") * gap).alias("delivered_ms"),
            (F.col("seq") * 12 + F.col("copy")).alias("delivery"),
        )
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of already processed changes: every 5th change, kept for 7 days."""
    return changes(spark, sf_dir).where("seq % 5 = 0").select(
        content_key().alias("idempotency_key"),
        F.col("publish_ms").alias("processed_at"),
        F.concat(F.lit("job-"), F.col("part").cast("string")).alias("job_id"),
        (F.col("publish_ms") + TTL_MS).alias("expires_at"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads of three changes each, in both column encodings; every 101st is cut off."""
    log = flat_changes(spark, sf_dir).withColumn("grp", F.expr("seq div 3"))
    even = F.col("seq") % 2 == 0
    has_new = F.col("operation").isin("INSERT", "UPDATE")
    has_old = F.col("operation").isin("UPDATE", "DELETE")

    def pair(name, kind, value):
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), value.alias("value"))

    identity, amount = F.col("id").cast("string"), F.col("amt").cast("string")
    change = F.struct(
        F.when(~even, F.lower("operation")).alias("kind"),
        F.when(even, F.substring("operation", 1, 1)).alias("action"),
        F.when(F.col("seq") % 13 != 0, F.lit("public")).alias("schema"),
        F.when(F.col("seq") % 17 != 0, F.substring_index("tbl", ".", -1)).alias("table"),
        F.when(
            even & has_new,
            F.array(pair("id", "bigint", identity), pair("amt", "double", amount), pair("kind", "text", F.col("kind"))),
        ).alias("columns"),
        F.when(~even & has_new, F.array(F.lit("id"), F.lit("amt"), F.lit("kind"))).alias("columnnames"),
        F.when(~even & has_new, F.array(identity, amount, F.col("kind"))).alias("columnvalues"),
        F.when(even & has_old, F.array(pair("id", "bigint", identity))).alias("identity"),
        F.when(
            ~even & has_old,
            F.struct(F.array(F.lit("id")).alias("keynames"), F.array(identity).alias("keyvalues")),
        ).alias("oldkeys"),
    )
    g = F.col("grp")
    stamp = (
        F.when(g % 4 == 0, F.concat(F.col("ts").cast("string"), F.lit("+00")))
        .when(g % 4 == 1, F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")))
        .when(
            g % 4 == 2,
            F.concat((F.col("ts") + F.expr("INTERVAL 330 MINUTES")).cast("string"), F.lit("+05:30")),
        )
    )
    first = F.min(F.struct("seq", "stamp", "publish_ms")).alias("first")
    text = F.to_json(
        F.struct(
            F.col("first.stamp").alias("timestamp"),
            F.transform(F.array_sort("items"), lambda i: i["change"]).alias("change"),
        )
    )
    return (
        log.withColumn("stamp", stamp)
        .withColumn("change", change)
        .groupBy("grp")  # three rows at most: seq is unique
        .agg(first, F.collect_list(F.struct("seq", "change")).alias("items"))
        .withColumn("text", text)
        .select(
            g,
            F.col("first.seq").cast("string").alias("lsn"),
            F.col("first.publish_ms").alias("ingest_ms"),
            F.when(g % 101 == 0, F.expr("left(text, length(text) - 5)")).otherwise(F.col("text")).alias("payload"),
        )
    )


def hot_buffer(spark: SparkSession, sf_dir: str, size: int = 100_000) -> DataFrame:
    """The newest changes with their buffer entry id (`stream_ms`, `stream_seq`)."""
    newest = segments.newest(flat_changes(spark, sf_dir), size, "seq")
    same_ms = W.partitionBy("publish_ms").orderBy("seq")
    return newest.withColumn("stream_ms", F.col("publish_ms")).withColumn(
        "stream_seq", (F.row_number().over(same_ms) - 1).cast("bigint")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempts 1..4 of every change, with their outcome."""
    log = flat_changes(spark, sf_dir).select("seq", "part", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"))
    ok = ((F.col("seq") + F.col("attempt")) % 11 != 0) & (F.col("seq") % 499 != 498)
    return log.withColumn("ok", ok).withColumn("dup", ok & (F.col("seq") % 23 == 0))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay jobs, one per order."""
    key = F.col("o_orderkey")
    start = epoch_ms("o_orderdate")
    states = ["pending", "queued", "running", "paused", "completed", "failed", "cancelled"]
    status = F.element_at(F.array(*[F.lit(s) for s in states]), (key % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("job_id"),
        start.alias("start_ms"),
        F.when(key % 29 == 0, start).otherwise(start + 600_000 * (1 + key % 48)).alias("end_ms"),
        (start + (key % 5) * 1_200_000).alias("now_ms"),
        start.alias("created_ms"),
        status.alias("status"),
        F.when(key % 3 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.lit(JOBS_NOW_MS) + F.when(key % 3 == 1, 300_000).otherwise(-300_000))
        .alias("lease_expires_ms"),
        F.when(key % 11 == 0, F.lit("archive")).when(key % 13 == 0, F.lit("hot")).alias("pinned"),
        (F.lit(0.0625) + (key % 1100) / 8.0).alias("speed"),
        F.when(key % 19 == 0, F.lit("ftp")).when(key % 2 == 0, F.lit("grpc")).otherwise(F.lit("http")).alias("target"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log, one request per event; 40 clients, bursts of requests at one instant."""
    e = table(spark, sf_dir, "events")
    seq, user = F.col("event_id"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    lifecycle = F.element_at(
        F.array(F.lit("start"), F.lit("pause"), F.lit("resume"), F.lit("cancel"), F.lit("logs")),
        (seq % 5 + 1).cast("int"),
    )
    path = (
        F.when(kind == "signup", F.lit("/api/v1/auth/register"))
        .when((kind == "view") & (seq % 2 == 0), F.lit("/api/v1/health"))
        .when(kind == "view", F.concat(F.lit("/api/v1/events/"), user))
        .when(kind == "click", F.concat(F.lit("/api/v1/jobs/"), user, F.lit("/"), lifecycle))
        .when((kind == "purchase") & (seq % 9 == 0), F.lit("/"))
        .when(kind == "purchase", F.lit("/api/v2/jobs/"))
        .otherwise(F.concat(F.lit("/jobs/"), user))
    )
    method = (
        F.when(kind == "view", F.lit("GET"))
        .when(kind == "error", F.element_at(F.array(F.lit("DELETE"), F.lit("PATCH"), F.lit("PUT")), (seq % 3 + 1).cast("int")))
        .otherwise(F.lit("POST"))
    )
    return e.select(
        seq.alias("seq"),
        epoch_ms("ts").alias("ts_ms"),
        method.alias("method"),
        path.alias("path"),
        F.when(seq % 4 != 0, F.concat(F.lit("user"), user)).alias("username"),
        F.concat(F.lit("10.0.0."), user).alias("ip"),
        F.when(kind == "error", F.lit("404")).otherwise(F.lit("200")).alias("status_code"),
    )


# The same definitions as SQL, for the oracle.
CTE: dict[str, str] = {
    "changes": """changes AS (
  SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS lsn, epoch_us(ts) // 1000 AS commit_time,
    'public.t' || CAST(user_id % 4 AS VARCHAR) AS tbl, CAST(user_id % 4 AS INT) AS part,
    CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS off,
    epoch_us(ts) // 1000 + (event_id * 7919) % 600000 AS publish_ms,
    CASE WHEN event_id % 997 = 996 THEN 'TRUNCATE' WHEN event_type = 'signup' THEN 'INSERT'
         WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
    user_id AS id, CASE WHEN event_id % 10 <> 0 THEN value END AS amt,
    CASE WHEN event_type <> 'view' THEN event_type END AS kind, value
  FROM events)""",
    "images": """images AS (
  SELECT *, CASE WHEN operation IN ('INSERT', 'UPDATE') THEN concat_ws(':',
      'amt=' || CAST(amt AS VARCHAR), 'id=' || CAST(id AS VARCHAR), 'kind=' || kind)
    WHEN operation = 'DELETE' THEN 'id=' || CAST(id AS VARCHAR) ELSE '' END AS image
  FROM changes)""",
    "keyed": """keyed AS (
  SELECT *, lsn || ':' || tbl || ':' || substr(md5(image), 1, 16) AS idempotency_key FROM images)""",
    "deliveries": """deliveries AS (
  SELECT k.*, c.copy, k.publish_ms + CASE WHEN c.copy = 0 THEN 0 WHEN k.seq % 21 = 0 THEN 691200000
    ELSE 3600000 END AS delivered_ms, k.seq * 2 + c.copy AS delivery
  FROM keyed k JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR k.seq % 7 = 0)""",
    "redeliveries": f"""redeliveries AS (
  SELECT CASE WHEN seq % 3 = 0 THEN 'key-hot' ELSE 'key-' || CAST(seq AS VARCHAR) END AS idempotency_key, seq * 12 + c.copy AS delivery,
    publish_ms + c.copy * CASE seq % 5 WHEN 0 THEN {GAPS_MS[0]} WHEN 1 THEN {GAPS_MS[1]} WHEN 2 THEN {GAPS_MS[2]}
      WHEN 3 THEN {GAPS_MS[3]} ELSE {GAPS_MS[4]} END AS delivered_ms
  FROM changes JOIN range(12) c(copy) ON c.copy <= seq % 12)""",
    "ledger": """ledger AS (
  SELECT idempotency_key, publish_ms AS processed_at, 'job-' || CAST(part AS VARCHAR) AS job_id,
    publish_ms + 604800000 AS expires_at
  FROM keyed WHERE seq % 5 = 0)""",
    "decoded": """grouped AS (
  SELECT *, seq // 3 AS grp, min(seq) OVER (PARTITION BY seq // 3) AS first_seq,
    row_number() OVER (PARTITION BY seq // 3 ORDER BY seq) - 1 AS idx
  FROM changes),
decoded AS (
  SELECT CAST(g.first_seq AS VARCHAR) AS lsn, CAST(g.idx AS INT) AS change_idx, g.grp, g.seq,
    CASE WHEN g.grp % 4 = 3 THEN f.publish_ms ELSE f.commit_time END AS commit_time,
    g.grp % 4 = 3 AS commit_time_missing,
    CASE WHEN g.seq % 17 = 0 THEN 'public.unknown' ELSE g.tbl END AS tbl, g.operation,
    CASE WHEN g.operation IN ('INSERT', 'UPDATE') THEN CAST(g.id AS VARCHAR) END AS new_id,
    CASE WHEN g.operation IN ('INSERT', 'UPDATE') THEN CAST(g.amt AS VARCHAR) END AS new_amt,
    CASE WHEN g.operation IN ('INSERT', 'UPDATE') THEN g.kind END AS new_kind,
    CASE WHEN g.operation IN ('UPDATE', 'DELETE') THEN CAST(g.id AS VARCHAR) END AS old_id
  FROM grouped g JOIN changes f ON f.seq = g.first_seq
  WHERE g.grp % 101 <> 0)""",
    "hot": """newest AS (SELECT * FROM changes ORDER BY seq DESC LIMIT 100000),
hot AS (
  SELECT *, publish_ms AS stream_ms,
    CAST(row_number() OVER (PARTITION BY publish_ms ORDER BY seq) - 1 AS BIGINT) AS stream_seq
  FROM newest)""",
    "attempts": """attempts AS (
  SELECT seq, part, a.attempt, (seq + a.attempt) % 11 <> 0 AND seq % 499 <> 498 AS ok,
    (seq + a.attempt) % 11 <> 0 AND seq % 499 <> 498 AND seq % 23 = 0 AS dup
  FROM changes CROSS JOIN (VALUES (1), (2), (3), (4)) a(attempt))""",
    "jobs": """jobs AS (
  SELECT o_orderkey AS job_id, epoch_us(o_orderdate) // 1000 AS start_ms,
    epoch_us(o_orderdate) // 1000
      + CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 600000 * (1 + o_orderkey % 48) END AS end_ms,
    epoch_us(o_orderdate) // 1000 + (o_orderkey % 5) * 1200000 AS now_ms,
    epoch_us(o_orderdate) // 1000 AS created_ms,
    CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' WHEN 2 THEN 'running'
      WHEN 3 THEN 'paused' WHEN 4 THEN 'completed' WHEN 5 THEN 'failed' ELSE 'cancelled' END AS status,
    CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 946684800000 + 300000
      ELSE 946684800000 - 300000 END AS lease_expires_ms,
    CASE WHEN o_orderkey % 11 = 0 THEN 'archive' WHEN o_orderkey % 13 = 0 THEN 'hot' END AS pinned,
    0.0625::DOUBLE + (o_orderkey % 1100)::DOUBLE / 8 AS speed,
    CASE WHEN o_orderkey % 19 = 0 THEN 'ftp' WHEN o_orderkey % 2 = 0 THEN 'grpc' ELSE 'http' END AS target
  FROM orders)""",
    "requests": """requests AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms,
    CASE WHEN event_type = 'view' THEN 'GET'
      WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'PATCH' ELSE 'PUT' END
      ELSE 'POST' END AS method,
    CASE WHEN event_type = 'signup' THEN '/api/v1/auth/register'
      WHEN event_type = 'view' AND event_id % 2 = 0 THEN '/api/v1/health'
      WHEN event_type = 'view' THEN '/api/v1/events/' || CAST(user_id AS VARCHAR)
      WHEN event_type = 'click' THEN '/api/v1/jobs/' || CAST(user_id AS VARCHAR) || '/' ||
        CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'pause' WHEN 2 THEN 'resume' WHEN 3 THEN 'cancel' ELSE 'logs' END
      WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN '/'
      WHEN event_type = 'purchase' THEN '/api/v2/jobs/'
      ELSE '/jobs/' || CAST(user_id AS VARCHAR) END AS path,
    CASE WHEN event_id % 4 <> 0 THEN 'user' || CAST(user_id AS VARCHAR) END AS username,
    '10.0.0.' || CAST(user_id AS VARCHAR) AS ip,
    CASE WHEN event_type = 'error' THEN '404' ELSE '200' END AS status_code
  FROM events)""",
}


def with_ctes(*names: str) -> str:
    """`WITH ...` text holding the named definitions, in the given order."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"
