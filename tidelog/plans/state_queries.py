"""Queries over idempotency keys, the ledger and table state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.operators import apply, dedup, segments
from tidelog.plans import datasets as d
from tidelog.plans.registry import query
from tidelog.sources.tables import table

TARGET = apply.Target(keys=("id",), columns={"id": "bigint", "amt": "double", "kind": "string"})
AS_OF_MS = 1_705_449_600_000  # 2024-01-17 00:00:00 UTC

_KEYED = d.with_ctes("changes", "images", "keyed")
_LEDGER = d.with_ctes("changes", "images", "keyed", "ledger")
_DELIVERIES = d.with_ctes("changes", "images", "keyed", "ledger", "deliveries")
_CHANGES = d.with_ctes("changes")


# --- idempotency ----------------------------------------------------------------


@query("idempotency_key", _KEYED + "SELECT seq, idempotency_key FROM keyed")
def idempotency_key(spark, sf_dir):
    return d.changes(spark, sf_dir).select("seq", d.content_key().alias("idempotency_key"))


@query(
    "pk_key",
    _CHANGES
    + """SELECT seq, lsn || ':' || tbl || ':' || CASE WHEN operation = 'TRUNCATE' THEN '' ELSE CAST(id AS VARCHAR) END
  || ':' || CASE WHEN operation IN ('INSERT', 'UPDATE') THEN coalesce(kind, '') ELSE '' END AS pk_key FROM changes""",
)
def pk_key(spark, sf_dir):
    key = keys.primary_key(
        F.col("lsn"), F.col("tbl"), F.col("operation"), F.col("old"), F.col("new"), ["id", "kind"]
    )
    return d.changes(spark, sf_dir).select("seq", key.alias("pk_key"))


@query(
    "dedup_ledger",
    _DELIVERIES
    + f"""SELECT d.delivery, l.idempotency_key IS NOT NULL AS was_duplicate FROM deliveries d
LEFT JOIN ledger l ON l.idempotency_key = d.idempotency_key AND l.expires_at > {d.NOW_MS}""",
)
def dedup_ledger(spark, sf_dir):
    marked = dedup.mark_duplicates(d.deliveries(spark, sf_dir), d.ledger(spark, sf_dir), d.NOW_MS)
    return marked.select("delivery", "was_duplicate")


@query(
    "ledger_upsert",
    _DELIVERIES.rstrip()
    + """,
marks AS (SELECT * FROM ledger UNION ALL
  SELECT idempotency_key, delivered_ms, 'job-run', delivered_ms + 604800000 FROM deliveries)
SELECT idempotency_key, max(processed_at) AS processed_at, max_by(job_id, processed_at::VARCHAR || job_id) AS job_id,
  max(expires_at) AS expires_at FROM marks GROUP BY idempotency_key""",
)
def ledger_upsert(spark, sf_dir):
    applied = d.deliveries(spark, sf_dir).select(
        "idempotency_key", F.col("delivered_ms").alias("processed_at"), F.lit("job-run").alias("job_id")
    )
    return dedup.upsert_ledger(d.ledger(spark, sf_dir), applied)


@query(
    "check_and_mark",
    _DELIVERIES
    + """SELECT idempotency_key, min(delivery) AS delivery FROM deliveries
WHERE idempotency_key NOT IN (SELECT idempotency_key FROM ledger) GROUP BY idempotency_key""",
)
def check_and_mark(spark, sf_dir):
    rows = d.deliveries(spark, sf_dir).select("idempotency_key", "delivered_ms", "delivery", "old", "new")
    marked = dedup.check_and_mark(rows, d.ledger(spark, sf_dir), ["delivered_ms", "delivery"])
    return marked.select("idempotency_key", "delivery")


# The definition itself, from one applied delivery of a key to the next.
_TTL = (
    "WITH RECURSIVE "
    + d.with_ctes("changes", "redeliveries").removeprefix("WITH ").rstrip()
    + f""",
walk AS (
  SELECT idempotency_key, min(delivered_ms) AS last FROM redeliveries GROUP BY idempotency_key
  UNION ALL
  SELECT w.idempotency_key, min(r.delivered_ms) FROM walk w
  JOIN redeliveries r ON r.idempotency_key = w.idempotency_key AND r.delivered_ms >= w.last + {dedup.TTL_MS}
  GROUP BY w.idempotency_key)
SELECT min(delivery) AS delivery, w.idempotency_key, last AS delivered_ms FROM walk w
JOIN redeliveries r ON r.idempotency_key = w.idempotency_key AND r.delivered_ms = last GROUP BY w.idempotency_key, last"""
)


@query("ttl_dedup", _TTL)
def ttl_dedup(spark, sf_dir):
    kept = dedup.dedup_by_ttl(d.redeliveries(spark, sf_dir), "delivered_ms", "delivery")
    return kept.select("delivery", "idempotency_key", "delivered_ms")


@query(
    "ledger_cleanup",
    _LEDGER
    + f"""SELECT count(*) FILTER (expires_at >= {d.NOW_MS})::BIGINT AS kept,
  count(*) FILTER (expires_at < {d.NOW_MS})::BIGINT AS removed FROM ledger""",
)
def ledger_cleanup(spark, sf_dir):
    return dedup.cleanup_counts(d.ledger(spark, sf_dir), d.NOW_MS)


@query(
    "replay_outcomes",
    _DELIVERIES
    + f"""SELECT outcome, error_type, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN error_type IS NOT NULL THEN 'failed' WHEN hit THEN 'duplicate_skipped' ELSE 'applied' END AS outcome, error_type
  FROM (SELECT CASE WHEN d.seq % 59 = 0 THEN 'unknown' WHEN d.seq % 41 = 0 THEN 'dedup_error'
      WHEN l.idempotency_key IS NOT NULL THEN NULL WHEN d.seq % 37 = 0 THEN 'apply_error' END AS error_type,
      l.idempotency_key IS NOT NULL AS hit
    FROM deliveries d LEFT JOIN ledger l ON l.idempotency_key = d.idempotency_key AND l.expires_at > {d.NOW_MS}
      AND d.seq % 59 <> 0))
GROUP BY ALL""",
)
def replay_outcomes(spark, sf_dir):
    seq = F.col("seq")
    rows = (
        d.deliveries(spark, sf_dir)
        .withColumn("operation", F.when(seq % 37 == 0, F.lit("MERGE")).otherwise(F.col("operation")))
        .withColumn("idempotency_key", F.when(seq % 59 != 0, F.col("idempotency_key")))
    )
    outcomes = dedup.classify(rows, d.ledger(spark, sf_dir), d.NOW_MS, lookup_failed=seq % 41 == 0)
    return outcomes.groupBy("outcome", "error_type").agg(F.count(F.lit(1)).alias("n"))


# --- table state ------------------------------------------------------------------


def _base(spark, sf_dir):
    """Target rows before the log: all customers, and all suppliers in a table of their own."""

    def rows(name, key, amount, tbl):
        row = table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("id"), F.col(amount).cast("double").alias("amt"))
        return row.select(tbl.alias("tbl"), "id", "amt", F.lit("base").alias("kind"))

    of_log = F.concat(F.lit("public.t"), (F.col("id") % 4).cast("string"))
    customers = rows("customer", "c_custkey", "c_acctbal", of_log)
    return customers.unionByName(rows("supplier", "s_suppkey", "s_acctbal", F.lit("public.t4")))


_BASE = (
    _CHANGES.rstrip()
    + """,
base AS (SELECT 'public.t' || CAST(c_custkey % 4 AS VARCHAR) AS tbl, CAST(c_custkey AS BIGINT) AS id,
    CAST(c_acctbal AS DOUBLE) AS amt, 'base' AS kind FROM customer
  UNION ALL SELECT 'public.t4', CAST(s_suppkey AS BIGINT), CAST(s_acctbal AS DOUBLE), 'base' FROM supplier)
"""
)


@query(
    "apply_insert",
    _BASE
    + """SELECT tbl, id, amt, kind FROM base UNION ALL
SELECT tbl, id, amt, kind FROM (SELECT *, row_number() OVER (PARTITION BY tbl, id ORDER BY seq) AS rn FROM changes c
  WHERE operation = 'INSERT' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.tbl = c.tbl AND b.id = c.id)) WHERE rn = 1""",
)
def apply_insert(spark, sf_dir):
    return apply.apply_inserts(_base(spark, sf_dir), d.changes(spark, sf_dir), TARGET)


@query(
    "apply_update",
    _BASE
    + """SELECT b.tbl, b.id, coalesce(u.amt, b.amt) AS amt, coalesce(u.kind, b.kind) AS kind FROM base b LEFT JOIN (
  SELECT tbl, id, max_by(amt, seq) FILTER (amt IS NOT NULL) AS amt, max_by(kind, seq) FILTER (kind IS NOT NULL) AS kind
  FROM changes WHERE operation = 'UPDATE' GROUP BY tbl, id) u USING (tbl, id)""",
)
def apply_update(spark, sf_dir):
    return apply.apply_updates(_base(spark, sf_dir), d.changes(spark, sf_dir), TARGET)


@query(
    "apply_delete",
    _BASE
    + """SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM changes c
  WHERE c.operation = 'DELETE' AND c.tbl = b.tbl AND c.id = b.id)""",
)
def apply_delete(spark, sf_dir):
    return apply.apply_deletes(_base(spark, sf_dir), d.changes(spark, sf_dir), TARGET)


@query(
    "apply_truncate",
    _BASE + """SELECT * FROM base WHERE tbl NOT IN (SELECT tbl FROM changes WHERE operation = 'TRUNCATE')""",
)
def apply_truncate(spark, sf_dir):
    return apply.apply_truncates(_base(spark, sf_dir), d.changes(spark, sf_dir))


def _state_sql(rows: str) -> str:
    """Barrier, last delete, first insert after it, then the last value per column."""
    return f"""log AS ({rows}),
l1 AS (SELECT *, max(seq) FILTER (operation = 'TRUNCATE') OVER (PARTITION BY tbl) AS barrier FROM log),
l2 AS (SELECT *, max(seq) FILTER (operation = 'DELETE') OVER (PARTITION BY tbl, id) AS death FROM l1
  WHERE seq > coalesce(barrier, -9)),
l3 AS (SELECT *, min(seq) FILTER (operation = 'INSERT') OVER (PARTITION BY tbl, id) AS birth FROM l2
  WHERE seq > coalesce(death, -9))
SELECT tbl, id, max_by(amt, seq) FILTER (amt IS NOT NULL) AS amt, max_by(kind, seq) FILTER (kind IS NOT NULL) AS kind
FROM l3 WHERE seq = birth OR (operation = 'UPDATE' AND seq > birth) GROUP BY tbl, id"""


_LOG_ROWS = "SELECT seq, tbl, operation, id, amt, kind FROM changes"
_DEDUPED = "SELECT DISTINCT seq, tbl, operation, id, amt, kind FROM deliveries"


@query(
    "apply_changes",
    d.with_ctes("changes", "images", "keyed", "deliveries").rstrip() + ",\n" + _state_sql(_DEDUPED),
)
def apply_changes(spark, sf_dir):
    """The flagship: redelivered changes are dropped, the rest is applied in log order."""
    delivered = d.deliveries(spark, sf_dir).select("idempotency_key", "seq", "tbl", "operation", "old", "new")
    # The content key alone would merge two equal changes of one payload.
    first = delivered.dropDuplicates(["idempotency_key", "seq"])
    return apply.apply_log(first, TARGET, raw_log=delivered)


@query(
    "apply_status",
    _CHANGES
    + """SELECT status, operation, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN seq % 37 = 0 THEN 'MERGE' ELSE operation END AS operation,
    CASE WHEN seq % 37 = 0 THEN 'apply_error'
      WHEN operation IN ('INSERT', 'UPDATE') AND seq % 31 = 0 THEN 'noop'
      WHEN operation IN ('INSERT', 'UPDATE') AND amt IS NOT NULL AND seq % 29 = 0 THEN 'apply_error'
      ELSE 'applied' END AS status FROM changes) GROUP BY ALL""",
)
def apply_status(spark, sf_dir):
    seq = F.col("seq")
    bad_amount = F.transform_values("new", lambda k, v: F.when(k == "amt", F.lit("n/a")).otherwise(v))
    none = F.map_filter("new", lambda k, v: F.lit(False))
    new = F.when(seq % 31 == 0, none).when(seq % 29 == 0, bad_amount).otherwise(F.col("new"))
    rows = d.with_images(d.changes(spark, sf_dir), new, F.col("old")).withColumn(
        "operation", F.when(seq % 37 == 0, F.lit("MERGE")).otherwise(F.col("operation"))
    )
    return rows.groupBy(apply.apply_status(TARGET).alias("status"), "operation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "apply_dry_run",
    _CHANGES
    + """SELECT seq, operation || ' on ' || tbl || ': old=' ||
  CASE WHEN operation IN ('UPDATE', 'DELETE') THEN '{"id":"' || id || '"}' ELSE '{}' END || ', new=' ||
  CASE WHEN operation IN ('INSERT', 'UPDATE') THEN '{"id":"' || id || '"' || coalesce(',"amt":"' || amt || '"', '')
    || coalesce(',"kind":"' || kind || '"', '') || '}' ELSE '{}' END AS action FROM changes""",
)
def apply_dry_run(spark, sf_dir):
    return apply.dry_run(d.changes(spark, sf_dir)).select("seq", "action")


@query(
    "state_as_of",
    _BASE.rstrip()
    + ",\n"
    + _state_sql(
        f"{_LOG_ROWS} WHERE commit_time <= {AS_OF_MS} UNION ALL SELECT -1, tbl, 'INSERT', id, amt, kind FROM base"
    ),
)
def state_as_of(spark, sf_dir):
    return apply.state_as_of(d.changes(spark, sf_dir), TARGET, AS_OF_MS, base=_base(spark, sf_dir))


# The definition itself, one change after the other: the row of a key, and the one it moves to
# (`b_*`).  A test that is NULL holds; TRUNCATE and changes without `id` come to every key.
def _walk_sql(log: str) -> str:
    hit = "alive AND (t_kind IS NULL OR w.kind = t_kind) AND (t_amt IS NULL OR w.amt = t_amt)"
    stays, goes = f"operation = 'UPDATE' AND {hit} AND NOT moves", f"operation = 'UPDATE' AND {hit} AND moves AND NOT b_alive"
    return (
        "WITH RECURSIVE "
        + _BASE.removeprefix("WITH ").rstrip()
        + f""",
log AS ({log}),
ids AS (SELECT tbl, id FROM base UNION SELECT tbl, id FROM changes),
met AS (SELECT * FROM log WHERE id IS NOT NULL AND operation <> 'TRUNCATE'
  UNION ALL SELECT l.* REPLACE (i.id AS id) FROM log l JOIN ids i ON i.tbl = l.tbl WHERE l.id IS NULL OR operation = 'TRUNCATE'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tbl, id ORDER BY seq) AS n FROM met),
walk AS (
  SELECT i.tbl, i.id, 0::BIGINT AS n, b.id IS NOT NULL AS alive, b.amt, b.kind, false AS b_alive,
    NULL::DOUBLE AS b_amt, NULL::VARCHAR AS b_kind
  FROM ids i LEFT JOIN base b ON b.tbl = i.tbl AND b.id = i.id
  UNION ALL
  SELECT w.tbl, w.id, c.n,
    CASE WHEN operation = 'INSERT' THEN true WHEN operation = 'TRUNCATE' OR (operation = 'DELETE' AND {hit}) OR ({goes}) THEN false
      ELSE alive END,
    CASE WHEN operation = 'INSERT' AND NOT alive THEN c.amt WHEN {stays} THEN coalesce(c.amt, w.amt) ELSE w.amt END,
    CASE WHEN operation = 'INSERT' AND NOT alive THEN c.kind WHEN {stays} THEN coalesce(c.kind, w.kind) ELSE w.kind END,
    CASE WHEN operation = 'TRUNCATE' THEN false WHEN {goes} THEN true ELSE b_alive END,
    CASE WHEN {goes} THEN coalesce(c.amt, w.amt) ELSE b_amt END,
    CASE WHEN {goes} THEN coalesce(c.kind, w.kind) ELSE b_kind END
  FROM walk w JOIN numbered c ON c.tbl = w.tbl AND c.id = w.id AND c.n = w.n + 1),
ended AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY tbl, id ORDER BY n DESC) = 1)
SELECT tbl, id, amt, kind FROM ended WHERE alive
UNION ALL SELECT tbl, id + 100000, b_amt, b_kind FROM ended WHERE b_alive"""
    )


def rekeyed(spark, sf_dir):
    """The log with every 50th UPDATE moving its key, and `old` images that test more than the key.

    They test what the key's previous change brought, if it brought anything: mostly the row as
    it is, but not where that change did nothing.
    """
    before = segments.previous(d.flat_changes(spark, sf_dir), ["tbl", "id"], "seq", F.struct("kind", "amt"), "before")
    seq, update = F.col("seq"), F.col("operation") == "UPDATE"
    to = F.when(update & (seq % 50 == 0), F.col("id") + 100000).otherwise(F.col("id")).cast("string")
    new = F.transform_values(d.new_image(), lambda c, v: F.when(c == "id", to).otherwise(v))
    tested = F.map_from_arrays(
        F.array(F.lit("kind"), F.lit("amt")),
        F.array(F.when(seq % 3 != 0, F.col("before.kind")), F.when(seq % 4 == 1, F.col("before.amt").cast("string"))),
    )
    more = F.map_filter(tested, lambda _, v: v.isNotNull() & F.col("operation").isin("UPDATE", "DELETE"))
    return d.with_images(before, new, F.map_concat(d.old_image(), more))


@query(
    "apply_rekey",
    _walk_sql("""SELECT seq, tbl, operation, id, amt, kind, seq % 50 = 0 AS moves,
    CASE WHEN seq % 3 <> 0 THEN lag(kind) OVER k END AS t_kind, CASE WHEN seq % 4 = 1 THEN lag(amt) OVER k END AS t_amt
  FROM changes WINDOW k AS (PARTITION BY tbl, id ORDER BY seq)"""),
)
def apply_rekey(spark, sf_dir):
    return apply.apply_general(rekeyed(spark, sf_dir), TARGET, base=_base(spark, sf_dir))


@query(
    "apply_many_rows",
    _walk_sql("""SELECT seq, tbl, operation, CASE WHEN NOT wide THEN id END AS id, amt, CASE WHEN NOT wide THEN kind END AS kind, false AS moves,
    CASE WHEN wide THEN CASE seq % 2 WHEN 0 THEN 'click' ELSE 'signup' END END AS t_kind,
    CASE WHEN wide AND operation = 'DELETE' THEN amt END AS t_amt
  FROM (SELECT *, operation IN ('UPDATE', 'DELETE') AND amt IS NOT NULL AND seq % 23 = 5 AS wide FROM changes)"""),
)
def apply_many_rows(spark, sf_dir):
    """The log with some changes that name rows by other columns: all clicks get an amount, some signups go."""
    seq, op = F.col("seq"), F.col("operation")
    wide = op.isin("UPDATE", "DELETE") & F.col("amt").isNotNull() & (seq % 23 == 5)
    amount = F.col("amt").cast("string")
    kind = F.when(seq % 2 == 0, "click").otherwise("signup")
    names = F.map_from_arrays(F.array(F.lit("kind"), F.lit("amt")), F.array(kind, F.when(op == "DELETE", amount)))
    old = F.when(wide, F.map_filter(names, lambda _, v: v.isNotNull())).otherwise(d.old_image())
    new = F.when(wide & (op == "UPDATE"), F.map_from_arrays(F.array(F.lit("amt")), F.array(amount))).otherwise(d.new_image())
    target = apply.Target(TARGET.keys, TARGET.columns, many_rows=True)
    return apply.apply_general(d.with_images(d.flat_changes(spark, sf_dir), new, old), target, base=_base(spark, sf_dir))
