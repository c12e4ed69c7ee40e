"""Streaming jobs run over all the data there is, each with its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidelog.operators.dedup import KEY
from tidelog.plans import datasets as d, state_queries
from tidelog.plans import log_queries as _log  # noqa: F401  (its oracle is used below)
from tidelog.plans.registry import ORACLES, query
from tidelog.schemas import CHANGE_RECORD, LEDGER, SchemaMismatch
from tidelog.session import checkpoint_root
from tidelog.sources import logs
from tidelog.sources.tables import table
from tidelog.streaming import capture, dedup
from tidelog.streaming.target import maintain, maintained

_FILES = 4

#: Micro-batches have files of at least so many rows, so that large ones are written and read by many tasks.
_FILE_ROWS = 100_000


def _folder(spark) -> str:
    return f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"


def _stream(df, path, files=_FILES):
    """`df` written as a few log files and opened as a stream of one file per micro-batch."""
    df.repartition(files).write.parquet(path)
    return logs.stream_log(df.sparkSession, path, df.schema, files_per_trigger=1)


def _in_order(df, path, order, batches=_FILES, files=2, made=lambda rows: rows):
    """`df` as a stream of `batches` micro-batches, each a stretch of `order`, at least `files` files wide.

    The files have what `made` makes of the rows, in the tasks that write them.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    low = low or 0
    width = ((high or 0) - low) // batches + 1
    # All stretches have as many files, none of them empty: by the one with the fewest rows.
    sizes = df.groupBy(F.expr(f"(`{order}` - {low}L) div {width}L").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    fewest = sizes.where("n IS NOT NULL").agg(F.when(F.count("n") == batches, F.min("rows")).alias("rows")).first()["rows"]
    files = max(files, (fewest or 0) // _FILE_ROWS)
    # Written one after the other, since a file stream follows the age of its files.
    for n in range(batches):
        start = low + n * width
        stretch = df.where(F.col(order).between(start, start + width - 1))
        made(stretch.repartition(files)).write.mode("append").parquet(path)
    return logs.stream_log(df.sparkSession, path, made(df).schema, files_per_trigger=files)


@query("stream_capture", ORACLES["wal_decode"])
def stream_capture(spark, sf_dir):
    root = _folder(spark)
    stream = capture.capture(_stream(d.payloads(spark, sf_dir), f"{root}/payloads"), "public.*")
    out = f"{root}/records"
    capture.run(stream, _append_to(out), f"{root}/progress").awaitTermination()
    records = capture.committed(spark, out)
    return records.select(
        "lsn", "change_idx", "commit_time", "tbl", "operation", F.col("new")["id"].alias("new_id"),
        F.col("new")["amt"].alias("new_amt"), F.col("new")["kind"].alias("new_kind"), F.col("old")["id"].alias("old_id"),
    )


def _append_to(path):
    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


@query(
    "stream_fanout",
    d.with_ctes("changes", "hot")
    + """SELECT sink, tbl, operation, count(*)::BIGINT AS n FROM changes CROSS JOIN (VALUES ('archive'), ('hot')) s(sink)
GROUP BY ALL
UNION ALL SELECT 'hot, kept', tbl, operation, count(*)::BIGINT FROM hot GROUP BY ALL""",
)
def stream_fanout(spark, sf_dir):
    """Every change in both tables, counted there batch by batch, and what retention then leaves of the hot one."""
    root = _folder(spark)
    events = table(spark, sf_dir, "events")
    stream = d.flat_changes_of(_in_order(events, f"{root}/events", "event_id")).drop("ts")
    hot, archive = f"{root}/hot", f"{root}/archive"
    fan_out, append = capture.fan_out(hot, archive), _append_to(f"{root}/written")

    def counted(rows, sink):
        return rows.groupBy(F.lit(sink).alias("sink"), "tbl", "operation").agg(F.count(F.lit(1)).alias("n"))

    def sink(batch, n):
        fan_out(batch, n)
        # The newest batch is in the hot table whatever was retired.
        append(counted(batch.sparkSession.read.schema(batch.schema).parquet(f"{hot}/batch={n}"), "hot"), n)

    capture.run(stream, sink, f"{root}/progress").awaitTermination()
    written = capture.committed(spark, f"{root}/written").groupBy("sink", "tbl", "operation").agg(F.sum("n").alias("n"))
    kept = counted(capture.hot_rows(spark, hot), "hot, kept")
    return written.unionByName(counted(capture.committed(spark, archive), "archive")).unionByName(kept)


@query(
    "stream_plugged",
    d.with_ctes("changes")
    + """SELECT tbl, operation, count(*)::BIGINT AS n, max(seq) AS last_seq FROM changes GROUP BY ALL""",
)
def stream_plugged(spark, sf_dir):
    """A target of the caller's own: a function of a micro-batch and its number, here one that counts."""
    root = _folder(spark)
    kept = [F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq")]
    append = _append_to(f"{root}/counts")
    images = lambda rows: d.with_images(rows, d.new_image(), d.old_image()).drop("ts")
    stream = _in_order(d.flat_changes(spark, sf_dir), f"{root}/log", "seq", made=images)
    capture.run(
        stream, lambda batch, n: append(batch.groupBy("tbl", "operation").agg(*kept), n), f"{root}/progress"
    ).awaitTermination()
    counts = capture.committed(spark, f"{root}/counts")
    return counts.groupBy("tbl", "operation").agg(F.sum("n").alias("n"), F.max("last_seq").alias("last_seq"))


@query(
    "schema_guard",
    d.with_ctes("changes", "images", "keyed", "ledger")
    + """SELECT 'log' AS input, true AS accepted, count(*)::BIGINT AS n FROM changes
UNION ALL SELECT 'ledger', true, count(*)::BIGINT FROM ledger UNION ALL SELECT 'events', false, 0""",
)
def schema_guard(spark, sf_dir):
    """Stored inputs opened behind the guard: the log, the ledger, and a table that is no log."""
    root = _folder(spark)
    log = d.changes(spark, sf_dir).select(*CHANGE_RECORD.names)
    log.write.parquet(f"{root}/log")
    d.ledger(spark, sf_dir).write.parquet(f"{root}/ledger")
    inputs = {
        "log": (f"{root}/log", CHANGE_RECORD),
        "ledger": (f"{root}/ledger", LEDGER),
        "events": (f"{sf_dir}/events.parquet", CHANGE_RECORD),
    }
    out = []
    for name, (path, schema) in inputs.items():
        try:
            opened, accepted = logs.read_log(spark, path, schema), True
        except SchemaMismatch:
            opened, accepted = spark.range(0), False
        counted = opened.agg(F.count(F.lit(1)).alias("n"))
        out.append(counted.select(F.lit(name).alias("input"), F.lit(accepted).alias("accepted"), "n"))
    return out[0].union(out[1]).union(out[2])


@query(
    "stream_tail",
    d.with_ctes("changes")
    + """SELECT seq, tbl, operation, (row_number() OVER (ORDER BY seq) - 1) // 10 AS chunk FROM changes
WHERE seq > (SELECT max(seq) // 4 FROM changes)""",
)
def stream_tail(spark, sf_dir):
    """A tail that starts when a quarter of the log is there, and is started again halfway through the rest."""
    root = _folder(spark)
    log = d.flat_changes_of(table(spark, sf_dir, "events")).select("seq", "tbl", "operation")
    last = log.agg(F.max("seq")).first()[0] or 0
    cuts = [-1, last // 4, last * 5 // 8, last]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        stream = _in_order(log.where(F.col("seq").between(low + 1, high)), f"{root}/log", "seq", batches=1 if n == 0 else 2)
        tail = capture.from_now(stream, spark.read.parquet(f"{root}/log"), f"{root}/start")
        sink = capture.tail(f"{root}/tail", f"{root}/counted")
        capture.run(tail, sink, f"{root}/progress").awaitTermination()
    return capture.committed(spark, f"{root}/tail").drop("batch")


@query("stream_dedup", ORACLES["ttl_dedup"])
def stream_dedup(spark, sf_dir):
    root = _folder(spark)
    # Deliveries arrive in order of time; most keys are seen in several micro-batches.
    stream = _in_order(d.redeliveries(spark, sf_dir), f"{root}/log", "delivered_ms", batches=6)
    kept = dedup.dedup_stream(stream, "delivered_ms", "delivery", expire=False)
    capture.run(kept, _append_to(f"{root}/kept"), f"{root}/progress").awaitTermination()
    return capture.committed(spark, f"{root}/kept").select("delivery", KEY, "delivered_ms")


@query("stream_apply", d.with_ctes("changes").rstrip() + ",\n" + state_queries._state_sql(state_queries._LOG_ROWS))
def stream_apply(spark, sf_dir):
    root = _folder(spark)
    log = d.flat_changes(spark, sf_dir)
    images = lambda rows: d.with_images(rows, d.new_image(), d.old_image()).select("seq", "tbl", "operation", "old", "new")
    stream = maintain(_in_order(log, f"{root}/log", "seq", made=images), state_queries.TARGET)
    capture.run(stream, _append_to(f"{root}/rejected"), f"{root}/progress").awaitTermination()
    return maintained(spark, f"{root}/progress", state_queries.TARGET)
