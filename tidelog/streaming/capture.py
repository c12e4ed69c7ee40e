"""Continuous capture: decode payloads and write every change to two tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import decode, segments

Sink = Callable[[DataFrame, int], None]
HOT_SIZE = 100_000


def capture(payloads: DataFrame, globs: str = "public.*") -> DataFrame:
    """Change records of a stream of payloads, for the tables to capture."""
    return decode.capture_filter(decode.decode_payloads(payloads), globs)


def fan_out(hot_path: str, archive_path: str, size: int = HOT_SIZE) -> Sink:
    """A sink that writes a micro-batch to both tables, and retires what the hot table no longer needs.

    Each writes a folder of its own per batch, replaced when the batch is run again.  The
    engine records the batch as done only after both writes, so a crash in between
    repeats it: nothing is lost and nothing is there twice.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for path in (hot_path, archive_path):
                batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            counted = batch.agg(F.count(F.lit(1)).alias("n"))
            counted.write.mode("overwrite").parquet(f"{_counts(hot_path)}/batch={batch_id}")
        finally:
            batch.unpersist()
        retire(batch.sparkSession, hot_path, size)

    return sink


def _counts(path: str) -> str:
    """Beside the hot table: the row count of every batch it still has."""
    return f"{path.rstrip('/')}-counts"


def retire(spark: SparkSession, hot_path: str, size: int = HOT_SIZE) -> list[int]:
    """Delete the hot table's batches behind its newest `size` rows, and return their numbers.

    Batches follow the log, so a batch is not needed once the ones after it have `size` rows.
    Which these are depends only on the counts: running it again, or after a crash between two
    deletions, ends with the same folders.
    """
    counts = spark.read.option("basePath", _counts(hot_path)).parquet(f"{_counts(hot_path)}/batch=*")
    newer = W.orderBy(F.desc("batch")).rowsBetween(W.unboundedPreceding, -1)
    behind = counts.withColumn("_newer", F.sum("n").over(newer)).where(F.col("_newer") >= size)
    old = sorted(r.batch for r in behind.select("batch").toLocalIterator())
    jvm = spark.sparkContext._jvm
    for batch in old:
        # The rows first: a count without rows is retired again.
        for folder in (hot_path, _counts(hot_path)):
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return old


def quarantine_to(path: str, sink: Sink) -> Sink:
    """Write the undecodable payloads of a batch to `path`, then hand the decoded rest to `sink`."""

    def run(batch: DataFrame, batch_id: int) -> None:
        decode.quarantine(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        sink(decode.decode_payloads(batch), batch_id)

    return run


def run(stream: DataFrame, sink: Sink, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream into `sink`; `once` handles all that is there and stops."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def from_now(stream: DataFrame, stored: DataFrame, marker: str, order: str = "seq") -> DataFrame:
    """The part of a stream behind all rows that are `stored` when it is first started.

    `marker` is a folder that remembers where that was, so a restart goes on from there and
    does not skip what came while the stream was down.
    """
    spark = stored.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{marker}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        stored.agg(F.max(order).alias("start")).write.mode("overwrite").parquet(marker)
    start = spark.read.parquet(marker).first()["start"]
    return stream if start is None else stream.where(F.col(order) > F.lit(start))


def tail(path: str, progress: str, size: int = 10, order: str = "seq") -> Sink:
    """A sink for a live tail: each micro-batch goes to `path` with `chunk`, groups of `size` events in order.

    Chunks run on from batch to batch.  `progress` has one row per batch, the events up to
    its end, so a batch run again starts where it did.
    """

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = 0
        if batch_id:
            # One row; batches are numbered without gaps.
            before = spark.read.parquet(f"{progress}/batch={batch_id - 1}").agg(F.max("events")).first()[0]
        numbered = segments.running_count(batch, [], order, "_n")
        out = numbered.withColumn("chunk", F.expr(f"({int(before)} + _n - 1) div {int(size)}")).drop("_n")
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        written = spark.read.schema(out.schema).parquet(f"{path}/batch={batch_id}")
        events = written.agg((F.count(F.lit(1)) + int(before)).alias("events"))
        events.write.mode("overwrite").parquet(f"{progress}/batch={batch_id}")

    return run_batch


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All that `fan_out` has written to one table."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def hot_rows(spark: SparkSession, path: str, size: int = HOT_SIZE, order: str = "seq") -> DataFrame:
    """The hot table of `fan_out`: the newest `size` rows, from the batches that are not retired."""
    return segments.newest(committed(spark, path), size, order)
