"""Opening stored logs, as a table or as a stream, and the options for a Kafka archive."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidelog.schemas import require_schema


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored log, after checking that it has the expected schema."""
    return require_schema(spark.read.parquet(path), schema)


def stream_log(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_trigger: int | None = None,
    glob: str | None = None,
    modified_after: str | None = None,
) -> DataFrame:
    """A folder of log files as a stream; `modified_after` (ISO time) starts at the newest files."""
    reader = spark.readStream.schema(schema)
    options = {"maxFilesPerTrigger": files_per_trigger, "pathGlobFilter": glob, "modifiedAfter": modified_after}
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.parquet(path)


def kafka_options(
    servers: str,
    topic: str,
    start_ms: int | None = None,
    checkpoint: Mapping[int, int] | None = None,
    partitions: int | None = None,
    ends: Mapping[int, int] | None = None,
) -> dict[str, str]:
    """Options of Spark's Kafka source for a replay (needs the spark-sql-kafka jar).

    Without a checkpoint every partition starts at `start_ms`, or at its end if nothing
    is that new.  With one, `partitions` names them all: saved ones start one past their
    offset, the others at their beginning.  `archive_range` with the same checkpoint then
    takes those to `start_ms`.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    if checkpoint:
        known = {str(p): int(o) + 1 for p, o in checkpoint.items()}
        rest = {str(p): -2 for p in range(partitions or 0) if p not in checkpoint}
        options["startingOffsets"] = json.dumps({topic: {**known, **rest}})
    elif start_ms is not None:
        options["startingTimestamp"] = str(start_ms)
        options["startingOffsetsByTimestampStrategy"] = "latest"
    if ends is not None:
        options["endingOffsets"] = json.dumps({topic: {str(p): int(o) for p, o in ends.items()}})
    return options


def from_kafka(df: DataFrame) -> DataFrame:
    """Kafka rows in the shape of the archive: `part`, `off`, `publish_ms`, `tbl`, `envelope`."""
    return df.select(
        F.col("partition").cast("int").alias("part"),
        F.col("offset").alias("off"),
        F.unix_millis("timestamp").alias("publish_ms"),
        F.col("key").cast("string").alias("tbl"),
        F.col("value").cast("string").alias("envelope"),
    )
