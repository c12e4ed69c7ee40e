"""The archive as stored files with a zone map: which partitions, offsets and times each file has.

Files hold ranges of (`part`, `off`) in order.  A bounded replay looks up the files it needs
in the map, one small row per file and partition, and opens no other file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidelog.operators import replay

#: Rows of a file.
FILE_ROWS = 1_000_000


def store(df: DataFrame, path: str, time_col: str = "publish_ms", file_rows: int = FILE_ROWS) -> None:
    """Write the archive to `path/log` and its zone map to `path/zones`."""
    ordered = df.repartitionByRange("part", "off").sortWithinPartitions("part", "off")
    ordered.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/log")
    rows = df.sparkSession.read.parquet(f"{path}/log")
    zones = rows.groupBy(F.col("_metadata.file_path").alias("file"), "part").agg(
        F.min("off").alias("low"), F.max("off").alias("high"),
        F.min(time_col).alias("first_ms"), F.max(time_col).alias("last_ms"), F.count(F.lit(1)).alias("n"),
    )
    zones.coalesce(1).write.parquet(f"{path}/zones")


def zones(spark: SparkSession, path: str) -> DataFrame:
    """`file`, `part`, `low` and `high` offset, `first_ms`, `last_ms`, `n`."""
    return spark.read.parquet(f"{path}/zones")


def needed(zone_map: DataFrame, start_ms: int, end_ms: int, checkpoint: Mapping[int, int] | None = None) -> DataFrame:
    """The zones a replay reads: from the one its frontier is in to the one it stops in.

    Without a checkpoint the frontier is in the first zone with a time from `start_ms` on.  The
    stop, the first row behind the frontier past `end_ms`, is in the frontier's zone or, at the
    latest, in the next zone that has such a time.
    """
    in_order = W.partitionBy("part").orderBy("low")
    saved = replay.saved_offset(checkpoint or {}) + 1
    first = F.min(F.when(F.when(saved.isNotNull(), F.col("high") >= saved).otherwise(F.col("last_ms") >= start_ms), F.col("low")))
    found = zone_map.withColumn("_from", first.over(W.partitionBy("part"))).where("low >= _from")
    # A zone is needed if no zone between the frontier's and it has a time past the end.
    behind = in_order.rowsBetween(W.unboundedPreceding, -1)
    passed = F.max(F.when((F.col("low") > F.col("_from")) & (F.col("last_ms") > end_ms), True)).over(behind)
    return found.withColumn("_passed", passed).where("_passed IS NULL").drop("_from", "_passed")


def read_files(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of the files of some zones, and no other file."""
    # The names of the files to read, as the scan needs them; Spark lists the files of any table on the driver.
    files = sorted({r.file for r in wanted.select("file").distinct().toLocalIterator()})
    log = spark.read.parquet(f"{path}/log")
    return spark.read.schema(log.schema).parquet(*files) if files else spark.createDataFrame([], log.schema)


def read_range(
    spark: SparkSession, path: str, start_ms: int, end_ms: int, checkpoint: Mapping[int, int] | None = None,
    time_col: str = "publish_ms", strict: bool = False,
) -> DataFrame:
    """`replay.archive_range` of a stored archive, from the files it needs."""
    zone_map = zones(spark, path)
    if strict:
        wanted = zone_map.where((F.col("last_ms") >= start_ms) & (F.col("first_ms") <= end_ms))
    else:
        wanted = needed(zone_map, start_ms, end_ms, checkpoint)
    return replay.archive_range(read_files(spark, path, wanted), start_ms, end_ms, checkpoint, time_col, strict)


def read_frontier(
    spark: SparkSession, path: str, start_ms: int, checkpoint: Mapping[int, int] | None = None, time_col: str = "publish_ms"
) -> DataFrame:
    """`replay.archive_frontier` of a stored archive: a partition's end from the map, its frontier from one file."""
    zone_map = zones(spark, path)
    ends = zone_map.groupBy("part").agg((F.max("high") + 1).alias("end_off"))
    saved = replay.saved_offset(checkpoint or {}) + 1
    open_ = zone_map.where(saved.isNull() & (F.col("last_ms") >= start_ms))
    first = open_.groupBy("part").agg(F.min_by("file", "low").alias("file"))
    rows = read_files(spark, path, first).where(F.col(time_col) >= start_ms).groupBy("part").agg(F.min("off").alias("_first"))
    return ends.join(rows, "part", "left").select("part", F.coalesce(saved, "_first", "end_off").alias("frontier"), "end_off")
