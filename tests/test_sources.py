"""Options for a stored or streamed log, rows from a broker, metric pages from files."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.operators import decode, metrics
from tidelog.schemas import SchemaMismatch
from tidelog.session import Steps, cut_lineage
from tidelog.sources import logs


def test_kafka_options():
    start = logs.kafka_options("b:9092", "t", start_ms=5)
    assert start["startingTimestamp"] == "5" and start["startingOffsetsByTimestampStrategy"] == "latest"
    saved = logs.kafka_options("b:9092", "t", start_ms=5, checkpoint={0: 40, 2: 7}, partitions=4, ends={0: 99})
    assert json.loads(saved["startingOffsets"]) == {"t": {"0": 41, "1": -2, "2": 8, "3": -2}}
    assert json.loads(saved["endingOffsets"]) == {"t": {"0": 99}} and "startingTimestamp" not in saved


def test_rows_of_a_broker_become_the_archive(spark):
    rows = spark.createDataFrame([(3, 8, b"public.t", b'{"lsn": "1", "operation": "DELETE"}')], "partition int, offset long, key binary, value binary")
    archive = logs.from_kafka(rows.withColumn("timestamp", F.timestamp_millis(F.lit(1_700_000_000_123))))
    assert [tuple(r)[:4] for r in archive.collect()] == [(3, 8, 1_700_000_000_123, "public.t")]
    assert [(r.lsn, r.operation) for r in decode.decode_envelopes(archive.drop("tbl")).collect()] == [("1", "DELETE")]


def test_stored_log_is_checked(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/log")
    assert logs.read_log(spark, f"{tmp_path}/log", spark.range(1).schema).count() == 3
    with pytest.raises(SchemaMismatch):
        logs.read_log(spark, f"{tmp_path}/log", spark.createDataFrame([], "other string").schema)


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text('# HELP x_total Told\nx_total{l="1"} 2\n')
    (tmp_path / "b.txt").write_text("y 3\nno value\n")
    samples = metrics.parse_pages(metrics.read_pages(spark, str(tmp_path)), ["page"])
    got = sorted((r.page[-5:], r.pos, r.name, r.labels, r.value, r.help) for r in samples.collect())
    assert got == [("a.txt", 1, "x_total", {"l": "1"}, 2.0, "Told"), ("b.txt", 0, "y", {}, 3.0, "")]


def test_steps_go_when_cleared(spark):
    steps = Steps(spark)
    rows = steps.write(spark.range(5))
    kept = cut_lineage(rows.where("id > 2"))
    steps.clear()
    assert kept.count() == 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        rows.count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
