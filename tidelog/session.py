"""Session helpers: a tuned builder for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidelog", cores: str | int = "*", **conf: str) -> SparkSession:
    """Build (or reuse) a session.  On a cluster, pass the cluster's own settings in `conf`."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Building a plan is several times faster without a Python stack trace per expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if "spark.master" not in conf and not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder shared by all executors for checkpoints and published tables.

    The cluster names it in `spark.checkpoint.dir`.  Only a local-mode session
    without that setting gets a temporary folder; a cluster must name one, since
    a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Whether Spark deletes the shuffle files of a query when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")  # nothing reads the shuffles behind a written table again
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to a table of its own in the shared checkpoint folder, and read back.

    What was written survives the loss of executors, is read column by column, and its
    size is known to the optimizer, which can so pick a broadcast join by measured size.
    """
    return _write(df, f"{checkpoint_root(df.sparkSession)}/{uuid.uuid4().hex}")


class Steps:
    """Tables written between jobs that go together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._folder = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._count += 1
        return _write(df, f"{self._folder}/{self._count}")

    def clear(self) -> None:
        """Delete them.  What is computed from them must have been written before."""
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
