"""Keyed state for very many keys: one state value per bucket of keys, as an Arrow table.

A call per key costs a round trip to the JVM per key; a bucket is read, changed and written
as a whole, by array operations on all its keys.  State lives in Spark's state store, so it is
checkpointed with the stream, restored at a restart, and readable with the state reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

BUCKET = "_bucket"

#: Buckets of keys.  A bucket's state is written anew when one of its keys changes: take so many
#: that a bucket has some ten thousand keys.  It must not change over a stream's life.
BUCKETS = 256

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "rows"


def bucket_of(*keys: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def use_state_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which timers and value state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


class BucketState(StatefulProcessor):
    """A processor whose state is one table per bucket; subclasses say what a batch of rows does to it."""

    def init(self, handle) -> None:
        self._handle = handle
        self._value = handle.getValueState(_STATE, "value binary")

    @staticmethod
    def whole(rows: Iterator[pd.DataFrame], names: list[str]) -> pd.DataFrame:
        """All rows of a call, under their columns' own names, which Spark changes if they are no identifiers."""
        out = pd.concat([part.set_axis(names, axis=1) for part in rows], ignore_index=True)
        # Strings as objects: Spark takes no chunked Arrow strings back.
        return out.astype({c: object for c in names if pd.api.types.is_string_dtype(out[c])})

    def load(self) -> pa.Table | None:
        return unpacked(bytes(self._value.get()[0])) if self._value.exists() else None

    def store(self, table: pa.Table) -> None:
        if len(table):
            self._value.update((packed(table),))
        else:
            self._value.clear()

    def close(self) -> None:
        pass


def stored_rows(spark: SparkSession, checkpoint: str, schema: str, columns: list[str]) -> DataFrame:
    """All rows in the state of a stream of `BucketState`, as of its last finished batch."""
    state = spark.read.format("statestore").option("stateVarName", _STATE).load(checkpoint)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield from unpacked(value.as_py()).select(columns).to_batches()

    return state.select(F.col("value.value").alias("value")).mapInArrow(run, schema)
