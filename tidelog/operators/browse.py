"""Looking at the newest events: recent rows, stream statistics, gaps, search and facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.operators import segments

HEARTBEAT_MS = 5_000


def recent_events(df: DataFrame, count: int = 10, table: str | None = None, order: str = "seq") -> DataFrame:
    """The newest `count` (1 to 100) events whose table contains the given text."""
    if not 1 <= count <= 100:
        raise ValueError("count is 1 to 100")
    rows = df if not table else df.where(F.col("tbl").contains(table))
    return rows.orderBy(F.desc(order)).limit(count)


def stream_stats(df: DataFrame, committed: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Length, first and last entry id, and the entries each consumer has yet to read.

    `committed` gives the last entry id `(ms, seq)` of each consumer.
    """
    entry = F.struct("stream_ms", "stream_seq")

    def entry_id(e):
        return F.concat_ws("-", F.col(f"{e}.stream_ms").cast("string"), F.col(f"{e}.stream_seq").cast("string"))

    def unread(ms, sequence):
        later = (F.col("stream_ms") > ms) | ((F.col("stream_ms") == ms) & (F.col("stream_seq") > sequence))
        return F.count(F.when(later, F.lit(1)))

    stats = df.agg(
        F.count(F.lit(1)).alias("length"),
        F.min(entry).alias("first"),
        F.max(entry).alias("last"),
        *[unread(*at).alias(f"_p{i}") for i, at in enumerate(committed.values())],
    )
    pending = [
        F.struct(F.lit(name).alias("consumer"), F.col(f"_p{i}").alias("pending"))
        for i, name in enumerate(committed)
    ]
    return stats.select(
        "length", entry_id("first").alias("first_id"), entry_id("last").alias("last_id"), F.inline(F.array(*pending))
    )


def idle_gaps(df: DataFrame, time: str = "commit_time", order: str = "seq", every_ms: int = HEARTBEAT_MS,
              width: int = segments.SEGMENT_ROWS) -> DataFrame:
    """Silences in the log and the heartbeats sent in each: one per full `every_ms`."""
    rows = segments.previous(df, [], order, F.col(time), "_before", width)
    gap = F.col(time) - F.col("_before")
    return (
        rows.withColumn("gap_ms", gap)
        .where(F.col("gap_ms") >= every_ms)
        .withColumn("heartbeats", F.expr(f"gap_ms div {int(every_ms)}"))
        .drop("_before")
    )


def search_text(columns: Sequence[str]) -> Column:
    return F.lower(F.to_json(F.struct(*columns)))


def search(
    df: DataFrame,
    tables: Sequence[str] = (),
    operations: Sequence[str] = (),
    text: str = "",
    columns: Sequence[str] = ("lsn", "commit_time", "tbl", "operation", "old", "new"),
) -> DataFrame:
    """Events of the given tables and operations whose JSON contains the text, in any case."""
    if tables:
        df = df.where(F.col("tbl").isin(*tables))
    if operations:
        df = df.where(F.col("operation").isin(*operations))
    return df.where(search_text(columns).contains(text.lower())) if text else df


def facets(df: DataFrame) -> DataFrame:
    """The distinct non-empty tables and operations, sorted."""
    pairs = df.groupBy("tbl", "operation").agg(F.count(F.lit(1)).alias("n"))  # combined before the shuffle
    both = F.array(
        F.struct(F.lit("table").alias("facet"), F.col("tbl").alias("value")),
        F.struct(F.lit("operation").alias("facet"), F.col("operation").alias("value")),
    )
    values = pairs.select(F.inline(both)).where(F.col("value") != "").distinct()
    return values.orderBy("facet", "value")
