"""Physical layout of the archive and retention of the hot buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidelog.operators import segments


def layout_archive(df: DataFrame, files: int, table: str = "tbl", order: str = "seq") -> DataFrame:
    """Rows of one table contiguous and in log order, over `files` output partitions.

    Ranges of (table, order) rather than a hash of the table: a table that holds a
    large share of the log is spread over many files, each of which is in order and
    lies wholly before or after the next.
    """
    return df.repartitionByRange(files, table, order).sortWithinPartitions(table, order)


def retain_newest(df: DataFrame, size: int = 100_000, order: str = "seq") -> DataFrame:
    """The hot buffer: the newest `size` changes."""
    return segments.newest(df, size, order)
