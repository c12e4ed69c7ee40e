"""Ordered scans over a log, safe for a key that holds a large share of all rows.

A plain `Window.partitionBy(key).orderBy(seq)` puts the whole history of a key
into one task.  Every scan here is done in two levels instead.  The ordering
column is a unique integer (log sequence, offset), so `seq div width` cuts the
log into segments of at most `width` rows:

1. one partially aggregated row per (key, segment),
2. a window over those few rows gives what each segment inherits from earlier ones,
3. a window inside (key, segment) does the rest.

No task ever holds more than one segment of a key, however hot the key is.  The input is
read twice, the first time only its keys and the scanned value.  Neither the keys nor the
ordering column may be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEGMENT_ROWS = 4_000_000
_SEG = "_seg"


def segment_of(order: str, width: int = SEGMENT_ROWS) -> Column:
    return F.expr(f"`{order}` div {int(width)}L")


def _inherit(df: DataFrame, keys: Sequence[str], width: int, order: str, per_segment, inherited):
    """Rows with their segment number and the value carried in from earlier segments."""
    rows = df.withColumn(_SEG, segment_of(order, width))
    by = [*keys, _SEG]
    summary = rows.groupBy(*by).agg(per_segment.alias("_part"))
    earlier = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(*by, inherited(F.col("_part"), earlier).alias("_carry"))
    # Rows with a NULL key are a key of their own, as in any grouping.
    names = {c: f"_carry_{n}" for n, c in enumerate(by)}
    carry = carry.select(*[F.col(c).alias(n) for c, n in names.items()], "_carry")
    same = F.col(_SEG) == F.col(names[_SEG])
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(names[key]))
    return rows.join(carry, same).drop(*names.values()), W.partitionBy(*by).orderBy(order)


def running_count(
    df: DataFrame, keys: Sequence[str], order: str, out: str, width: int = SEGMENT_ROWS
) -> DataFrame:
    """1-based position of each row within its key."""
    rows, inside = _inherit(
        df, keys, width, order, F.count(F.lit(1)), lambda part, w: F.sum(part).over(w)
    )
    position = F.coalesce("_carry", F.lit(0)) + F.row_number().over(inside)
    return rows.withColumn(out, position.cast("bigint")).drop(_SEG, "_carry")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = SEGMENT_ROWS
) -> DataFrame:
    """Sum of `value` over this row and all earlier rows of its key."""
    df = df.withColumn("_value", value)
    rows, inside = _inherit(df, keys, width, order, F.sum("_value"), lambda part, w: F.sum(part).over(w))
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.coalesce("_carry", F.lit(0)) + F.coalesce(F.sum("_value").over(upto), F.lit(0))
    return rows.withColumn(out, total).drop(_SEG, "_carry", "_value")


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = SEGMENT_ROWS
) -> DataFrame:
    """Largest `value` over this row and all earlier rows of its key."""
    df = df.withColumn("_value", value)
    rows, inside = _inherit(df, keys, width, order, F.max("_value"), lambda part, w: F.max(part).over(w))
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(out, F.greatest("_carry", F.max("_value").over(upto))).drop(
        _SEG, "_carry", "_value"
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = SEGMENT_ROWS
) -> DataFrame:
    """`value` of the row just before this one in its key (NULL for the first).  `value` is not NULL."""
    df = df.withColumn("_value", value)
    rows, inside = _inherit(
        df,
        keys,
        width,
        order,
        F.max_by("_value", order),
        lambda part, w: F.last(part).over(w),
    )
    return rows.withColumn(out, F.coalesce(F.lag("_value").over(inside), "_carry")).drop(
        _SEG, "_carry", "_value"
    )


def newest(df: DataFrame, n: int, order: str, width: int = SEGMENT_ROWS) -> DataFrame:
    """The `n` rows with the largest `order` (a unique integer).

    A plain top-k sends up to `n` rows per task to one task.  Counting rows per
    segment first finds the segment the n-th newest row is in, and a filter on
    that (pushed to the scan) drops everything older before the top-k.
    """
    counts = df.groupBy(segment_of(order, width).alias(_SEG)).agg(F.count(F.lit(1)).alias("_n"))
    newer = W.orderBy(F.desc(_SEG)).rowsBetween(W.unboundedPreceding, W.currentRow)
    cutoff = (
        counts.select(_SEG, F.sum("_n").over(newer).alias("_upto"))
        .where(F.col("_upto") >= n)
        .agg((F.max(_SEG) * F.lit(int(width))).alias("_from"))
    )
    lower = F.coalesce(cutoff.scalar(), F.lit(-(2**63)))
    return df.where(F.col(order) >= lower).orderBy(F.desc(order)).limit(n)
