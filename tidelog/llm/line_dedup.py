"""Removal of passages of lines that repeat: overlapping windows of three lines.

Windows are counted by a 128-bit hash over all documents.  The first occurrence, by
`doc_id` and position, stays; lines covered by a later one go.  All of it is DataFrame
functions; a window that a third of all documents hold is counted before the shuffle, and
the join back to its occurrences is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import text_key, unused, written


def _windows(lines: Column, width: int) -> Column:
    """Two 64-bit hashes of each run of `width` lines, with its position from 1."""

    def window(i: Column) -> Column:
        own = [F.get(lines, i - 1 + k) for k in range(width)]
        return F.struct(i.alias("at"), F.xxhash64(*own).alias("h1"), F.xxhash64(*own[::-1], F.lit(width)).alias("h2"))

    n = F.size(lines) - (width - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), window))


def removed_windows(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """Rows (`doc_id`, `text_key`, `covered`): first lines of the windows to remove, ascending."""
    lines = docs.select("doc_id", text_key(text).alias("text_key"), F.split(F.col(text), "\n", -1).alias("lines"))
    rows = lines.select("doc_id", "text_key", F.explode(_windows(F.col("lines"), width)).alias("w"))
    windows = written(rows.select("doc_id", "text_key", "w.*"))
    place = F.struct("doc_id", "text_key", "at")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("at")).alias("covered"))


def _kept(lines: Column, covered: Column, width: int) -> Column:
    """What stands before, between and behind the covered windows; windows may overlap."""
    gap = lambda start, end: F.struct(start.alias("start"), (end - start).alias("length"))
    before = F.transform(covered, lambda p, i: gap(F.when(i == 0, 1).otherwise(F.get(covered, i - 1) + width), p))
    last = gap(F.get(covered, F.size(covered) - 1) + width, F.size(lines) + 1)
    gaps = F.filter(F.concat(before, F.array(last)), lambda g: g["length"] > 0)
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["start"], g["length"])))


def dedup_lines(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """`docs` with later occurrences of repeated windows removed from `text`; adds `n_lines`, `n_removed`.

    Lines are what stands between newlines, empty ones included.  Texts of fewer than `width`
    lines have no window and stay, as do null texts (`n_lines` 0).  First occurrence: smallest
    `doc_id` (null first), then text hash, then position.  Rows equal in `doc_id` and text are
    one document, so each of them has the same result.  An empty table gives an empty one.
    Columns of `docs` named like the added ones are replaced.
    """
    doc, key, covered, own, lines, kept = unused(docs, "_doc", "_key", "_covered", "_own", "_lines", "_kept")
    removed = removed_windows(docs, text, width).select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("covered").alias(covered)
    )
    condition = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key))
    joined = docs.withColumn(own, text_key(text)).join(removed, condition, "left")
    hit = F.col(covered).isNotNull()
    joined = joined.withColumn(lines, F.split(F.col(text), "\n", -1))
    joined = joined.withColumn(kept, F.when(hit, _kept(F.col(lines), F.col(covered), width)))
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    rest = F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text)).alias(text)
    counts = {"n_lines": total, "n_removed": F.when(hit, total - F.size(kept)).otherwise(0)}
    return joined.select(
        *[rest if c == text else F.col(c) for c in docs.columns if c.lower() not in counts],
        *[n.cast("long").alias(name) for name, n in counts.items()],
    )
