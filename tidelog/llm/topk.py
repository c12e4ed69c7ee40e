"""Exact nearest vectors by inner product, block by block.

Vectors become integers and are laid out in shards of blocks of consecutive rows; a block
keeps its rows as a forward index and the largest and smallest value of each component.  A
query's upper bound for a block is the sum, over components, of the greater product with
those two.  Blocks are scored in order of that bound until it falls below the query's k-th
best score so far; bounds equal to it are still scored, as ties go to the smaller id.

Every shard meets every tile of queries: that is the stated query set against all rows, in
blocks of bounded size.  A shard gives at most k rows per query, and ranking them is a
window over k rows per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

#: Rows of a shard (fewer, if there are more shuffle partitions than shards, but not under
#: `SMALL`), rows of a block, and queries of a tile; they only split the work.
SHARD, SMALL, BLOCK, TILE = 16384, 1024, 256, 4096

_LONG = np.iinfo(np.int64)


def quantized(vectors: DataFrame, scale: int = 256, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Written (`row`, `block`, `vec_id`, `q`): the components as `floor(scale * x)`.

    A vector that is null, or has a null or non-finite component, or whose id is null, takes no part.
    """
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("v")).where(usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = done + np.arange(batch.num_rows)
            done += batch.num_rows
            column = batch.column(1)
            values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
            cuts = pa.array(np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((part << 40) + at), pa.array((part << 40) + at // block), batch.column(0),
                    pa.ListArray.from_arrays(cuts, pa.array(values)),
                ],
                ["row", "block", "vec_id", "q"],
            )

    return written(rows.mapInArrow(run, "row long, block long, vec_id long, q array<double>"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond the range of a long, its end."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    if np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in queries], [[int(x) for x in r] for r in rows]
    return np.array(
        [[min(max(sum(a * b for a, b in zip(q, r)), _LONG.min), _LONG.max) for r in whole[1]] for q in whole[0]], np.int64
    ).reshape(len(queries), len(rows))


def best_of_shard(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int, block: int):
    """(query, id, score) of each query's `k` best rows; `own` is a query's row number, which it skips."""
    n_blocks = -(-len(rows) // block)
    edges = np.arange(n_blocks) * block
    high, low = np.maximum.reduceat(rows, edges), np.minimum.reduceat(rows, edges)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = up @ high.T + down @ low.T
    # Sums beyond 2**53 are rounded: bounds must not be too small then.
    bounds = np.where(np.isfinite(bounds), bounds + np.where(np.abs(bounds) >= 2.0**52, np.abs(bounds) * 1e-9, 0), np.inf)
    order = np.argsort(-bounds, 1, kind="stable")
    scores = np.full((len(queries), k), _LONG.min, np.int64)
    found = np.full((len(queries), k), _LONG.max, np.int64)
    filled = np.zeros(len(queries), np.int64)
    active = np.arange(len(queries))
    for step in range(n_blocks):
        at = order[active, step]
        on = (filled[active] < k) | (bounds[active, at] >= scores[active, k - 1].astype(np.float64))
        active, at = active[on], at[on]
        if not len(active):
            break
        for b in np.unique(at).tolist():
            q, part = active[at == b], slice(b * block, (b + 1) * block)
            s = _products(queries[q], rows[part])
            mine = row[part][None, :] == own[q][:, None]
            s_all = np.concatenate([scores[q], s], 1)
            id_all = np.concatenate([found[q], np.broadcast_to(ids[part], s.shape)], 1)
            empty = np.concatenate([np.arange(k) >= filled[q][:, None], mine], 1)
            top = np.lexsort((id_all, -s_all.astype(np.float64), empty), axis=1)[:, :k] if np.abs(s_all[~empty]).max(initial=0) < 2**53 else (
                np.array([sorted(range(s_all.shape[1]), key=lambda c: (empty[i, c], -int(s_all[i, c]), int(id_all[i, c])))[:k] for i in range(len(q))])
            )
            scores[q] = np.take_along_axis(s_all, top, 1)
            found[q] = np.take_along_axis(id_all, top, 1)
            filled[q] = np.minimum(k, (~empty).sum(1))
    query, place = np.nonzero(np.arange(k) < filled[:, None])
    return query, found[query, place], scores[query, place]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """`query_id`, `rank` from 1, `vec_id`, `score`: each query's `k` best rows (all, if fewer).

    `rows` are from `quantized`, `queries` some of them; a query's own row is no candidate, but a
    repeated row with its id is, and repeated queries each have their answers.  Ties go to the
    smaller `vec_id`.  Vectors of different lengths are compared as if the shorter ended in
    zeros.  Without queries or rows there are no answers.
    """
    n_rows, n_queries = rows.count(), queries.count()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, -(-n_rows // SHARD), min(partitions, -(-n_rows // SMALL)))
    n_tiles = max(1, -(-n_queries // TILE))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(
        F.pmod(F.xxhash64("block"), F.lit(n_shards)).cast("int").alias("shard"), each(n_tiles).alias("tile"), "row", "block", "vec_id", "q"
    )
    right = queries.select(
        each(n_shards).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(n_tiles)).cast("int").alias("tile"), "row", "vec_id", "q"
    )

    def answer(mine: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["own", "query_id", "vec_id", "score"]
        if not len(mine) or not len(asked):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        mine, asked = mine.sort_by([("block", "ascending"), ("row", "ascending")]), asked.sort_by("row")
        width = max(pa.compute.max(pa.compute.list_value_length(t["q"])).as_py() for t in (mine, asked))
        own, ids = asked["row"].to_numpy(), asked["vec_id"].to_numpy()
        query, found, score = best_of_shard(
            _matrix(asked["q"], width), own, _matrix(mine["q"], width), mine["row"].to_numpy(), mine["vec_id"].to_numpy(), k, BLOCK
        )
        return pa.table(dict(zip(names, (own[query], ids[query], found, score))))

    answers = left.groupBy("shard", "tile").cogroup(right.groupBy("shard", "tile")).applyInArrow(
        answer, "own long, query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
