"""Hard negatives: exact integer scores by a residue number system, then windowed selection.

Integer vectors are taken modulo several small primes.  Residues are centred, so a product of
two matrices of them stays below 2**24 in each chunk of components and float32 holds it
exactly; it is reduced modulo its prime, and Chinese remaindering (mixed radix) puts the
residues of all primes together to the signed inner product.  There are as many primes as
the largest possible score needs.

Shards of rows meet tiles of anchors, once for the positives (only rows with the anchor's
label are multiplied) and once for the negatives, whose bounds the positives set.  A cell
returns a fixed number of rows per anchor and positive; windows rank those of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

#: Rows of a shard (fewer, if there are more shuffle partitions than shards, but not under
#: `SMALL`) and anchors of a tile; `CELLS` scores are looked at together.  They only split the work.
SHARD, SMALL, TILE, CELLS = 16384, 1024, 2048, 1 << 21

#: The primes below 256, largest first.
PRIMES = [p for p in range(255, 2, -2) if all(p % q for q in range(3, 16, 2))]

#: A score is below this, so that 20 times a score is a long.
LIMIT = 1 << 58

_LEAST = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """Primes whose product exceeds twice `bound`, so that they tell all scores from -bound to bound apart."""
    out, product = [], 1
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 2 * bound:
            return out
    raise ValueError("scores do not fit")


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    """`values` modulo `p`, from -(p - 1) / 2 to (p - 1) / 2, as float32."""
    out = values % p
    return np.where(out > p // 2, out - p, out).astype(np.float32)


def _modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """The inner products of rows of `a` and `b` modulo `p`, from 0."""
    width = (1 << 24) // (p // 2) ** 2
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], width):
        total += (_centred(a[:, k : k + width], p) @ _centred(b[:, k : k + width], p).T).astype(np.int64)
    return total % p


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = [max(int(x.max()), -int(x.min())) for x in (a, b)]
    bound = largest[0] * largest[1] * a.shape[1]
    if bound >= LIMIT:
        raise ValueError("scores do not fit into a long")
    primes = primes_for(bound)
    score, weight, digits = np.zeros((len(a), len(b)), np.int64), 1, []
    for i, p in enumerate(primes):
        # The next mixed-radix digit: what is left of the residue, divided by the primes before.
        digit = _modulo(a, b, p)
        for q, d in zip(primes[:i], digits):
            digit = (digit - d) * pow(q, -1, p) % p
        digits.append(digit)
        if i + 1 < len(primes):
            score += digit * weight
            weight *= p
        else:
            # The last digit's upper half stands for negative scores.
            low, half = score, (weight * p - 1) // 2
            top = digit > half // weight
            edge = (digit == half // weight) & (low > half % weight)
            score = low + np.where(top | edge, digit - p, digit) * weight
    return score


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `k` largest allowed scores of each row; of equal ones the first columns."""
    left = np.where(allowed, scores, _LEAST)
    rows, columns, line = [], [], np.arange(len(left))
    for _ in range(min(k, left.shape[1])):
        at = left.argmax(1)
        on = left[line, at] != _LEAST
        rows.append(line[on])
        columns.append(at[on])
        left[line, at] = _LEAST
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64),) * 2


def quantized(vectors: DataFrame, scale: int, vector: str, label: Column) -> DataFrame:
    """Written (`row`, `vec_id`, `label`, `q`): the components as `floor(scale * x)`, rows numbered."""
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    rows = vectors.select(F.col("vec_id").cast("long"), label.cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    q = F.transform("v", lambda x: F.floor(scale * x))
    return written(rows.where(usable).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", q.alias("q")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _both(rows: pa.Table, anchors: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    rows, anchors = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")]), anchors.sort_by("row")
    width = max(pa.compute.max(pa.compute.list_value_length(t["q"])).as_py() for t in (rows, anchors))
    return rows, anchors, _matrix(rows["q"], width), _matrix(anchors["q"], width)


def _answer(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def _cells(rows: DataFrame, anchors: DataFrame, extra: list[str], shards: int, tiles: int):
    """Every shard of rows with every tile of anchors."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    columns = ["row", "vec_id", "label", "q"]
    left = rows.select(dealt(shards).alias("shard"), each(tiles).alias("tile"), *columns)
    right = anchors.select(each(shards).alias("shard"), dealt(tiles).alias("tile"), *columns, *extra)
    return left.groupBy("shard", "tile").cogroup(right.groupBy("shard", "tile"))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2),
    high: tuple[int, int] = (19, 20), scale: int = 256, vector: str = "embedding", label: Column | None = None,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank` from 1, `negative_id`, `positive_score`, `negative_score`.

    `is_anchor` is a condition on `vec_id`.  An anchor's positives are the `positives` best other
    rows of its label; a positive's negatives are the `negatives` best rows of other labels whose
    score is at least `low` and at most `high` (numerator, denominator) of the positive's.  Higher
    scores come first, ties go to the smaller `vec_id`.  `label` replaces the column `label`.

    Rows whose id, label or vector is null, or that have a null or non-finite component, take no
    part.  A repeated row is another row: it can be a positive of its copy, and repeated anchors
    each have their answers.  Vectors of different lengths are compared as if the shorter ended
    in zeros.  Without anchors, positives or negatives there are no answers.  Further columns are
    ignored.  Components so large that a score could reach 2**58 raise an error.
    """
    rows = quantized(vectors, scale, vector, F.col("label") if label is None else label)
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n_rows // SHARD), min(partitions, -(-n_rows // SMALL)))
    tiles = max(1, -(-n_anchors // TILE))

    def same_label(mine: pa.Table, asked: pa.Table) -> pa.Table:
        names, found = ["anchor", "row", "positive_id", "score"], []
        if not len(mine) or not len(asked):
            return _answer([], names)
        mine, asked, matrix, queries = _both(mine, asked)
        label, own_label = mine["label"].to_numpy(), asked["label"].to_numpy()
        row, own, ids = mine["row"].to_numpy(), asked["row"].to_numpy(), mine["vec_id"].to_numpy()
        for value in np.unique(own_label):
            there, here = np.flatnonzero(label == value), np.flatnonzero(own_label == value)
            for part in _blocks(len(here), len(there)):
                s = products(queries[here[part]], matrix[there])
                q, at = _best(s, row[there][None, :] != own[here[part]][:, None], positives)
                found.append((own[here[part]][q], row[there][at], ids[there][at], s[q, at]))
        return _answer(found, names)

    best = _cells(rows, anchors, [], shards, tiles).applyInArrow(same_label, "anchor long, row long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "row"))
    best = best.withColumn("place", place).where(F.col("place") <= positives)
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("found"))
    asked = written(anchors.join(lists, anchors["row"] == lists["anchor"]).select(
        "row", "vec_id", "label", "q", F.col("found.positive_id").alias("positive_id"), F.col("found.score").alias("score")
    ))

    def other_label(mine: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score", "negative"]
        found = []
        if not len(mine) or not len(asked):
            return _answer([], names)
        mine, asked, matrix, queries = _both(mine, asked)
        label, own_label, row, ids = (mine["label"].to_numpy(), asked["label"].to_numpy(), mine["row"].to_numpy(), mine["vec_id"].to_numpy())
        own, own_ids = asked["row"].to_numpy(), asked["vec_id"].to_numpy()
        positive, bound = (asked[c].to_pylist() for c in ("positive_id", "score"))
        for part in _blocks(len(asked), len(mine)):
            s = products(queries[part], matrix)
            other = label[None, :] != own_label[part][:, None]
            at_least, at_most = s * low[1], s * high[1]
            for k in range(positives):
                line = np.flatnonzero([len(b) > k for b in bound[part]])
                if not len(line):
                    break
                p = np.array([bound[part][i][k] for i in line], np.int64)
                to = np.array([positive[part][i][k] for i in line], np.int64)
                allowed = other[line] & (at_least[line] >= low[0] * p[:, None]) & (at_most[line] <= high[0] * p[:, None])
                q, at = _best(s[line], allowed, negatives)
                found.append((
                    own[part][line][q], own_ids[part][line][q], np.full(len(q), k), to[q], p[q], ids[at], s[line][q, at], row[at],
                ))
        return _answer(found, names)

    out = _cells(rows, asked, ["positive_id", "score"], shards, tiles).applyInArrow(
        other_label,
        "anchor long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long, negative long",
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "negative")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
