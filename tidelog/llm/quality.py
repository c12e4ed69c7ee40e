"""A quality score from statistics of the text: random Fourier features, ridge, isotonic calibration.

A document becomes a short vector of statistics (shares of kinds of characters, lengths of
words and lines, repetition).  Random cosines of it approximate a Gaussian kernel; the ridge
weights solve normal equations that are summed per partition, then per row of the matrix.
What reaches the driver has a size fixed by the parameters: those sums, the moments of the
statistics, and a histogram of scores.  A third of the labelled documents is kept from the
fit and calibrates: pooled neighbours make the share of good documents rise with the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import RangeHash, slices, utf8
from .steps import text_key, unused, written
from .words import ranges

#: Random features.
FEATURES = 200

#: Width of the Gaussian kernel, in standard deviations of one statistic.
WIDTH = 5.0

#: Weight of the ridge penalty per learned row.
RIDGE = 1e-4

#: Bins of the calibration histogram; raw scores run from -0.5 to 1.5.
BINS = 1000

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "wide": range(128, 256), "space": (32, 9),
    "line": (10,), "stop": (33, 46, 63), "comma": (44, 58, 59), "quote": (34, 39, 40, 41, 45, 91, 93),
    "shout": (33,), "bar": (124,), "markup": (60, 62, 61, 123, 125, 95, 47, 92, 64, 126, 96, 94, 43),
    "sign": (35, 36, 37, 38, 42),
}
_OWN_WORDS = bytes([*range(33), 127])
STATISTICS = len(_CLASSES) + 12


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive `counts` values."""
    sums = np.r_[0, np.cumsum(values, dtype=np.float64)]
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct hashes each text has, and how often its most frequent one occurs."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    runs = np.diff(np.r_[at, len(h)])
    most = np.zeros(len(counts))
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=len(counts)), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text of a slice."""
    n = np.diff(offsets)
    size = np.maximum(n, 1)
    out = []
    for members in _CLASSES.values():
        lut = np.zeros(256, np.uint8)
        lut[list(members)] = 1
        share = _per_text(lut[data], n) / size
        out.append(np.sqrt(share))
    table = np.arange(256, dtype=np.uint8)
    table[list(_OWN_WORDS)] = 0
    starts, ends, words = ranges(table[data], offsets)
    hashes = RangeHash(data)
    lengths, many = ends - starts, np.maximum(words, 1)
    mean = _per_text(lengths, words) / many
    spread = np.sqrt(np.maximum(_per_text(lengths.astype(np.float64) ** 2, words) / many - mean**2, 0))
    kinds, most = _distinct(hashes(starts, ends), words)
    first = data[starts] if len(starts) else data[:0]
    last = data[ends - 1] if len(ends) else data[:0]
    word_break = np.zeros(256, bool)
    word_break[[33, 35, 36, 37, 38, 42, 46, 63, 124]] = True
    capital = _per_text((first >= 65) & (first <= 90), words) / many
    odd_end = _per_text(word_break[last], words) / many
    table = np.ones(256, np.uint8)
    table[10] = 0
    from_, to, rows = ranges(table[data], offsets)
    some = np.maximum(rows, 1)
    line_kinds, line_most = _distinct(hashes(from_, to), rows)
    return np.column_stack(
        [
            *out, np.log1p(n), np.log1p(words), np.minimum(mean, 30), np.minimum(spread, 30), kinds / many, most / many,
            capital, odd_end, np.log1p(rows), np.log1p(words / some), line_kinds / some, line_most / some,
        ]
    )


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id`, `text_key` and the `statistics` of every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(2))
            rows = [statistics(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at)]
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
            cuts = pa.array(np.arange(batch.num_rows + 1) * STATISTICS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(flat.astype(np.float32)))],
                ["doc_id", "text_key", "statistics"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_key(text).alias("text_key"), F.col(text))
    return rows.mapInArrow(run, "doc_id long, text_key long, statistics array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    centers: np.ndarray
    levels: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([z, np.ones(len(rows))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.centers, self.levels)


def _summed(rows: DataFrame, sums, width: int) -> np.ndarray:
    """The sum over all batches of the matrix `sums(batch)`, added row by row in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) if batch.num_rows else ()):
                total[i] = total[i] + row if i in total else row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"]
        )

    schema = "i long, row array<double>"
    parts = rows.mapInArrow(partial, schema).repartition("i").mapInArrow(added, schema).collect()
    return np.array([r["row"] for r in sorted(parts)]).reshape(len(parts), width)


def pooled(good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising levels closest to `good / weight`, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for g, w in zip(good, weight):
        blocks.append([g, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + w, blocks[-1][2] + k]
    return np.concatenate([np.full(k, g / w) for g, w, k in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, calibrate: Column, features: int = FEATURES, seed: int = 7) -> Model | None:
    """A model from (`statistics`, `label`); rows where `calibrate` holds calibrate only.

    None if there is nothing to fit.
    """
    k = STATISTICS
    learn = rows.where(~calibrate).select("statistics", "label")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.stack([x.sum(0), (x**2).sum(0), np.full(k, float(len(x)))])

    sums = _summed(learn, moments, k)
    if not len(sums):
        return None
    count = sums[2, 0]
    mean = sums[0] / count
    scale = np.sqrt(np.maximum(sums[1] / count - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(
        mean, np.where(scale > 1e-6, scale, 1.0), rng.normal(size=(k, features)) / WIDTH, rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(batch.column(0)))
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.column_stack([z.T @ z, z.T @ y])

    both = _summed(learn, equations, features + 2)
    left = both[:, :-1] + RIDGE * count * np.diag([*np.ones(features), 0.0])
    model.weights = np.linalg.solve(left + 1e-9 * np.eye(len(left)), both[:, -1])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(batch.column(0))) + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        return np.column_stack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    held = _summed(rows.where(calibrate).select("statistics", "label"), binned, 2)
    if len(held):
        used = np.flatnonzero(held[:, 1])
        levels = pooled(held[used, 0], held[used, 1])
        # Between the middles of its blocks a score rises evenly, so equal levels don't tie.
        centers = (used + 0.5) * (2 / BINS) - 0.5
        edges = np.flatnonzero(np.r_[True, np.diff(levels) != 0])
        middle = np.add.reduceat(centers * held[used, 1], edges) / np.add.reduceat(held[used, 1], edges)
        model.centers, model.levels = middle, levels[edges]
    return model


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """`doc_id`, `text_key`, `score` from 0 to 1; 1 for all without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(2)) if batch.num_rows else np.zeros((0, STATISTICS))
            score = np.ones(len(rows)) if model is None else np.clip(model.score(rows), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "text_key", "score"])

    return stats.mapInArrow(run, "doc_id long, text_key long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.7, text: str = "text") -> DataFrame:
    """`doc_id`, `text_key`, `held_out`, `score`, `predicted` of every row.

    Learns from `labels` (`doc_id`, `quality` 0 or 1), where the crc32 of the id as text leaves
    0 or 1 when divided by 4 (fit) or 3 (calibration); 2 is held out.  Labels that are null or
    neither 0 nor 1, and those of no document, are ignored; several labels of a document all
    count.  Only the text enters a score: rows with equal texts have equal scores, a null or empty
    text has one as well.  Without any label to learn from, all scores are 1.
    """
    stats = written(described(docs, text))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label")
    )
    learned = written(stats.join(known.where(fold != 2), "doc_id").select("statistics", "label", (fold == 3).alias("_calibrate")))
    model = fit(learned, F.col("_calibrate"))
    out = scored(stats, model)
    return out.select(
        "doc_id", "text_key", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, cut: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text is predicted good."""
    [own] = unused(docs, "_own")
    rejected = classify(docs, labels, cut, text).where("predicted = 0").select(F.col("text_key").alias(own)).distinct()
    return docs.withColumn(own, text_key(text)).join(rejected, own, "left_anti").select(*docs.columns)
