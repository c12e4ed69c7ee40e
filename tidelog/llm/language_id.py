"""Language of a text by unigrams of pieces, summed over all segmentations.

A word can be cut into pieces of a fixed vocabulary in many ways.  Each language has a
probability per piece, and a word's probability is the sum over all segmentations of the
products of their pieces' probabilities: the forward algorithm.  The probabilities are
learned by expectation maximisation over the languages' distinct words: forward and backward
sums give each piece's expected count, which Spark adds up.

Words are lower-cased (A-Z), begin with a space, as the vocabulary's pieces do, and are cut
at ASCII characters that are no letters.  All single bytes are pieces, so every word has a
segmentation.  Expected counts are added as whole numbers of 2**-20: their sum does not
depend on the order of rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .buffers import RangeHash, binary, slices, utf8
from .steps import unused, written

#: Bytes of the longest piece that takes part.
LONGEST = 12

#: A longer run of letters is scored in parts of at most so many bytes, cut between code points.
PART = 48

#: Rounds of expectation maximisation.
ROUNDS = 3

#: Added to every piece's expected count.
SMOOTHING = 0.05

#: Bytes of text, and bytes of distinct words, that are looked at together.
TEXT_BYTES, WORD_BYTES = 1 << 22, 1 << 18

UNKNOWN = "und"

_SEPARATORS = words.table(bytes([*range(65), *range(91, 97), *range(123, 128)]))
_FILTER_BITS = 22
_UNIT = 1 << 20


@dataclass
class Pieces:
    """The usable pieces, by the hash of their bytes."""

    hashes: np.ndarray  # sorted
    held: np.ndarray  # by the upper bits of a hash: whether there may be such a piece

    @staticmethod
    def read(path: str) -> "Pieces":
        """From a vocabulary of lines of a piece in base 64 and its rank."""
        with open(path, "rb") as lines:
            raw = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
        word = lambda b: b and not (_SEPARATORS[np.frombuffer(b, np.uint8)] != np.frombuffer(b, np.uint8)).any()
        usable = {b for b in raw if len(b) <= LONGEST and (b == b" " or word(b.removeprefix(b" ")))}
        usable |= {bytes([b]) for b in range(256)}
        data = np.frombuffer(b"".join(sorted(usable)), np.uint8)
        ends = np.cumsum([len(b) for b in sorted(usable)])
        hashes = np.unique(RangeHash(data)(np.r_[0, ends[:-1]], ends))
        held = np.zeros(1 << _FILTER_BITS, bool)
        held[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return Pieces(hashes, held)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        on = np.flatnonzero(self.held[h >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.hashes, h[on]), len(self.hashes) - 1)
        right = self.hashes[at] == h[on]
        out[on[right]] = at[right]
        return out


def _parts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, start, end) of the parts of byte ranges; only ranges over `PART` bytes have several."""
    index = np.arange(len(start))
    long = end - start > PART
    if not long.any():
        return index, start, end
    out = [(index[~long], start[~long], end[~long])]
    first = (data & 0xC0) != 0x80
    for i in np.flatnonzero(long):
        points = start[i] + np.flatnonzero(first[start[i] : end[i]])
        cuts, at = [start[i]], start[i]
        while end[i] - at > PART:
            at = points[np.searchsorted(points, at + PART, "right") - 1]
            cuts.append(at)
        cuts.append(end[i])
        out.append((np.full(len(cuts) - 1, i), np.array(cuts[:-1]), np.array(cuts[1:])))
    i, s, e = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((s, i))
    return i[order], s[order], e[order]


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end, hash, bytes) of the words of texts; the bytes are lower-cased."""
    lowered = _SEPARATORS[data]
    start, end, count = words.ranges(lowered, offsets)
    text = np.repeat(np.arange(len(count)), count)
    i, start, end = _parts(data, start, end)
    return text[i], start, end, RangeHash(lowered)(start, end), lowered


def _spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of byte ranges, each behind a space."""
    size = end - start + 1
    at = np.r_[0, np.cumsum(size)]
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    source = np.repeat(start, size) + place - 1
    return np.where(place == 0, 32, data[np.maximum(source, 0)]).astype(np.uint8), at


class _Lattice:
    """All pieces at all places of words of similar length, longest word first."""

    def __init__(self, pieces: Pieces, data: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.start = at[:-1][self.order]
        ranks = RangeHash(data)
        #: (end, length, words, pieces), by end.
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for end in range(1, int(self.size.max(initial=0)) + 1):
            n = int(np.searchsorted(-self.size, -end, "right"))
            for length in range(1, min(end, LONGEST) + 1):
                base = self.start[:n] + end
                piece = pieces.find(ranks(base - length, base))
                on = np.flatnonzero(piece >= 0)
                if len(on):
                    self.edges.append((end, length, on, piece[on]))

    def forward(self, logs: np.ndarray, language: np.ndarray | None = None) -> np.ndarray:
        """Log sums over the segmentations of each prefix: (place, word, language) or (place, word)."""
        width = int(self.size.max(initial=0)) + 1
        shape = (width, len(self.size)) if language is not None else (width, len(self.size), logs.shape[1])
        out = np.full(shape, -np.inf)
        out[0] = 0.0
        for end, length, on, piece in self.edges:
            p = logs[piece] if language is None else logs[piece, language[on]]
            out[end][on] = np.logaddexp(out[end][on], out[end - length][on] + p)
        return out

    def totals(self, logs: np.ndarray) -> np.ndarray:
        """The log probability of each word in each language, in the words' own order."""
        out = np.zeros((len(self.size), logs.shape[1]))
        if len(self.size):
            out[self.order] = self.forward(logs)[self.size, np.arange(len(self.size))]
        return out

    def expected(self, logs: np.ndarray, language: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, piece, expected count of `_UNIT`ths) of words that occur `n` times."""
        language, n = language[self.order], n[self.order]
        before = self.forward(logs, language)
        line = np.arange(len(self.size))
        whole = before[self.size, line]
        after = np.full(before.shape, -np.inf)
        after[self.size, line] = 0.0
        sums = np.zeros(logs.shape)
        for end, length, on, piece in reversed(self.edges):
            behind = after[end][on] + logs[piece, language[on]]
            share = np.exp(before[end - length][on] + behind - whole[on])
            np.add.at(sums, (piece, language[on]), np.rint(share * n[on] * _UNIT))
            after[end - length][on] = np.logaddexp(after[end - length][on], behind)
        piece, to = np.nonzero(sums)
        return to, piece, sums[piece, to].astype(np.int64)


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Written (`lang`, `word`, `n`): how often each word occurs in texts of each language."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            at, data = utf8(batch.column(1))
            for i, j in slices(at, TEXT_BYTES):
                part, start, end, h, lowered = text_words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                own = code[i:j][part]
                order = np.lexsort((h, own))
                new = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])][: len(h)])
                one, n = order[new], np.diff(np.r_[new, len(h)])
                size = end[one] - start[one]
                cuts = np.r_[0, np.cumsum(size)]
                source = np.repeat(start[one] - cuts[:-1], size) + np.arange(cuts[-1])
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(own[one])), binary(lowered[source], cuts), pa.array(n)], ["lang", "word", "n"]
                )

    return written(rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (piece, language)


def train(docs: DataFrame, pieces: Pieces, lang: str = "lang", text: str = "text", rounds: int = ROUNDS) -> Model:
    """The probabilities of `pieces` in each language of `docs`.

    What reaches the driver is the model: a row per language and piece.
    """
    counts = word_counts(docs, lang, text)
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    code = {x: i for i, x in enumerate(languages)}
    size = len(pieces.hashes)
    logs = np.full((size, len(languages)), -np.log(size))
    context = docs.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        shared = context.broadcast((pieces, logs, code))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, logs, code = shared.value
            for batch in batches:
                language = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
                at, data = utf8(batch.column(1))
                n = batch.column(2).to_numpy()
                for i, j in slices(at, WORD_BYTES):
                    lattice = _Lattice(pieces, *_spaced(data, at[i:j], at[i + 1 : j + 1]))
                    found = lattice.expected(logs, language[i:j], n[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["lang", "piece", "n"])

        sums = counts.mapInArrow(run, "lang long, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        logs = np.full((size, len(languages)), SMOOTHING)
        logs[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy() / _UNIT
        logs = np.log(logs) - np.log(logs.sum(0))
        shared.unpersist()
    return Model(languages, logs)


def predict(docs: DataFrame, model: Model, pieces: Pieces, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, the predicted language and its probability among the learned ones.

    Null texts, texts without a letter, and all texts if no language was learned, are `und` with
    the score 0.  The languages are taken as equally frequent; ties go to the first by name.
    Columns of `docs` keep their names: added ones get further underscores where they clash.
    """
    names = unused(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((pieces, model.logs))
    languages = [*model.languages, UNKNOWN]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    source, letter = unused(docs, "_text", "_letter")
    rows = docs.withColumns({
        source: F.col(text).cast("string"), letter: F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)),
    })
    columns = docs.columns
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs = shared.value
        for batch in batches:
            at, data = utf8(batch.column(width))
            letter = batch.column(width + 1).to_numpy(zero_copy_only=False)
            total = np.zeros((batch.num_rows, logs.shape[1]))
            for i, j in slices(at, TEXT_BYTES):
                part, start, end, h, lowered = text_words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                _, one, which = np.unique(h, return_index=True, return_inverse=True)
                by_size = np.argsort(end[one] - start[one], kind="stable")
                first, last = start[one][by_size], end[one][by_size]
                scores = np.zeros((len(one), logs.shape[1]))
                for a, b in slices(np.r_[0, np.cumsum(last - first)], max(PART, 4 * WORD_BYTES // max(4, logs.shape[1]))):
                    scores[by_size[a:b]] = _Lattice(pieces, *_spaced(lowered, first[a:b], last[a:b])).totals(logs)
                for k in range(logs.shape[1]):
                    total[i:j, k] = np.bincount(part, scores[which, k], j - i)
            if logs.shape[1]:
                best = total.argmax(1)
                share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            else:
                best, share = np.zeros(len(total), np.int64), np.zeros(len(total))
                letter = np.zeros(len(total), bool)
            best, share = np.where(letter, best, len(languages) - 1), np.where(letter, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(languages, pa.string()).take(pa.array(best)), pa.array(share)], [*columns, *names]
            )

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, learn: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """`predict` for `docs` by a model of `learn`, whose rows with a null language or text teach nothing.

    `vocabulary` is the path of a public vocabulary; it is read on the driver.  Empty tables of
    either kind give an empty result or no language.
    """
    pieces = Pieces.read(vocabulary)
    model = train(learn.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), pieces, lang, text)
    return predict(docs, model, pieces, text)
