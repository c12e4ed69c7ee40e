"""Spelling variants: words one edit apart, found through a reduced alphabet.

Every letter becomes one of a few symbols, so that a word's whole one-edit neighbourhood over
the symbols is short.  If two words are one edit apart, so are their reduced words, or those
are equal.  A word's neighbours are hashed (each in constant time from sums over the word) and
joined with the reduced vocabulary; what meets is verified on the original strings.

A pair of words is met from one side only: words of different length from the longer, whose
deletions are the shorter one's insertions, the others from the smaller hash.  A bit table of
fixed size, broadcast, holds the reduced vocabulary: neighbours that no word has are not
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import mixed
from .steps import written

#: Symbols of the reduced alphabet.
SYMBOLS = 8

#: Bits of the table of reduced words, whatever the vocabulary; it only sorts out what cannot match.
TABLE_BITS = 26

#: How a neighbour came about.
SAME, REPLACED, SHORTER = range(3)

#: Letters whose neighbours are looked at together.
LETTERS = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20250301).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """`word` with A-Z in lower case, and nothing else changed."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def vocabulary(docs: DataFrame, least: int, times: int, every: int | None, text: str) -> DataFrame:
    """(`word`, `n`): maximal runs of letters in lower case, of `least` letters, that occur `times` times.

    With `every`, one in so many occurrences (by the checksum of id and run) has lost a letter.
    """
    # Shorter runs give no word: they could only become shorter.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}+"), F.lit(0))).alias("run"),
    ).select("id", lowered(F.col("run")).alias("word"))
    if every is not None:
        h, size = F.crc32(F.concat("id", F.lit(":"), "word")), F.length("word")
        at = (h % size).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size))
        runs = runs.select(F.when(h % every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _power(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of words of at most `LETTERS` letters together, or one word."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        before = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, before + LETTERS, "right")))
        yield i, j
        i = j


class _Reduced:
    """Reduced words and the hashes of their neighbours."""

    def __init__(self, words: list[str]):
        raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(w) for w in words], np.int64)
        # Neighbours in the alphabet have different symbols, as have most of the frequent letters.
        self.symbol = raw % np.uint32(SYMBOLS)
        self.start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(raw)) - self.start[self.word]
        self.power = _power(_BASE, int(self.size.max(initial=0)))
        terms = _VALUES[self.symbol] * self.power[self.place]
        sums = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
        self.before = sums[:-1] - sums[self.start][self.word]
        self.total = sums[self.start + self.size] - sums[self.start]
        self.after = self.total[self.word] - self.before - terms

    @staticmethod
    def named(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of a reduced word from its sum and its length."""
        return mixed(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def own(self) -> np.ndarray:
        return self.named(self.total.copy(), self.size)

    def neighbours(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, word, hash): the word itself, every replacement, every deletion."""
        yield SAME, np.arange(len(self.size)), self.own()
        for step in range(1, SYMBOLS):
            other = (self.symbol + np.uint32(step)) % np.uint32(SYMBOLS)
            change = (_VALUES[other] - _VALUES[self.symbol]) * self.power[self.place]
            yield REPLACED, self.word, self.named(self.total[self.word] + change, self.size[self.word])
        shorter = self.before + self.after * np.uint64(_INVERSE)
        # Of equal symbols in a row, the last one is deleted.
        last = np.r_[(self.symbol[1:] != self.symbol[:-1]) | (self.word[1:] != self.word[:-1]), True][: len(self.word)]
        yield SHORTER, self.word[last], self.named(shorter[last], self.size[self.word[last]] - 1)


def _hashed(words: DataFrame) -> DataFrame:
    """`words` with the hash `h` of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sizes = batch.column(0).to_pylist(), pc.utf8_length(batch.column(0)).to_numpy()
            hashes = [_Reduced(own[i:j]).own() for i, j in _parts(sizes)]
            h = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], ["word", "n", "h"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, h long")


def _table(hashes: DataFrame) -> np.ndarray:
    """The bit table of all `h`: 2**TABLE_BITS bits as words of 64, at most so many rows collected."""
    bit = F.shiftright("h", 64 - TABLE_BITS).bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bits = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    rows = bits.toArrow()
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _met(words: DataFrame, table: Broadcast) -> DataFrame:
    """(`h`, `kind`, `a`, `a_n`): each word under the hashes of those neighbours that may be in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            own, sizes = batch.column(0).to_pylist(), pc.utf8_length(batch.column(0)).to_numpy()
            for i, j in _parts(sizes):
                reduced, found = _Reduced(own[i:j]), []
                self_hash = reduced.own().view(np.int64)
                for kind, word, h in reduced.neighbours():
                    at = h >> np.uint64(64 - TABLE_BITS)
                    held = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
                    if kind == REPLACED:
                        held &= h.view(np.int64) > self_hash[word]
                    found.append((np.full(int(held.sum()), kind, np.int32), word[held], h[held].view(np.int64)))
                kind, word, h = (np.concatenate(x) for x in zip(*found))
                # A hash stands once for a word and a kind, should two of its neighbours share one.
                order = np.lexsort((kind, h, word))
                kind, word, h = kind[order], word[order], h[order]
                new = np.r_[True, (word[1:] != word[:-1]) | (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])][: len(word)]
                rows = batch.slice(i, j - i).take(pa.array(word[new]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new]), pa.array(kind[new]), rows.column(0), rows.column(1)], ["h", "kind", "a", "a_n"]
                )

    return words.select("word", "n").mapInArrow(run, "h long, kind int, a string, a_n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(`a`, `a_n`, `b`, `b_n`): the pairs of written (`word`, `n`, `h`) that are one edit apart, each once."""
    table = words.sparkSession.sparkContext.broadcast(_table(words))
    known = words.select("h", F.col("word").alias("b"), F.col("n").alias("b_n"))
    more = F.length("a") - F.length("b")
    fits = F.when(F.col("kind") == SHORTER, more == 1).when(F.col("kind") == SAME, (more == 0) & (F.col("a") < F.col("b"))).otherwise(more == 0)
    return _met(words, table).join(known, "h").where(fits).where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def _roots(links: DataFrame) -> DataFrame:
    """(`word`, `root`) from written (`word`, `form`): forms followed to the last, twice as far in every round.

    A form occurs many times as often as its word, so that chains are short and never circles.
    """
    roots = links.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        on = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        roots = written(roots.join(on, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")
        ))
        if roots.where("open").isEmpty():
            return roots.select("word", "root")


def variants(
    docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, every: int | None = None, text: str = "text"
) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`, `root` of every word of the vocabulary.

    Words are the maximal runs of Latin letters, A-Z in lower case, of at least `least` code
    points that occur at least `times` times.  `n_near` counts the words one edit (a code point
    inserted, deleted or replaced) apart; `form` is the most frequent of them (ties: the smallest)
    if it occurs `ratio` times as often; `root` follows forms to the last.  `every` plants
    misspellings: an occurrence whose checksum (of `doc_id`, a colon and the run; a null id is
    empty) it divides loses one letter.  `ratio` must be over 1.

    Null texts have no words; repeated rows count as often as they occur.  Without words there
    are no rows.  Other columns are not looked at.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = written(_hashed(vocabulary(docs, least, times, every, text)))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("near_of"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")).alias("near")),
        F.struct(F.col("b").alias("near_of"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("word")).alias("near")),
    )).alias("x")).select("x.near_of", "x.near")
    best = both.groupBy("near_of").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = written(words.join(best, F.col("word") == F.col("near_of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"),
    ))
    roots = _roots(found.where("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "_word")
    return found.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
