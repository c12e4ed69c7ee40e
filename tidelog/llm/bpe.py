"""Byte-level BPE in NumPy: all distinct pieces of a batch of texts are merged together.

Texts are cut into pieces by byte classes where those decide, by the pattern elsewhere, and
ids of pieces are remembered.  Pieces of similar length are the rows of a padded matrix of token ids.  In each round every
row merges its leftmost pair of least rank: ranks of neighbours come from an open-addressing
table of id pairs, the merged row closes up by one, and rows without a pair leave the matrix.
A batch's matrices are small; a piece of more than `LONG` bytes would need as many rounds as
it has bytes, so it is merged alone, with the same order of merges, from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import SLICE_BYTES, RangeHash, binary, slices, utf8

#: Pieces over so many bytes are merged one by one.
LONG = 1024

#: Pieces whose ids a task remembers; beyond that it forgets them all.
REMEMBERED = 3 << 18

#: Cells of a matrix.
_CELLS = 1 << 20

# Classes of bytes in words that are cut without the pattern.
_LETTER, _DIGIT, _SYMBOL, _BLANK, _OTHER_SCRIPT = range(1, 6)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[[39, *range(128, 256)]] = _OTHER_SCRIPT

_NONE = np.int32(np.iinfo(np.int32).max)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

# Rust's \s is White_Space, which lacks the four separators U+001C to U+001F.
_SPACE = r"[\p{White_Space}]"
_NOT_SPACE = r"[^\p{White_Space}]"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def compiled(pattern: str) -> regex.Pattern:
    """`pattern` with white space as the rank files' splitter has it."""
    inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    return regex.compile(inside.replace(r"\s", _SPACE).replace(r"\S", _NOT_SPACE))


class Codec:
    """Ids of texts and texts of ids, for tokens given by rank."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self._split = compiled(pattern).findall
        self._rank = {t: i for i, t in enumerate(tokens)}
        self._single = np.array([self._rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self._single < 0).any():
            raise ValueError("every byte must be a token")
        pairs = {}
        for rank, token in enumerate(tokens):
            for cut in range(1, len(token)):
                a, b = self._rank.get(token[:cut]), self._rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self._bits = max(4, (2 * len(pairs)).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._values = np.full(1 << self._bits, _NONE, np.int32)
        self._fill(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        self._lengths = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._known: dict[bytes, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] == -1
            self._keys[slot[free]] = keys[free]  # of several for one slot, the last stays
            placed = self._keys[slot] == keys
            self._values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self._bits) - 1)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or `_NONE`; negative ids have no pair."""
        shape, left, right = left.shape, left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        out = np.full(len(left), _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo] << 32 | right[todo]
        slot = self._slot(keys)
        while len(todo):
            there = self._keys[slot]
            hit = there == keys
            out[todo[hit]] = self._values[slot[hit]]
            on = ~hit & (there != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self._bits) - 1)
        return out.reshape(shape)

    def _merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, as little-endian 32-bit integers."""
        width = max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self._single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        out, row = [b""] * len(pieces), np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), _NONE)
            done = best == _NONE
            if done.any():
                raw, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (i, n) in enumerate(zip(row[done].tolist(), sizes[done].tolist())):
                    out[i] = raw[k * step : k * step + 4 * n]
            on = ~done
            ids, ranks, row, sizes, at, best = ids[on], ranks[on], row[on], sizes[on] - 1, at[on], best[on]
            if not len(row):
                break
            n, lines = ids.shape[1], np.arange(len(row))
            ids[lines, at] = best
            # Close up: what stands behind the pair moves one to the left.
            take = np.arange(n - 1)
            ids = np.take_along_axis(ids, take + (take > at[:, None]), 1)
            take = np.arange(n - 2)
            ranks = np.take_along_axis(ranks, take + (take >= at[:, None]), 1)
            right = at < n - 2
            if right.any():
                i, j = lines[right], at[right]
                ranks[i, j] = self._pair_ranks(ids[i, j], ids[i, j + 1])
            left = at > 0
            if left.any():
                i, j = lines[left], at[left] - 1
                ranks[i, j] = self._pair_ranks(ids[i, j], ids[i, j + 1])
            if (width := int(sizes.max())) < ids.shape[1]:
                ids, ranks = ids[:, :width], ranks[:, : max(0, width - 1)]
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        rank, n = self._rank, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or end[middle] != stop:
                continue
            alive[middle], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := rank.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := rank.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        ids, i = [], 0
        while i < n:
            ids.append(rank[piece[i : end[i]]])
            i = end[i]
        return np.array(ids, "<u4").tobytes()

    def _learn(self, pieces: list[bytes]) -> None:
        known, rank = self._known, self._rank
        buckets: dict[int, list[bytes]] = {}
        for piece in pieces:
            if (whole := rank.get(piece)) is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                known[piece] = self._merge_long(piece)
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for power, bucket in buckets.items():
            rows = max(1, _CELLS >> power)
            for i in range(0, len(bucket), rows):
                part = bucket[i : i + rows]
                known.update(zip(part, self._merge_rows(part)))

    def _ids_of(self, units: list[bytes], mixed: list[bool]) -> list[bytes]:
        """The ids of distinct units; `mixed` ones hold several pieces."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        split = {u: [p.encode() for p in self._split(u.decode())] for u, m in zip(units, mixed) if m and u not in known}
        new = {u for u, m in zip(units, mixed) if not m and u not in known}
        self._learn(list(new.union(p for s in split.values() for p in s if p not in known)))
        known.update({u: b"".join(map(known.__getitem__, s)) for u, s in split.items()})
        return list(map(known.__getitem__, units))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids begin."""
        starts, mixed = _units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.r_[starts[1:], len(data)]
        hashes = RangeHash(data)(starts, ends)
        order = np.argsort(hashes)
        new = np.r_[True, np.diff(hashes[order]) != 0]
        unit, first = np.empty(len(order), np.int64), order[new]
        unit[order] = np.cumsum(new) - 1
        sizes, raw = ends - starts, data.tobytes()
        # Two units of one hash: the bytes tell.
        rep = first[unit]
        odd = sizes != sizes[rep]
        if not odd.any():
            same = data[np.repeat(starts[rep] - starts, sizes) + np.arange(len(data))] == data
            odd = ~np.logical_and.reduceat(same, starts)
        if odd.any():
            unit[odd] = len(first) + np.arange(odd.sum())
            first = np.r_[first, np.flatnonzero(odd)]
        found = self._ids_of([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], mixed[first].tolist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = _gathered(np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths, lengths, unit)
        reached = np.r_[0, np.cumsum(lengths[unit])]
        return ids, reached[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts one after the other, and where each text begins."""
        reached = np.r_[0, np.cumsum(self._lengths[ids])]
        return _gathered(self._bytes, self._starts, self._lengths, ids), reached[offsets]


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs `which` of `values`, one after the other."""
    n = lengths[which]
    return values[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin, and which units may hold several pieces.

    A text is cut before every space that stands alone between two other characters.  Only
    white space follows white space in a piece, and a piece holds a space nowhere else but in
    front, so each such cut is one between pieces, and what stands between cuts splits alike
    wherever it occurs.  Next to characters that may be wide white space, nothing is cut.

    Words of ASCII and of the letters from U+00C0 to U+00FF are cut further, into pieces: runs of
    letters, of digits, of other characters, single white space.  Words with an apostrophe,
    with white space in a row or with other characters are left to the pattern.
    """
    inner = _CLASS[data].copy()
    two_byte = np.flatnonzero(data[:-1] == 0xC3)
    two_byte = two_byte[(data[two_byte + 1] != 0x97) & (data[two_byte + 1] != 0xB7)]
    inner[two_byte] = inner[two_byte + 1] = _LETTER
    blank = inner == _BLANK
    space = np.flatnonzero(data == 32)
    space = space[(space > 0) & (space < len(data) - 1)]
    before, after = data[space - 1], data[space + 1]
    wide = (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    two, three = data[np.maximum(space - 2, 0)], data[np.maximum(space - 3, 0)]
    wide |= (before >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
    cuts = space[~blank[space - 1] & ~blank[space + 1] & ~wide]
    is_word = np.zeros(len(data) + 1, bool)
    is_word[cuts] = is_word[offsets] = True
    words = np.flatnonzero(is_word[:-1])
    if not len(words):
        return words, np.zeros(0, bool)
    # White space that is neither alone nor a word's leading space makes a word mixed.
    run = blank.copy()
    run[1:] &= blank[:-1] & ~is_word[1:-1]
    run[0] = False
    hard = (inner == _OTHER_SCRIPT) | run | ((data == 32) & ~is_word[:-1])
    mixed = np.logical_or.reduceat(hard, words)
    lead = words[(data[words] == 32) & ~is_word[words + 1]]
    inner[lead] = inner[lead + 1]
    change = inner[1:] != inner[:-1]
    change &= ~np.repeat(mixed, np.diff(np.r_[words, len(data)]))[1:]
    cut = is_word[:-1].copy()
    cut[1:] |= change
    return np.flatnonzero(cut), np.repeat(mixed, np.add.reduceat(cut, words, dtype=np.int64))


_codecs: dict[tuple, Codec] = {}


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`doc_id`, `ids` (little-endian unsigned 32-bit integers) and `decoded` bytes of every text.

    `path` is a rank file, read by the driver and sent to the tasks (its size is that of the
    vocabulary); `pattern` splits a text into pieces.  A null text is empty and has no ids.
    Rows are independent of each other, so repeated rows and ties need no rule.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern)
        if key not in _codecs:
            _codecs[key] = Codec(tokens.value, pattern)
        codec = _codecs[key]
        for batch in batches:
            at, data = utf8(batch.column(1))
            for i, j in slices(at, 4 * SLICE_BYTES):
                ids, cuts = codec.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                decoded, ends = codec.decode(ids, cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), binary(ids.astype("<u4"), 4 * cuts), binary(decoded, ends)],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, ids binary, decoded binary")
