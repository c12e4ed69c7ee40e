"""Removal of byte strings that repeat, by hashes of runs of positions (in place of prefix doubling).

A position's rank at a length is a name for the string of that length there; equal strings
have equal ranks.  Spark groups positions by rank at growing lengths, drops those whose rank
is unique, and ranks what is left at the next length, until `length` is reached:

1. `ANCHOR` bytes.  Of all strings of `length` bytes that begin close together, those that
   share their least anchor (the leftmost smallest hash among its windows) form a run.  Equal
   strings have equal anchors at equal distances, so a run whose anchor's rank is unique
   holds no repeat.  A run is one row; on average it stands for 50 positions.
2. All bytes of a run.  Runs equal throughout repeat throughout, and only one of each
   (the representative) has to be told apart from other runs with its anchor.
3. Representatives are cut into blocks of `BLOCK` positions.  The bytes that all strings of
   a block share are its rank now, and all its bytes decide as in 2.
4. What is left at the edges of repeats is ranked at full length, position by position.

Ranks are 64-bit hashes of the bytes, so no step has to read other rows to name a string.
Groups of a rank are counted before the shuffle, and no step gathers the members of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Steps
from .buffers import SLICE_BYTES, RangeHash, mixed, slices, utf8
from .steps import text_key, written

#: Bytes of the shortest rank.
ANCHOR = 32

#: Positions that are ranked together in step 3.
BLOCK = 16

#: A run's number is its document's number and its place there; a document has fewer runs than this.
_PLACES = 1 << 24

#: A document's number is its partition and its place there; a partition has fewer documents with runs.
_DOCUMENTS = 1 << 24

_POSITION = np.uint64((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First and last position, and both ranks, of each run of a slice of texts."""
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return nothing
    ranks = RangeHash(data)
    anchors = ranks.windows(ANCHOR)
    if len(anchors) > 1 << 24:
        raise ValueError("slices have at most 2**24 bytes")
    placed = (anchors & ~_POSITION) | np.arange(len(anchors), dtype=np.uint64)
    least = (_least(placed, length - ANCHOR + 1) & _POSITION).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = -1
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    held = least[first] >= 0
    first, last = first[held], last[held]
    if not len(first):
        return nothing
    at = least[first]
    whole = ranks(first, last + length)
    # Where the anchor stands in the run is part of its rank.
    return first, last, anchors[at], mixed(whole + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _pieces(at: np.ndarray, length: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last document, from byte, to byte): long documents in overlapping pieces."""
    for i, j in slices(at, size):
        start, end = int(at[i]), int(at[j])
        if j > i + 1 or end - start <= 2 * size:
            yield i, j, start, end
        else:
            for a in range(start, max(start + 1, end - length + 1), size):
                yield i, j, a, min(end, a + size + length - 1)


def text_runs(docs: DataFrame, length: int, text: str) -> DataFrame:
    """One row per document that has runs: `doc_id`, `text_key`, `uid`, and its runs' arrays."""
    schema = "doc_id long, text_key long, uid long, first array<int>, last array<int>, anchor array<long>, whole array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Numbers are kept by the written table; a task that runs again writes the same ones or others, once.
        part = TaskContext.get().partitionId()
        if part >= 1 << 15:
            raise ValueError("documents come in too many partitions")
        uid = part * _DOCUMENTS
        for batch in batches:
            at, data = utf8(batch.column(2))
            columns = [[], [], [], []]
            counts = np.zeros(batch.num_rows, np.int64)
            for i, j, a, b in _pieces(at, length):
                offsets = np.clip(at[i : j + 1], a, b) - a
                found = runs(data[a:b], offsets, length)
                doc = np.searchsorted(offsets, found[0], "right") - 1
                counts[i:j] += np.bincount(doc, minlength=j - i)
                shift = a - at[i : j][doc]
                for out, x in zip(columns, (found[0] + shift, found[1] + shift, *found[2:])):
                    out.append(x)
            if counts.any() and counts.max() >= _PLACES:
                raise ValueError("a text has too many runs")
            first, last, anchor, whole = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns)
            has = np.flatnonzero(counts)
            cuts = pa.array(np.r_[0, np.cumsum(counts[has])], pa.int32())
            lists = [
                pa.ListArray.from_arrays(cuts, pa.array(x))
                for x in (first.astype(np.int32), last.astype(np.int32), anchor.view(np.int64), whole.view(np.int64))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(has)), batch.column(1).take(pa.array(has)), pa.array(uid + np.arange(len(has))), *lists],
                ["doc_id", "text_key", "uid", "first", "last", "anchor", "whole"],
            )
            uid += len(has)
            if uid > (part + 1) * _DOCUMENTS:
                raise ValueError("a partition has too many documents")

    rows = docs.select(F.col("doc_id").cast("long"), text_key(text).alias("text_key"), F.col(text))
    return rows.mapInArrow(run, schema)


def _told_apart(ranked: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """From (`shared`, `whole`, `ref`): the ranks `whole` that repeat, and one `ref` of each to rank further.

    `shared` is the rank of what all strings of a row have in common; `whole` that of all its bytes.
    Where all rows with one `shared` are equal, nothing is left to tell apart.
    """
    classes = steps.write(ranked.groupBy("shared", "whole").agg(F.count("*").alias("n"), F.min("ref").alias("ref")))
    several = classes.groupBy("shared").agg(F.count("*").alias("kinds")).where("kinds > 1").select("shared")
    return classes.where("n > 1").select("whole"), classes.join(several, "shared").select("ref")


def _run_texts(docs: DataFrame, table: DataFrame, refs: DataFrame, length: int, text: str, steps: Steps) -> DataFrame:
    """The bytes of the runs `refs`: (`id`, `ref`, `bytes`), written."""
    places = refs.select((F.col("ref") % _PLACES).cast("int").alias("place"), F.expr(f"ref div {_PLACES}").alias("uid"))
    wanted = places.groupBy("uid").agg(F.sort_array(F.collect_list("place")).alias("places"))
    wanted = table.select("uid", "doc_id", "text_key", "first", "last").join(wanted, "uid").select(
        "uid", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "places",
        F.transform("places", lambda p: F.get("first", p)).alias("first"),
        F.transform("places", lambda p: F.get("last", p)).alias("last"),
    )
    rows = docs.select(F.col("doc_id").cast("long"), text_key(text).alias("text_key"), F.col(text).alias("_text"))
    joined = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_doc"]) & (rows["text_key"] == wanted["_key"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 30
        for batch in batches:
            at, data = utf8(batch.column(4))
            raw, refs, texts = data.tobytes(), [], []
            for doc, (uid, places, first, last) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                for place, a, b in zip(places, first, last):
                    refs.append(uid * _PLACES + place)
                    texts.append(raw[at[doc] + a : at[doc] + b + length])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + len(refs))), pa.array(refs, pa.int64()), pa.array(texts, pa.binary())],
                ["id", "ref", "bytes"],
            )
            number += len(refs)

    return steps.write(joined.select("uid", "places", "first", "last", "_text").mapInArrow(run, "id long, ref long, bytes binary"))


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """Runs cut into blocks, aligned at the run's anchor: (`shared`, `whole`, `ref`).

    `ref` is the run's id with the block's first and last position in the run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in slices(at):
                own, offsets = data[at[i] : at[j]], at[i:j] - at[i]
                ranks, n = RangeHash(own), np.diff(at[i : j + 1]) - length + 1
                anchors = ranks.windows(ANCHOR)
                placed = (anchors & ~_POSITION) | np.arange(len(anchors), dtype=np.uint64)
                anchor = (_least(placed, length - ANCHOR + 1)[offsets] & _POSITION).astype(np.int64) - offsets
                low, high = -(anchor // BLOCK) - (anchor % BLOCK > 0), (n - 1 - anchor) // BLOCK
                count = high - low + 1
                run_of = np.repeat(np.arange(j - i), count)
                index = np.arange(len(run_of)) - np.repeat(np.cumsum(count) - count, count) + low[run_of]
                begin = anchor[run_of] + BLOCK * index
                first, last = np.maximum(begin, 0), np.minimum(begin + BLOCK, n[run_of]) - 1
                base = offsets[run_of]
                shared = ranks(base + begin + BLOCK - 1, base + begin + length)
                whole = ranks(base + first, base + last + length)
                whole = mixed(whole + (first - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                ref = (ids[i:j][run_of] << 16) + (first << 8) + last
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shared.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ref)], ["shared", "whole", "ref"]
                )

    return texts.select("id", "bytes").mapInArrow(run, "shared long, whole long, ref long")


def _positions(texts: DataFrame, refs: DataFrame, length: int) -> DataFrame:
    """Single positions of blocks: (`whole`, `ref`), `ref` with the position as first and last."""
    block = refs.select(
        F.shiftrightunsigned("ref", 16).alias("id"), F.expr("shiftrightunsigned(ref, 8) & 255").cast("int").alias("from"),
        F.expr("ref & 255").cast("int").alias("to"),
    )
    rows = texts.join(block, "id").select("id", "from", F.expr(f"substring(bytes, `from` + 1, `to` - `from` + {length})").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(2))
            ids, start = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for i, j in slices(at):
                ranks, n = RangeHash(data[at[i] : at[j]]), np.diff(at[i : j + 1]) - length + 1
                block_of = np.repeat(np.arange(j - i), n)
                step = np.arange(len(block_of)) - np.repeat(np.cumsum(n) - n, n)
                begin = (at[i:j] - at[i])[block_of] + step
                position = start[i:j][block_of] + step
                whole = ranks(begin, begin + length)
                ref = (ids[i:j][block_of] << 16) + (position << 8) + position
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(ref)], ["whole", "ref"])

    return rows.mapInArrow(run, "whole long, ref long")


def repeats(docs: DataFrame, length: int = 200, text: str = "text") -> DataFrame:
    """Written `doc_id`, `text_key`, `ranges`: where strings of `length` bytes begin that begin elsewhere too.

    A range holds the first and the last of consecutive positions in the text's UTF-8 bytes.
    Documents without such strings have no row.
    """
    if not ANCHOR + BLOCK <= length <= ANCHOR + 255:
        raise ValueError(f"length must be from {ANCHOR + BLOCK} to {ANCHOR + 255}")
    # Tables go as soon as what is computed from them is written: `runs`, then `inside`, then `all_`.
    all_, runs, inside = (Steps(docs.sparkSession) for _ in range(3))
    table = all_.write(text_runs(docs, length, text))
    zipped = F.posexplode(F.arrays_zip(F.col("anchor").alias("shared"), F.col("whole").alias("whole"))).alias("place", "x")
    ranked = table.select("uid", zipped).select("x.shared", "x.whole", (F.col("uid") * _PLACES + F.col("place")).alias("ref"))
    whole, open_runs = _told_apart(ranked, runs)
    found = all_.write(ranked.select("whole", "ref").join(whole, "whole").select(
        "ref", F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to")
    ))
    texts = _run_texts(docs, table, open_runs, length, text, inside)
    runs.clear()
    blocks = inside.write(_blocks(texts, length))
    whole, open_blocks = _told_apart(blocks, inside)
    inner = blocks.select("whole", "ref").join(whole, "whole").select("ref")
    single = inside.write(_positions(texts, open_blocks, length))
    again = single.groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole")
    inner = inner.union(single.join(again, "whole").select("ref"))
    inner = inner.select(
        F.shiftrightunsigned("ref", 16).alias("id"), F.expr("shiftrightunsigned(ref, 8) & 255").cast("int").alias("from"),
        F.expr("ref & 255").cast("int").alias("to"),
    )
    found = found.unionByName(all_.write(inner.join(texts.select("id", "ref"), "id").select("ref", "from", "to")))
    inside.clear()
    by_text = found.select(
        F.expr(f"ref div {_PLACES}").alias("uid"), F.struct((F.col("ref") % _PLACES).cast("int").alias("place"), "from", "to").alias("mark")
    ).groupBy("uid").agg(F.collect_list("mark").alias("marks"))

    def placed(m):
        first = F.get("first", m["place"])
        return F.struct(
            (first + F.coalesce(m["from"], F.lit(0))).alias("first"),
            F.coalesce(first + m["to"], F.get("last", m["place"])).alias("last"),
        )

    out = table.join(by_text, "uid").select("doc_id", "text_key", F.sort_array(F.transform("marks", placed)).alias("ranges"))
    # Repeated rows have equal ranges, so any of them serves.
    out = written(out.groupBy("doc_id", "text_key").agg(F.first("ranges").alias("ranges")))
    all_.clear()
    return out


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text") -> DataFrame:
    """`doc_id`, `n_bytes`, `removed` (byte spans, end exclusive) and `kept` (the other bytes) of every row.

    Every byte goes that a string of `length` bytes covers which begins anywhere else too, in
    the same document or another; strings are judged on the input and overlaps count.  A null
    text is empty.  Texts shorter than `length` bytes keep all.  Repeated rows are repeats of
    each other.  An empty table gives an empty one.
    """
    ranges = repeats(docs, length, text).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "ranges")
    rows = docs.select(F.col("doc_id").cast("long"), text_key(text).alias("_own"), F.col(text).alias("_text"))
    joined = rows.join(ranges, rows["doc_id"].eqNullSafe(ranges["_doc"]) & (rows["_own"] == ranges["_key"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(1))
            raw, spans, kept = data.tobytes(), [], []
            for doc, marks in enumerate(batch.column(2).to_pylist()):
                own, merged, rest, end = raw[at[doc] : at[doc + 1]], [], [], 0
                for m in marks or ():
                    a, b = m["first"], m["last"] + length
                    if merged and a <= merged[-1]["end"]:
                        merged[-1]["end"] = max(b, merged[-1]["end"])
                    else:
                        merged.append({"start": a, "end": b})
                for m in merged:
                    rest.append(own[end : m["start"]])
                    end = m["end"]
                spans.append(merged)
                kept.append(b"".join([*rest, own[end:]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(at)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    schema = "doc_id long, n_bytes long, removed array<struct<start: int, end: int>>, kept binary"
    return joined.select("doc_id", "_text", "ranges").mapInArrow(run, schema)
