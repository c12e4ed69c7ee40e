"""Benchmark passages in documents: a prefix-filtered join of word shingles.

A window is `width` consecutive words of an item.  Its shingles are ordered by how rare they
are in the corpus; a text that holds the window must hold the rarest of them, so that one
shingle (the necessary prefix for full containment) finds all candidates.  Positions and
lengths rule out candidates that would begin before or end behind the text, and the rest is
verified: the shingles that cover the whole window must stand at their places.  Shingles are
compared as text; hashes only drop what cannot match.

Documents are read once.  What leaves a task is one row per document with the shingles that
some item holds too, found by a bit table of fixed size (2 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import RangeHash, mixed, slices, utf8
from .steps import text_key, unused, written
from .words import ranges, table

#: Bits of the table that tells which shingles are looked for: 2**24, whatever the benchmark's size.
TABLE_BITS = 24

#: Everything ASCII but digits and letters separates words.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_STEP = np.uint64(0xD6E8FEB86659FD93)


def _shingles(lowered: np.ndarray, offsets: np.ndarray, lengths: list[int]):
    """Word ranges and counts of a slice of texts; for each length the shingles' hashes and first words."""
    starts, ends, counts = ranges(lowered, offsets)
    own = RangeHash(lowered)(starts, ends)
    doc = np.repeat(np.arange(len(counts)), counts)
    found = []
    for n in lengths:
        m = len(own) - n + 1
        if m <= 0:
            continue
        h = own[:m].copy()
        for k in range(1, n):
            h = h * _STEP + own[k : k + m]
        first = np.flatnonzero(doc[:m] == doc[n - 1 :])
        found.append((n, mixed(h[first] + np.uint64(n)), first))
    return starts, ends, counts, found


def _texts(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: int) -> list[str]:
    """The words of shingles, space-joined."""
    raw = lowered.tobytes()
    word = lambda i: raw[starts[i] : ends[i]]
    return [b" ".join([word(i + k) for k in range(n)]).decode("utf-8", "replace") for i in first.tolist()]


def item_windows(items: DataFrame, width: int, shingle: int, text: str = "text") -> DataFrame:
    """Distinct (`item_id`, `size`, `shingles`): the shingles of each window with their offsets."""
    lut = table(SEPARATORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(1))
            ids, sizes, rows, hashes = [], [], [], []
            for doc, item in enumerate(batch.column(0).to_pylist()):
                lowered = lut[data[at[doc] : at[doc + 1]]]
                starts, ends, counts = ranges(lowered, np.array([0, len(lowered)]))
                size = min(width, int(counts[0]))
                if not size:
                    continue
                n = min(shingle, size)
                *_, found = _shingles(lowered, np.array([0, len(lowered)]), [n])
                _, h, first = found[0]
                texts = _texts(lowered, starts, ends, first, n)
                h = h.view(np.int64).tolist()
                for p in range(int(counts[0]) - size + 1):
                    ids.append(item)
                    sizes.append(size)
                    rows.append(texts[p : p + size - n + 1])
                    hashes.append(h[p : p + size - n + 1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()),
                    pa.array(rows, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())),
                ],
                ["item_id", "size", "shingles", "hashes"],
            )

    rows = items.select(F.col("item_id").cast("long"), F.col(text))
    return rows.mapInArrow(run, "item_id long, size int, shingles array<string>, hashes array<long>").distinct()


def _bit_table(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which leading bits of a hash some item's shingle has, and which sizes windows have.

    At most 2**18 rows of 64 bits and as many sizes as a window has words reach the driver.
    """
    h = windows.select(F.explode("hashes").alias("h")).select(
        F.expr(f"shiftrightunsigned(h, {64 - TABLE_BITS + 6})").alias("slot"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - TABLE_BITS}) & 63 as int))").alias("bit"),
    )
    bits = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    for slot, bit in h.groupBy("slot").agg(F.bit_or("bit")).collect():
        bits[slot] = np.uint64(bit & 0xFFFFFFFFFFFFFFFF)
    return bits, sorted(r[0] for r in windows.select("size").distinct().collect())


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `text_key`, `n_words`, and `hits` (first word from 0, shingle)."""
    bits, sizes = _bit_table(windows)
    lengths = sorted({min(shingle, s) for s in sizes})
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    lut = table(SEPARATORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            at, data = utf8(batch.column(2))
            n_words, where, place, shingles = [], [], [], []
            for i, j in slices(at):
                lowered = lut[data[at[i] : at[j]]]
                starts, ends, counts, found = _shingles(lowered, at[i : j + 1] - at[i], lengths)
                n_words.append(counts)
                begins = np.cumsum(counts) - counts
                doc = np.repeat(np.arange(len(counts)), counts)
                for n, h, first in found:
                    slot = (h >> np.uint64(64 - TABLE_BITS + 6)).astype(np.int64)
                    bit = (h >> np.uint64(64 - TABLE_BITS)) & np.uint64(63)
                    hit = first[(wanted[slot] >> bit) & np.uint64(1) != 0]
                    if len(hit):
                        where.append(doc[hit] + i)
                        place.append(hit - begins[doc[hit]])
                        shingles += _texts(lowered, starts, ends, hit, n)
            where = np.concatenate(where) if where else np.zeros(0, np.int64)
            place = np.concatenate(place) if place else np.zeros(0, np.int64)
            order = np.argsort(where, kind="stable")
            hits = pa.StructArray.from_arrays(
                [pa.array(place[order], pa.int32()), pa.array(shingles, pa.string()).take(pa.array(order))], ["at", "shingle"]
            )
            cuts = np.searchsorted(where[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), hits),
                ],
                ["doc_id", "text_key", "n_words", "hits"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_key(text).alias("text_key"), F.col(text))
    schema = "doc_id long, text_key long, n_words long, hits array<struct<at: int, shingle: string>>"
    return written(rows.mapInArrow(run, schema))


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 5, text: str = "text", item_text: str = "text"
) -> DataFrame:
    """Per row of `docs`: `doc_id`, `text_key`, `n_words`, `n_hit`, `items` (ids of items with a window in it).

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters.  An item of
    fewer than `width` words is one window; items and texts without words (null, empty) match
    nothing.  An item with a null id marks words but is not listed.  Rows equal in `doc_id`
    and text have equal results; an empty table on either side gives no hits.  `2 * shingle`
    must be at least `width`, so that two shingles cover a window.
    """
    if 2 * shingle < width:
        raise ValueError("two shingles must cover a window")
    windows = written(item_windows(items, width, shingle, item_text))
    docs_hits = occurrences(docs, windows, shingle, text)
    seen = docs_hits.select("doc_id", "text_key", "n_words", F.explode("hits").alias("hit")).select(
        "doc_id", "text_key", "n_words", "hit.*"
    )
    # Windows with equal words are one; the shingle that the corpus holds least is its prefix.
    shapes = windows.groupBy("size", "shingles").agg(F.collect_set("item_id").alias("items"))
    shapes = shapes.withColumn("window", F.monotonically_increasing_id())
    shapes = written(shapes)
    held = seen.groupBy("shingle").agg(F.count("*").alias("n"))
    parts = shapes.select("window", F.size("shingles").alias("m"), F.posexplode("shingles").alias("offset", "shingle"))
    ranked = parts.join(held, "shingle").groupBy("window").agg(
        F.count("*").alias("there"), F.first("m").alias("m"),
        F.min(F.struct("n", "offset", "shingle")).alias("rarest"),
    )
    prefix = ranked.where("there = m").select("window", F.col("rarest.offset").alias("offset"), F.col("rarest.shingle").alias("shingle"))
    prefix = prefix.join(
        shapes.select("window", "size", F.col("shingles")[0].alias("head"), F.element_at("shingles", -1).alias("tail")), "window"
    )
    begin = F.col("at") - F.col("offset")
    candidates = seen.join(prefix, "shingle").where((begin >= 0) & (begin + F.col("size") <= F.col("n_words")))
    candidates = candidates.select("doc_id", "text_key", "window", "size", begin.alias("begin"), "head", "tail")
    there = seen.select(
        F.coalesce("doc_id", F.lit(0)).alias("_doc"), F.col("doc_id").isNull().alias("_null"), "text_key", "at", "shingle"
    ).distinct()
    for end, shift in (("head", F.lit(0)), ("tail", F.col("size") - F.least("size", F.lit(shingle)))):
        probe = candidates.select(
            "*", F.coalesce("doc_id", F.lit(0)).alias("_doc"), F.col("doc_id").isNull().alias("_null"),
            (F.col("begin") + shift).alias("at"), F.col(end).alias("shingle"),
        )
        candidates = probe.join(there, ["_doc", "_null", "text_key", "at", "shingle"], "left_semi").select(candidates.columns)
    found = candidates.join(shapes.select("window", "items"), "window")
    spans = F.collect_set(F.struct("begin", "size"))
    merged = found.groupBy("doc_id", "text_key").agg(
        F.sort_array(spans).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    # Words in the union of spans: each adds what lies behind the end reached so far.
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(s, x):
        end = x["begin"] + x["size"]
        return F.struct(
            (s["n"] + F.greatest(end - F.greatest(s["end"], x["begin"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], end).alias("end"),
        )

    hit = merged.select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"),
        F.aggregate("spans", state, add)["n"].cast("long").alias("n_hit"), "items",
    )
    base = docs_hits.select("doc_id", "text_key", "n_words")
    joined = base.join(hit, base["doc_id"].eqNullSafe(hit["_doc"]) & (base["text_key"] == hit["_key"]), "left")
    return joined.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs."""
    doc, key, own = unused(docs, "_doc", "_key", "_own")
    marked = contamination(docs, items, text=text, **options).where("n_hit > 0").select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key)
    )
    condition = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key))
    return docs.withColumn(own, text_key(text)).join(marked, condition, "left_anti").select(*docs.columns)
