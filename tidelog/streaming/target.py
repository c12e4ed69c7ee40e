"""A target table that a stream of changes keeps up to date, as the state of the stream."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.operators.apply import Target, apply_status
from tidelog.streaming.capture import Sink
from tidelog.streaming.state import BUCKET, BUCKETS, BucketState, bucket_of, stored_rows, use_state_store

_OLD, _NEW = "_old_", "_new_"


def maintain(changes: DataFrame, target: Target, buckets: int = BUCKETS) -> DataFrame:
    """Apply a stream of changes to the rows in its state; the result is the changes it rejects.

    The streaming twin of `apply_log`.  Micro-batches must follow the log; within one, `seq`
    orders.  A table's rows are spread over buckets of keys, kept as text in the state of the
    stream.  TRUNCATE and, with `target.many_rows`, changes without the whole key go to all
    buckets of their table.  Rejected (`seq`, `tbl`, `operation`, `reason`) are changes in error
    and moves to another key, which may belong to another bucket: they need `apply_log`.
    """
    use_state_store(changes.sparkSession)
    keys, columns = list(target.keys), list(target.columns)
    op, text = F.col("operation"), lambda image, c: F.col(image)[c].try_cast(target.columns[c]).cast("string")
    # Looked up once per row: as plain columns the images would be read anew in every expression on them.
    looked_up = [text(image, c).alias(name + c) for image, name in (("old", _OLD), ("new", _NEW)) for c in columns]
    looked_up = F.inline(F.array(F.struct(apply_status(target).alias("status"), *looked_up)))
    changes = changes.select("seq", "tbl", "operation", looked_up).where("status <> 'noop'")
    old, new = lambda c: F.col(_OLD + c), lambda c: F.col(_NEW + c)
    named, moves = F.lit(True), F.lit(False)
    for k in keys:
        named = named & old(k).isNotNull()
        moves = moves | (new(k).isNotNull() & ~new(k).eqNullSafe(old(k)))
    tests = op.isin("UPDATE", "DELETE")
    everywhere = (op == "TRUNCATE") | (tests & ~named)
    status = F.col("status")
    reason = F.when(status == "apply_error", status).when((op == "UPDATE") & named & moves, "moves its key")
    here = [F.when(op == "INSERT", new(k)).otherwise(old(k)) for k in keys]
    one = F.array(bucket_of(*here, buckets=buckets))
    typed = changes.select(
        "seq", "tbl", "operation", reason.alias("reason"),
        *[c.alias(k) for k, c in zip(keys, here)], *[new(c).alias(c) for c in target.values],
        *[F.when(tests, old(c)).alias(_OLD + c) for c in columns],
        F.explode(F.when(reason.isNull() & everywhere, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(one)).alias(BUCKET),
    )
    return typed.groupBy("tbl", BUCKET).transformWithStateInPandas(
        _Rows(keys, columns, typed.columns), "seq long, tbl string, operation string, reason string", "Append", "None"
    )


def maintained(spark: SparkSession, checkpoint: str, target: Target) -> DataFrame:
    """The target's rows as of the last finished micro-batch of the stream with this checkpoint."""
    columns = ["tbl", *target.columns]
    rows = stored_rows(spark, checkpoint, ", ".join(f"`{c}` string" for c in columns), columns)
    return rows.select("tbl", *[F.col(c).cast(t).alias(c) for c, t in target.columns.items()])


class _Rows(BucketState):
    """The rows of one table whose keys fall into one bucket."""

    def __init__(self, keys: list[str], columns: list[str], names: list[str]) -> None:
        self._keys, self._columns, self._names = keys, columns, names

    def handleInputRows(self, key, rows, timerValues):
        rows = self.whole(rows, self._names)
        bad = rows["reason"].notna().to_numpy()
        changes = rows[~bad]
        emptied = changes.loc[changes["operation"] == "TRUNCATE", "seq"]
        if len(emptied):
            changes = changes[changes["seq"] >= emptied.max()]  # nothing before it is left
        changes = changes.sort_values("seq", kind="stable")
        if len(changes):
            state, stored = self.load(), np.zeros((0, len(self._columns)), object)
            if state is not None:
                stored = np.array([state[c].to_pylist() for c in self._columns], object).T.reshape(-1, len(self._columns))
            stored = self._advance(stored, changes)
            arrays = [pa.array([key[0]] * len(stored), pa.string()), *[pa.array(c, pa.string()) for c in stored.T]]
            self.store(pa.Table.from_arrays(arrays, ["tbl", *self._columns]))
        yield rows.loc[bad, ["seq", "tbl", "operation", "reason"]]

    def _advance(self, stored: np.ndarray, changes: pd.DataFrame) -> np.ndarray:
        op = changes["operation"].to_numpy()
        emptied = np.flatnonzero(op == "TRUNCATE")
        if len(emptied):
            stored, changes = stored[:0], changes.iloc[emptied[-1] + 1 :]
            op = op[emptied[-1] + 1 :]
        text = lambda names: changes[names].astype(object).where(changes[names].notna(), None).to_numpy()
        new, old = text(self._columns), text([_OLD + c for c in self._columns])
        width = len(self._keys)
        at_keys = [self._columns.index(k) for k in self._keys]
        wide = np.flatnonzero((op != "INSERT") & np.equal(old[:, at_keys], None).any(1))
        start = 0
        for end in [*wide, len(op)]:
            part = slice(start, end)
            stored = self._each_key(stored, op[part], new[part], old[part], at_keys)
            if end < len(op) and width:
                tested = np.equal(old[end], None)
                hit = (tested | (stored == old[end])).all(1)
                if op[end] == "DELETE":
                    stored = stored[~hit]
                else:
                    shown = ~np.equal(new[end], None)
                    shown[at_keys] = False
                    stored[np.ix_(hit, shown)] = new[end][shown]
            start = end + 1
        return stored

    def _each_key(self, stored: np.ndarray, op: np.ndarray, new: np.ndarray, old: np.ndarray, at_keys: list[int]) -> np.ndarray:
        """Changes of single keys: the first of every key, then the second, and so on."""
        if not len(op):
            return stored
        named = pd.MultiIndex.from_arrays([np.r_[stored[:, i], new[:, i]] for i in at_keys])
        code, names = pd.factorize(named)
        row_code, code = code[: len(stored)], code[len(stored) :]
        alive = np.zeros(len(names), bool)
        alive[row_code] = True
        rows = np.full((len(names), len(self._columns)), None, object)
        rows[row_code] = stored
        order = np.argsort(code, kind="stable")
        count = np.bincount(code, minlength=len(names))
        first = np.cumsum(count) - count
        keys, turn = np.flatnonzero(count), 0
        while len(keys):
            i = order[first[keys] + turn]
            held = alive[keys] & (np.equal(old[i], None) | (rows[keys] == old[i])).all(1)
            born = (op[i] == "INSERT") & ~alive[keys]
            rows[keys[born]] = new[i[born]]
            alive[keys[born]] = True
            changed = (op[i] == "UPDATE") & held
            k, n = keys[changed], new[i[changed]]
            rows[k] = np.where(np.equal(n, None), rows[k], n)
            alive[keys[(op[i] == "DELETE") & held]] = False
            turn += 1
            keys = keys[count[keys] > turn]
        return rows[alive]


def release(
    scheduled: DataFrame,
    sink: Sink,
    slot_ms: int,
    start_at_ms: int,
    now_ms: Callable[[], int] = lambda: int(time.time() * 1000),
    wait: Callable[[float], None] = time.sleep,
) -> int:
    """Hand a scheduled replay (`slot`, `release_ms`) to `sink` slot by slot, when each is due.

    The driver waits; executors only run the slots.  Returns the number of slots sent.
    Write `scheduled` partitioned by `slot` first, and each slot reads only its own files.
    """
    sent = 0
    for row in scheduled.select("slot").distinct().orderBy("slot").toLocalIterator():
        due = start_at_ms + row["slot"] * slot_ms
        behind = due - now_ms()
        if behind > 0:
            wait(behind / 1000)
        sink(scheduled.where(F.col("slot") == row["slot"]), row["slot"])
        sent += 1
    return sent
