"""De-duplication by time to live on an unbounded stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.operators.dedup import KEY, TTL_MS
from tidelog.streaming.state import BUCKET, BUCKETS, BucketState, bucket_of, use_state_store

_NEVER = np.iinfo(np.int64).min


def applied(code: np.ndarray, time: np.ndarray, last: np.ndarray, ttl_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """Which deliveries apply, and every key's last applied time.

    Rows are sorted by `code`, the number of their key, and `time`; `last` is by key (`_NEVER`:
    none).  All keys advance together, by one applied delivery a round.
    """
    mark, last = np.zeros(len(code), bool), last.copy()
    instants = np.unique(time)
    place = code * (len(instants) + 1) + np.searchsorted(instants, time)
    end = np.searchsorted(code, np.arange(len(last)), "right")
    keys = np.arange(len(last))
    while len(keys):
        due = np.where(last[keys] == _NEVER, _NEVER, last[keys] + ttl_ms)
        at = np.searchsorted(place, keys * (len(instants) + 1) + np.searchsorted(instants, due))
        there = at < end[keys]
        keys, at = keys[there], at[there]
        mark[at] = True
        last[keys] = time[at]
    return mark, last


class _TimeToLive(BucketState):
    def __init__(self, key: str, time: str, order: str, ttl_ms: int, expire: bool, names: list[str]) -> None:
        self._names = names
        self._key, self._time, self._order, self._ttl, self._expire = key, time, order, ttl_ms, expire

    def handleInputRows(self, key, rows, timerValues):
        rows = self.whole(rows, [*self._names, BUCKET]).sort_values([self._time, self._order], kind="stable")
        code, names = pd.factorize(rows[self._key])
        order = np.argsort(code, kind="stable")
        rows, code = rows.iloc[order], code[order]
        state = self.load()
        last = np.full(len(names), _NEVER)
        if state is not None:
            # `names` in the state; the others are appended.
            at = pd.Index(state["key"].to_pandas()).get_indexer(pd.Index(names))
            last[at >= 0] = state["last"].to_numpy()[at[at >= 0]]
        mark, last = applied(code, rows[self._time].to_numpy(), last, self._ttl)
        if mark.any():
            table = pa.table({"key": pa.array(names, pa.string()), "last": pa.array(last, pa.int64())})
            if state is not None:
                kept = np.ones(len(state), bool)
                kept[at[at >= 0]] = False
                table = pa.concat_tables([state.filter(pa.array(kept)), table])
            self.store(table)
        if self._expire:
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._ttl)
        yield rows.loc[mark, self._names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.load()
        if state is not None:
            oldest = timerValues.getCurrentProcessingTimeInMs() - 2 * self._ttl
            self.store(state.filter(pa.array(state["last"].to_numpy() >= oldest)))
        return iter(())


def dedup_stream(
    stream: DataFrame, time: str, order: str, ttl_ms: int = TTL_MS, key: str = KEY, expire: bool = True, buckets: int = BUCKETS
) -> DataFrame:
    """The deliveries that apply: the streaming twin of `dedup_by_ttl`, over the same time column.

    The state of a key is the time of its last applied delivery; `state` keeps that of a bucket
    of keys together.  With `expire`, timers drop keys whose last applied delivery is twice the
    time to live back by the clock; this needs a stream that stays up, since timers keep an
    `availableNow` run from ending.  A bucket's rows of one micro-batch are looked at together,
    so the trigger's size bounds them.  Rows without key or time go, as in `dedup_by_ttl`.
    """
    use_state_store(stream.sparkSession)
    known = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(key, F.col(key).cast("string"))
    return known.withColumn(BUCKET, bucket_of(F.col(key), buckets=buckets)).groupBy(BUCKET).transformWithStateInPandas(
        _TimeToLive(key, time, order, ttl_ms, expire, known.columns), known.schema, "Append", "ProcessingTime" if expire else "None"
    )
