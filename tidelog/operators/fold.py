"""Ordered folds whose groups stream through a task instead of being collected."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold_sorted(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    step: Callable[[dict, dict | None], tuple[dict, Iterable[dict]]],
    schema: T.StructType,
    finish: Callable[[dict], Iterable[dict]] | None = None,
) -> DataFrame:
    """Fold the rows of each group in order.

    `step(row, state)` gets None as the state of a new group and returns the next
    state and the rows to emit; `finish(state)` emits more at the end of a group.
    Spark partitions by the group and sorts; a task then holds one state and one
    Arrow batch, whatever the size of its groups.
    """
    by, arrow = list(by), to_arrow_schema(schema)

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                group = [row[c] for c in by]
                if group != key:
                    if state is not None and finish:
                        out.extend(finish(state))
                    key, state = group, None
                state, emitted = step(row, state)
                out.extend(emitted)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if state is not None and finish:
            yield pa.RecordBatch.from_pylist(list(finish(state)), schema=arrow)

    # A fixed number of partitions: merging them by size, as is done after other shuffles,
    # would leave this per-row work to a few tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by).sortWithinPartitions(*by, order).mapInArrow(run, schema)
