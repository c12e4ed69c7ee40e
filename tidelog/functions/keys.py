"""Idempotency keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tidelog.functions.wal import let


def content_key(
    lsn: Column, table: Column, old: Column, new: Column, columns: Sequence[str] = ()
) -> Column:
    """`lsn:table:` + 16 hex digits of the md5 over the sorted `k=v` pairs of the row image.

    The image is `new` unless it is empty, then `old`.  Two changes of one payload
    that carry the same image share this key; `position_key` tells them apart.

    `columns` names the columns images usually have.  An image with no other names takes a
    path of compiled expressions; any other goes through the sorted list of its names, with
    the same result.
    """

    def image_text(data):
        names = F.sort_array(F.map_keys(data))
        return F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), data[k])), ":")

    def known_text(data):
        return F.concat_ws(":", *[F.concat(F.lit(f"{c}="), data[c]) for c in sorted(columns)])

    data = F.when(F.size(new) > 0, new).otherwise(old)
    if columns:
        present = sum((data[c].isNotNull().cast("int") for c in columns), F.lit(0))
        text = F.when(F.size(data) == present, known_text(data)).otherwise(let(data, image_text))
    else:
        text = let(data, image_text)
    return F.concat_ws(":", lsn, table, F.substring(F.md5(text), 1, 16))


def position_key(
    lsn: Column, table: Column, operation: Column, index: Column, old: Column, new: Column
) -> Column:
    """Content key plus operation and position in the payload: unique per change of the log."""
    return F.concat_ws(":", content_key(lsn, table, old, new), operation, index.cast("string"))


def primary_key(
    lsn: Column, table: Column, operation: Column, old: Column, new: Column, fields: Sequence[str]
) -> Column:
    """`lsn:table:pk1:pk2`; DELETE reads `old`, all else `new`; a missing field is an empty segment."""
    data = F.when(operation == "DELETE", old).otherwise(new)
    segments = [F.coalesce(F.try_element_at(data, F.lit(f)), F.lit("")) for f in fields]
    return F.concat_ws(":", lsn, table, *segments)
