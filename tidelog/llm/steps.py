"""Steps written between jobs, document keys, and names for added columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: `df` as a table of its own in the shared checkpoint folder.
written = cut_lineage


def text_key(text: str = "text") -> Column:
    """With `doc_id`, tells rows apart: rows equal in both are repeated rows of one document."""
    return F.xxhash64(F.col(text))


def unused(df: DataFrame, *names: str) -> list[str]:
    """`names`, each lengthened until no column of `df` has it (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
