"""Applying a change log to tables, as set operations instead of row by row.

Changes have `tbl`, `operation`, string maps `old` and `new`, and `seq`, their
unique place in the log.  A target is described by `Target`: key columns and all
columns with their types.  `base` holds its rows before the log, with `tbl`.

Semantics of one change, in log order per table:
  INSERT    adds a row unless its key exists,
  UPDATE    overlays the columns present in `new` on the row `old` names, if any,
  DELETE    removes the row `old` names,
  TRUNCATE  empties the table;
an empty image makes a change a no-op, an unknown operation or a value that does
not fit its column makes it an error, and neither touches the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.functions.wal import OPERATIONS
from tidelog.operators import identity, segments
from tidelog.session import cut_lineage


@dataclass(frozen=True)
class Target:
    keys: tuple[str, ...]
    columns: dict[str, str]  # name -> Spark type, keys included
    many_rows: bool = False  # whether `old` may lack key columns and so name many rows

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]

    @property
    def by(self) -> list[str]:
        return ["tbl", *self.keys]


# --- status of single changes -------------------------------------------------


def _is_noop() -> Column:
    op, no_new, no_old = F.col("operation"), F.size("new") == 0, F.size("old") == 0
    return (
        ((op == "INSERT") & no_new)
        | ((op == "UPDATE") & (no_new | no_old))
        | ((op == "DELETE") & no_old)
    )


def apply_status(target: Target | None = None) -> Column:
    """`applied`, `noop` or `apply_error` of a change, from its operation and images alone."""
    bad = ~F.col("operation").isin(*OPERATIONS) | F.col("operation").isNull()
    if target is None:
        return F.when(bad, "apply_error").when(_is_noop(), "noop").otherwise("applied")
    op = F.col("operation")
    unfit = F.lit(False)
    for image in ("new", "old"):
        # Only the image an operation uses can make it fail.
        used = op.isin("INSERT", "UPDATE") if image == "new" else op.isin("UPDATE", "DELETE")
        # A column the target lacks: more names than the known ones account for.
        known = sum((F.map_contains_key(image, c).cast("int") for c in target.columns), F.lit(0))
        extra = F.size(image) > known
        broken = [
            F.col(image)[c].isNotNull() & F.col(image)[c].try_cast(t).isNull() for c, t in target.columns.items()
        ]
        for condition in [extra, *broken]:
            unfit = unfit | (used & condition)
    no_key = F.lit(False)
    for k in target.keys:
        # Many rows cannot be given one key.
        unnamed = F.col("old")[k].isNull()
        if target.many_rows:
            unnamed = unnamed & reduce(lambda a, b: a | b, [F.col("new")[c].isNotNull() for c in target.keys])
        no_key = no_key | F.when(op == "INSERT", F.col("new")[k].isNull()).when(op.isin("UPDATE", "DELETE"), unnamed).otherwise(False)
    return (
        F.when(bad, "apply_error").when(_is_noop(), "noop").when(unfit | no_key, "apply_error").otherwise("applied")
    )


def dry_run(df: DataFrame) -> DataFrame:
    """The action each change would take, as text; touches nothing."""
    return df.withColumn(
        "action",
        F.concat(
            F.col("operation"), F.lit(" on "), F.col("tbl"),
            F.lit(": old="), F.to_json("old"), F.lit(", new="), F.to_json("new"),
        ),
    )


def _effective(changes: DataFrame, target: Target) -> DataFrame:
    """Changes that do something, with typed key and value columns."""
    typed = [
        F.when(F.col("operation") == "INSERT", F.col("new")[k])
        .otherwise(F.col("old")[k])
        .try_cast(target.columns[k])
        .alias(k)
        for k in target.keys
    ]
    values = [F.col("new")[c].try_cast(target.columns[c]).alias(c) for c in target.values]
    return changes.where(apply_status(target) == "applied").select("seq", "tbl", "operation", *typed, *values)


def _with_base(rows: DataFrame, base: DataFrame | None, target: Target) -> DataFrame:
    """Base rows enter as INSERTs before the log."""
    if base is None:
        return rows
    before = base.select(F.lit(-1).cast("bigint").alias("seq"), "tbl", F.lit("INSERT").alias("operation"),
                         *target.keys, *target.values)
    return rows.unionByName(before)


def after_truncate(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows past the last TRUNCATE that `log` has for their table (one row per table is looked up)."""
    barrier = log.where("operation = 'TRUNCATE'").groupBy("tbl").agg(F.max("seq").alias("_barrier"))
    return (
        rows.where("operation <> 'TRUNCATE'")
        .join(barrier, "tbl", "left")
        .where(F.col("_barrier").isNull() | (F.col("seq") > F.col("_barrier")))
        .drop("_barrier")
    )


# --- the log as a function of the row -----------------------------------------


def summarise(rows: DataFrame, by: Sequence[str], values: Sequence[str], width: int) -> DataFrame:
    """What the changes of each group do to a row, as one row per group.

    `deleted`: the row is gone at some point.  `born`: the group ends with a row even
    if there was none before, with the values `born_*`.  `upd_*`: the values overlaid
    on a row that was there before (and, if `deleted`, on nothing).  Either kind is the
    last non-NULL value per column.

    The changes of a group are a chain of functions, which can be joined piece by piece.
    So a first shuffle by (group, log segment) makes one row per piece, of at most
    `width` changes, and a second one joins the pieces of a group.  A key with a third
    of the log is thereby spread over all its segments.
    """
    by = list(by)
    pieces_ = pieces(rows.withColumn("_seg", segments.segment_of("seq", width)), by, values)
    return _joined(pieces_, by, values)


def _last(column: str, condition: Column, order: Column) -> Column:
    return F.max_by(column, F.when(condition & F.col(column).isNotNull(), order))


def pieces(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """What the changes of each group and segment (`_seg`) do to a row, as one row per piece.

    `_from`, `_del` and `_birth`: the places of the first change, the last DELETE and the first
    INSERT behind it; `_b_*` and `_u_*`: the last values since the birth and since the DELETE.
    """
    by = list(by)
    seq, insert, update = F.col("seq"), F.col("operation") == "INSERT", F.col("operation") == "UPDATE"
    piece = W.partitionBy(*by, "_seg")
    none = F.lit(-(2**62))
    rows = rows.withColumn("_del", F.max(F.when(F.col("operation") == "DELETE", seq)).over(piece)).withColumn(
        "_birth", F.min(F.when(insert & (seq > F.coalesce("_del", none)), seq)).over(piece)
    )
    in_born = (seq == F.col("_birth")) | (update & (seq > F.col("_birth")))
    in_update = update & (seq > F.coalesce("_del", none))
    return rows.groupBy(*by, "_seg").agg(
        F.min("seq").alias("_from"),
        F.max("_del").alias("_del"),
        F.max("_birth").alias("_birth"),
        *[_last(c, in_born, seq).alias(f"_b_{c}") for c in values],
        *[_last(c, in_update, seq).alias(f"_u_{c}") for c in values],
    )


def _joined(pieces: DataFrame, by: list[str], values: Sequence[str]) -> DataFrame:
    """The pieces of each group as one row."""
    none = F.lit(-(2**62))
    whole = W.partitionBy(*by)
    seg = F.col("_seg")
    pieces = pieces.withColumn(
        "_del_seg", F.max(F.when(F.col("_del").isNotNull(), seg)).over(whole)
    ).withColumn(
        "_birth_seg",
        F.min(F.when(F.col("_birth").isNotNull() & (seg >= F.coalesce("_del_seg", none)), seg)).over(whole),
    )
    for c in values:
        pieces = pieces.withColumn(
            f"_b_{c}", F.when(seg == F.col("_birth_seg"), F.col(f"_b_{c}")).otherwise(F.col(f"_u_{c}"))
        )
    return pieces.groupBy(*by).agg(
        F.min("_from").alias("first_seq"),
        F.max(F.col("_del_seg").isNotNull()).alias("deleted"),
        F.max(F.col("_birth_seg").isNotNull()).alias("born"),
        *[_last(f"_b_{c}", seg >= F.col("_birth_seg"), seg).alias(f"born_{c}") for c in values],
        *[_last(f"_u_{c}", seg >= F.coalesce("_del_seg", none), seg).alias(f"upd_{c}") for c in values],
    )


def apply_log(
    changes: DataFrame,
    target: Target,
    base: DataFrame | None = None,
    width: int = segments.SEGMENT_ROWS,
    raw_log: DataFrame | None = None,
) -> DataFrame:
    """Target rows after the log: every column in `old` must match the row, by `apply_general`.

    `raw_log`, if given, is the log `changes` was de-duplicated from.  It has the same
    TRUNCATEs and is read for them, so that the de-duplication runs only once.
    """
    return apply_general(changes, target, base, width, raw_log)


def state_as_of(
    changes: DataFrame,
    target: Target,
    as_of_ms: int,
    base: DataFrame | None = None,
    time_col: str = "commit_time",
    width: int = segments.SEGMENT_ROWS,
) -> DataFrame:
    """Target rows as they were at a point in time."""
    return apply_log(changes.where(F.col(time_col) <= as_of_ms), target, base, width)


# --- single operations on a base table ----------------------------------------


def apply_inserts(base: DataFrame, changes: DataFrame, target: Target) -> DataFrame:
    """Base plus the first INSERT of each key it lacks."""
    rows = _with_base(_effective(changes.where("operation = 'INSERT'"), target), base, target)
    winner = rows.groupBy(*target.by).agg(F.min(F.struct("seq", *target.values)).alias("r"))
    return winner.select(*target.by, *[F.col(f"r.{c}").alias(c) for c in target.values])


def apply_updates(base: DataFrame, changes: DataFrame, target: Target) -> DataFrame:
    """Base with its UPDATEs applied in log order, where all of `old` matches the row."""
    return apply_general(changes.where("operation = 'UPDATE'"), target, base)


def apply_deletes(base: DataFrame, changes: DataFrame, target: Target) -> DataFrame:
    """Base without the rows that a DELETE's `old` matches in all its columns."""
    return apply_general(changes.where("operation = 'DELETE'"), target, base)


def apply_truncates(base: DataFrame, changes: DataFrame) -> DataFrame:
    emptied = changes.where("operation = 'TRUNCATE'").select("tbl").distinct()
    return base.join(emptied, "tbl", "left_anti")


# --- changes that depend on the rows they meet -------------------------------


def apply_general(
    changes: DataFrame,
    target: Target,
    base: DataFrame | None = None,
    width: int = segments.SEGMENT_ROWS,
    raw_log: DataFrame | None = None,
) -> DataFrame:
    """Target rows after a log that may change keys, test other columns in `old`, or name many rows.

    A *special* change does one of these.  A log without goes the set-based way, others are
    resolved row by row of the target (`identity`).  A key change onto an
    existing key violates the unique key and is an error that leaves both rows alone.  With
    `target.many_rows`, a change whose `old` lacks key columns meets all rows that match it.
    """
    log = changes if raw_log is None else raw_log
    rows = after_truncate(typed_changes(changes, target, base), log)
    # One look at the images; most logs have no special change and are not read again before they are summed up.
    if typed_changes(log, target).where("_special").isEmpty():
        return _set_based(rows, target, width)
    # Changes of many rows meet the rows that are left: what a TRUNCATE empties need not be spread over keys.
    rows = spread(cut_lineage(rows), target) if target.many_rows else rows
    return identity.resolved(cut_lineage(rows), target)


def _set_based(rows: DataFrame, target: Target, width: int) -> DataFrame:
    state = summarise(rows.select("seq", "tbl", "operation", *target.keys, *target.values), target.by, target.values, width)
    return state.where("born").select(*target.by, *[F.col(f"born_{c}").alias(c) for c in target.values])


def typed_changes(changes: DataFrame, target: Target, base: DataFrame | None = None) -> DataFrame:
    """Effective changes and the rows of `base`, with the types of the target.

    `seq`, `tbl`, `operation`, the key, the new values, `_old` (the values to test), `_to` (the
    key after a change that moves it, else NULL) and `_special`; with `target.many_rows` also
    `_wide`, whether a change names many rows, and `_tests`, all values it tests.
    """
    keys, values = target.keys, target.values
    operation = F.col("operation")
    is_update, tests = operation == "UPDATE", operation.isin("UPDATE", "DELETE")
    typed = {(image, c): F.col(image)[c].try_cast(t) for image in ("old", "new") for c, t in target.columns.items()}
    moved = F.lit(False)
    for k in keys:
        moved = moved | (typed["new", k].isNotNull() & ~typed["new", k].eqNullSafe(typed["old", k]))
    tested = F.lit(False)
    for c in values:
        tested = tested | F.col("old")[c].isNotNull()
    whole = F.lit(True)
    for k in keys:
        whole = whole & typed["old", k].isNotNull()
    to = F.struct(*[F.coalesce(typed["new", k], typed["old", k]).alias(k) for k in keys])
    rows = changes.where(apply_status(target) == "applied").select(
        "seq", "tbl", "operation",
        *[F.when(operation == "INSERT", typed["new", k]).otherwise(typed["old", k]).alias(k) for k in keys],
        *[typed["new", c].alias(c) for c in values],
        F.struct(*[F.when(tests, typed["old", c]).alias(c) for c in values]).alias("_old"),
        F.when(is_update & whole & moved, to).alias("_to"),
        ((is_update & moved) | (tests & (tested | ~whole))).alias("_special"),
        *([F.struct(*[typed["old", c].alias(c) for c in target.columns]).alias("_tests"), (tests & ~whole).alias("_wide")] if target.many_rows else []),
    )
    if base is not None:
        before = _with_base(rows.limit(0).select("seq", "tbl", "operation", *keys, *values), base, target)
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name.startswith("_")]
        rows = rows.unionByName(before.select("*", *blank).fillna(False, ["_special", *(["_wide"] if target.many_rows else [])]))
    return rows


def spread(rows: DataFrame, target: Target) -> DataFrame:
    """`typed_changes` with every change of many rows there once for each key it may meet.

    `rows` is read several times and should be a written table.
    """
    wide = rows.where("_wide").drop("_wide")
    rows = rows.where("NOT _wide").drop("_wide")
    if wide.isEmpty():
        return rows.drop("_tests")
    return rows.unionByName(identity.of_many_rows(rows, wide, target)).drop("_tests")
