"""Replay planning: which rows a replay reads, when each is due, and how a run ended.

The archive has the columns of a partitioned log: `part`, `off` (dense and
increasing within a partition), a publish time and the change itself.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.operators import segments
from tidelog.session import cut_lineage

# Routing, validation and retry limits.
HOT_THRESHOLD_MS = 3_600_000
SPEED_RANGE = (0.1, 100.0)
TARGETS = ("grpc", "http")
SOURCES = ("hot", "archive")
MAX_RETRIES = 3
BACKOFF_CAP_S = 5.0
ERROR_TEXT_LIMIT = 1000
TERMINAL_STATES = ("completed", "failed", "cancelled")


# --- hot buffer -------------------------------------------------------------


def hot_range(df: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Entries with `start_ms <= stream_ms <= end_ms`, in id order."""
    return df.where(F.col("stream_ms").between(start_ms, end_ms)).orderBy("stream_ms", "stream_seq")


def hot_resume(df: DataFrame, checkpoint: str, end_ms: int) -> DataFrame:
    """Entries strictly after the checkpointed id `ms-seq`, up to `end_ms`, in id order."""
    ms, _, sequence = checkpoint.partition("-")
    ms, sequence = int(ms), int(sequence or 0)
    # The first condition alone reaches the scan; the second is exact.
    after = (F.col("stream_ms") >= ms) & (
        (F.col("stream_ms") > ms) | (F.col("stream_seq") > sequence)
    )
    return df.where(after & (F.col("stream_ms") <= end_ms)).orderBy("stream_ms", "stream_seq")


# --- archive ----------------------------------------------------------------


def parse_checkpoint(text: Column) -> Column:
    """`{"p": off, ...}` or `p:off` as MAP<INT,BIGINT>; any other text raises."""
    as_json = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    typed = F.map_from_entries(
        F.transform(
            F.map_entries(as_json),
            lambda e: F.struct(e["key"].cast("int").alias("key"), e["value"].cast("bigint").alias("value")),
        )
    )
    single = F.create_map(
        F.substring_index(text, ":", 1).try_cast("int"),
        F.substring(text, F.locate(":", text) + 1, F.length(text)).try_cast("bigint"),
    )
    is_json = F.trim(text).rlike(r"^\{.*\}$") & as_json.isNotNull()
    return (
        F.when(is_json, typed)
        .when(text.rlike(r"^\s*\d+\s*:\s*-?\d+\s*$"), single)
        .otherwise(F.raise_error(F.concat(F.lit("unrecognized checkpoint: "), text)).cast("map<int,bigint>"))
    )


def checkpoint_map(text: str) -> dict[int, int]:
    """A checkpoint given by the caller, as a dict (same formats as `parse_checkpoint`)."""
    try:
        return {int(p): int(o) for p, o in json.loads(text).items()}
    except (json.JSONDecodeError, AttributeError):
        part, colon, off = text.partition(":")
        if not colon:
            raise ValueError(f"unrecognized checkpoint: {text}") from None
        return {int(part): int(off)}


def saved_offset(checkpoint: Mapping[int, int]) -> Column:
    """The checkpoint's offset of a row's `part`, or NULL."""
    if not checkpoint:
        return F.lit(None).cast("bigint")
    pairs = [F.lit(int(x)) for item in checkpoint.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("part")).cast("bigint")


def archive_frontier(
    df: DataFrame, start_ms: int, checkpoint: Mapping[int, int] | None = None, time_col: str = "publish_ms"
) -> DataFrame:
    """First offset to read per partition.

    One past the checkpoint if there is one, else the first offset published at or
    after `start_ms`, else the end of the partition.
    """
    per_part = df.groupBy("part").agg(
        F.min(F.when(F.col(time_col) >= start_ms, F.col("off"))).alias("_first"),
        (F.max("off") + 1).alias("end_off"),
    )
    saved = saved_offset(checkpoint or {}) + 1
    return per_part.select("part", F.coalesce(saved, "_first", "end_off").alias("frontier"), "end_off")


def archive_bounds(
    df: DataFrame,
    start_ms: int,
    end_ms: int,
    checkpoint: Mapping[int, int] | None = None,
    time_col: str = "publish_ms",
) -> DataFrame:
    """`frontier` and `stop` per partition: the first row past `end_ms` ends its partition."""
    frontier = archive_frontier(df, start_ms, checkpoint, time_col)
    past_end = df.where(F.col(time_col) > end_ms).select("part", "off")
    stops = (
        past_end.join(frontier, "part")
        .where("off >= frontier")
        .groupBy("part")
        .agg(F.min("off").alias("_stop"))
    )
    return frontier.join(stops, "part", "left").select(
        "part", "frontier", F.coalesce("_stop", "end_off").alias("stop")
    )


def archive_range(
    df: DataFrame,
    start_ms: int,
    end_ms: int,
    checkpoint: Mapping[int, int] | None = None,
    time_col: str = "publish_ms",
    strict: bool = False,
) -> DataFrame:
    """Rows a bounded replay reads.

    Each partition runs from its frontier to its first row past `end_ms`, so a late
    row below `start_ms` behind the frontier is included and rows after the stop
    are not.  `strict` reads exactly the rows with a time in the window instead.
    """
    if strict:
        return df.where(F.col(time_col).between(start_ms, end_ms))
    # One row per partition, written once: it is read for the overall range and for the join.
    bounds = cut_lineage(archive_bounds(df, start_ms, end_ms, checkpoint, time_col).where("frontier < stop"))
    low, high = bounds.agg(F.min("frontier"), F.max("stop")).first()
    if low is None:
        return df.limit(0)
    # A plain range the scan can prune with, then the exact bound of each partition.
    pruned = df.where(F.col("off").between(low, high - 1))
    inside = (F.col("off") >= F.col("frontier")) & (F.col("off") < F.col("stop"))
    return pruned.join(bounds, "part").where(inside).drop("frontier", "stop")


def checkpoint_advance(df: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """Per job: last offset of each partition, and the last message id `partition:offset`."""
    last = df.groupBy(job, "part").agg(F.max_by("off", order).alias("off"), F.max(order).alias("_at"))
    message = F.concat_ws(":", F.col("part").cast("string"), F.col("off").cast("string"))
    return last.groupBy(job).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "off")))).alias("checkpoint"),
        F.max_by(message, "_at").alias("last_processed_id"),
    )


def window_count(df: DataFrame, start_ms: int, end_ms: int, time_col: str = "publish_ms") -> DataFrame:
    return df.where(F.col(time_col).between(start_ms, end_ms)).agg(F.count(F.lit(1)).alias("events"))


def offset_count(df: DataFrame, start_ms: int, end_ms: int, time_col: str = "publish_ms") -> DataFrame:
    """Estimate by offsets: sum over partitions of first(time >= end) - first(time >= start).

    A partition without a row at or after `end_ms` counts 0, as does an inverted one.
    """

    def first_at(ms):
        return F.min(F.when(F.col(time_col) >= ms, F.col("off")))

    per_part = df.groupBy("part").agg(first_at(start_ms).alias("a"), first_at(end_ms).alias("b"))
    span = F.coalesce(F.greatest(F.col("b") - F.col("a"), F.lit(0)), F.lit(0))
    # greatest() skips NULLs, so a missing side is tested explicitly.
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    return per_part.agg(F.coalesce(F.sum(F.when(known, span).otherwise(0)), F.lit(0)).alias("events"))


# --- requests ---------------------------------------------------------------


def route(df: DataFrame, threshold_ms: int = HOT_THRESHOLD_MS) -> DataFrame:
    """Add `source`: the pinned one, else hot iff both age and window are below the threshold."""
    recent = (F.col("now_ms") - F.col("start_ms") < threshold_ms) & (
        F.col("end_ms") - F.col("start_ms") < threshold_ms
    )
    chosen = F.when(recent, F.lit("hot")).otherwise(F.lit("archive"))
    pinned = F.col("pinned")
    unknown = F.raise_error(F.concat(F.lit("unknown replay source: "), pinned)).cast("string")
    return df.withColumn(
        "source", F.when(pinned.isNull(), chosen).when(pinned.isin(*SOURCES), pinned).otherwise(unknown)
    )


def validate(df: DataFrame) -> DataFrame:
    """Add `violations`, the list of rules a replay request breaks."""
    low, high = SPEED_RANGE
    # The messages.
    rules = [
        (~(F.col("end_ms") > F.col("start_ms")), "end_time must be after start_time"),
        (~F.col("speed").between(low, high), "speed_factor out of range"),
        (~F.col("target").isin(*TARGETS), "unknown target_type"),
    ]
    found = [F.when(F.coalesce(broken, F.lit(True)), F.lit(text)) for broken, text in rules]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def filter_tables(df: DataFrame, pattern: str | None, table: str = "tbl") -> DataFrame:
    """Rows whose table matches the regular expression of a request (none keeps all)."""
    return df if not pattern else df.where(F.col(table).rlike(pattern))


# --- pacing -----------------------------------------------------------------


def schedule(
    df: DataFrame,
    speed: Column,
    start_at_ms: int,
    jobs: list[str],
    order: str = "seq",
    time_col: str = "commit_time",
    width: int = segments.SEGMENT_ROWS,
) -> DataFrame:
    """Add `due_ms` and `release_ms` of each row in the replay of its job.

    A row is due at the start plus its distance to the first row of the job, divided
    by the speed.  Rows go out in order, so one that is already due is not held back
    and is released with the latest due time so far.
    """
    first = df.groupBy(*jobs).agg(F.min_by(time_col, order).alias("_first"))
    anchored = df.join(first, jobs)
    due = F.lit(float(start_at_ms)) + (F.col(time_col) - F.col("_first")) / speed
    rows = anchored.withColumn("due_ms", due).drop("_first")
    released = segments.running_max(
        rows, jobs, order, F.greatest("due_ms", F.lit(float(start_at_ms))), "release_ms", width
    )
    return released


def release_slots(df: DataFrame, slot_ms: int, start_at_ms: int) -> DataFrame:
    """Add `slot`: the micro-batch of `slot_ms` in which a scheduled row is released."""
    return df.withColumn("slot", F.floor((F.col("release_ms") - F.lit(start_at_ms)) / slot_ms).cast("bigint"))


# --- outcomes ---------------------------------------------------------------


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(BACKOFF_CAP_S))


def fold_retries(df: DataFrame, events: list[str], max_retries: int = MAX_RETRIES) -> DataFrame:
    """One row per event from its attempt log (`attempt`, `ok`, `dup`).

    The first attempt that succeeds or finds a duplicate decides; later ones never
    happened.  The wait is the backoff after every failed attempt but the last one made.
    An event whose log ends before it is decided (its job was stopped) is not `finished`.
    """
    allowed = max(0, max_retries) + 1
    done = F.col("ok") | F.col("dup")
    folded = (
        df.where(F.col("attempt") <= allowed)
        .groupBy(*events)
        .agg(
            F.min(F.when(done, F.struct("attempt", "ok", "dup"))).alias("_won"),
            F.max("attempt").alias("_made"),
        )
    )
    made = F.coalesce(F.col("_won.attempt"), F.col("_made"))
    waits = F.aggregate(
        F.filter(F.sequence(F.lit(1), F.lit(allowed)), lambda n: n < made),
        F.lit(0.0),
        lambda total, n: total + backoff_seconds(n),
    )
    return folded.select(
        *events,
        made.cast("int").alias("attempts"),
        F.coalesce(F.col("_won.ok"), F.lit(False)).alias("success"),
        F.coalesce(F.col("_won.dup"), F.lit(False)).alias("was_duplicate"),
        waits.alias("backoff_s"),
        (F.col("_won").isNotNull() | (F.col("_made") >= allowed)).alias("finished"),
    )


def fail_fast(df: DataFrame, failed: Column, job: str = "job_id", order: str = "seq") -> DataFrame:
    """Rows before the first failed one of their job: what was applied and may be checkpointed."""
    first_failure = df.where(failed).groupBy(job).agg(F.min(order).alias("_fail"))
    return (
        df.join(first_failure, job, "left")
        .where(F.col("_fail").isNull() | (F.col(order) < F.col("_fail")))
        .drop("_fail")
    )


def run_summary(df: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """Counters, status, progress and error of each run, from its folded events.

    The run stops at its first failed event, which is itself counted; `progress`
    counts processed events only, `handled_percent` duplicates as well.
    """
    good = F.col("success") | F.col("was_duplicate")
    first_failure = (
        df.where(~good)
        .groupBy(job)
        .agg(F.min_by(F.struct(order, "attempts"), order).alias("_fail"))
        .select(job, F.col(f"_fail.{order}").alias("_fail"), F.col("_fail.attempts").alias("_tries"))
    )
    reached = F.col("_fail").isNull() | (F.col(order) <= F.col("_fail"))

    def count(condition):
        return F.count(F.when(reached & condition, F.lit(1)))

    counted = (
        df.join(first_failure, job, "left")
        .groupBy(job)
        .agg(
            F.count(F.lit(1)).alias("total"),
            count(F.col("success") & ~F.col("was_duplicate")).alias("processed"),
            count(F.col("was_duplicate")).alias("duplicates"),
            count(~good).alias("failed"),
            F.max("_fail").alias("_fail"),
            F.max("_tries").alias("_tries"),
        )
    )
    status = F.when(F.col("_fail").isNull(), F.lit("completed")).otherwise(F.lit("failed"))
    error = F.concat(
        F.lit("Event "), F.col("_fail").cast("string"), F.lit(" failed after "),
        F.col("_tries").cast("string"), F.lit(" attempts"),
    )
    return counted.select(
        job,
        "total",
        "processed",
        "duplicates",
        "failed",
        status.alias("status"),
        percent(F.col("processed"), F.col("total")).alias("progress"),
        percent(F.col("processed") + F.col("duplicates"), F.col("total")).alias("handled_percent"),
        status.isin(*TERMINAL_STATES).alias("is_terminal"),
        F.substring(error, 1, ERROR_TEXT_LIMIT).alias("error"),
    )


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(part / total * 100, 2)).otherwise(F.lit(0.0))
