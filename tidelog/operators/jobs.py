"""Queries over the replay-job table, and the lifecycle of jobs as a fold over commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.operators import segments

# Job states and the commands each state accepts.
STATES = ("pending", "queued", "running", "paused", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("queued", "running")
ABSENT = "deleted"
TRANSITIONS = {
    "start": {"pending": "queued"},
    "acquire": {"queued": "running"},
    "pause": {"running": "paused"},
    "resume": {"paused": "queued"},
    "cancel": {"pending": "cancelled", "queued": "cancelled", "running": "cancelled", "paused": "cancelled"},
    "complete": {"running": "completed"},
    "fail": {"running": "failed"},
    "delete": {"completed": ABSENT, "failed": ABSENT, "cancelled": ABSENT},
    "set_speed": {"running": "running", "paused": "paused", "pending": "pending"},
}
CLEARS_LEASE = ("pause", "cancel")


def page(df: DataFrame, status: str | None, number: int = 1, size: int = 20) -> DataFrame:
    """One page of jobs, newest first, with the total and the number of pages."""
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("page starts at 1 and page_size is 1 to 100")
    rows = df if status is None else df.where(F.col("status") == status)
    total = rows.agg(F.count(F.lit(1))).scalar()
    top = rows.orderBy(F.desc("created_ms"), F.desc("job_id")).offset((number - 1) * size).limit(size)
    return top.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / size).cast("bigint"))


def page_after(df: DataFrame, status: str | None, created_ms: int, job_id: int, size: int = 20) -> DataFrame:
    """The page behind a job, newest first: the cost of a deep page is that of the first.

    The plain condition on the time reaches the scan; the whole one settles jobs of one instant.
    """
    if not 1 <= size <= 100:
        raise ValueError("page_size is 1 to 100")
    rows = df if status is None else df.where(F.col("status") == status)
    created = F.col("created_ms")
    behind = (created <= created_ms) & ((created < created_ms) | (F.col("job_id") < job_id))
    return rows.where(behind).orderBy(F.desc("created_ms"), F.desc("job_id")).limit(size)


def active_counts(df: DataFrame) -> DataFrame:
    """Jobs per active state, with a zero for a state without jobs."""
    counts = [F.count(F.when(F.col("status") == s, F.lit(1))).alias(s) for s in ACTIVE]
    one = df.where(F.col("status").isin(*ACTIVE)).agg(*counts)
    pairs = [F.struct(F.lit(s).alias("state"), F.col(s).alias("jobs")) for s in ACTIVE]
    return one.select(F.inline(F.array(*pairs)))


def lease_expired(df: DataFrame, now_ms: int) -> DataFrame:
    lost = (F.col("status") == "running") & (F.col("lease_expires_ms") < now_ms)
    return df.where(lost).agg(F.count(F.lit(1)).alias("jobs"))


def eligible(df: DataFrame, now_ms: int) -> DataFrame:
    """Jobs a worker may take: queued and not leased, or running with a lost lease; oldest first."""
    lost = F.col("lease_expires_ms") < now_ms
    queued = (F.col("status") == "queued") & (F.col("lease_expires_ms").isNull() | lost)
    return df.where(queued | ((F.col("status") == "running") & lost)).orderBy("created_ms", "job_id")


def _after(state: str, command: str) -> str | None:
    """State after a command, or None if the state does not accept it."""
    return TRANSITIONS.get(command, {}).get(state)


def _accepted(state: Column, command: Column) -> Column:
    """The same of columns, NULL if the state does not accept it."""
    pairs = [F.lit(x) for c in TRANSITIONS for s in STATES if (after := _after(s, c)) for x in (f"{c}:{s}", after)]
    return F.try_element_at(F.create_map(*pairs), F.concat(command, F.lit(":"), state))


def _next(state: Column, command: Column) -> Column:
    return F.coalesce(_accepted(state, command), state)


def lifecycle(
    commands: DataFrame,
    job: str = "job_id",
    order: str = "seq",
    width: int = 1_000_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every command with the job's state before and after it, and whether it was accepted.

    Columns named in `carry` are kept.

    An illegal command leaves the state unchanged.  Jobs start pending.

    A run of commands maps each state a job may be in to the state it ends in, and such
    maps can be joined.  So a job whose commands lie in several segments of the log is first
    folded from all states at once, per segment; the few maps of a job give the state each
    segment starts in.  A fold per segment then marks its commands.  A job with a third of all
    commands is thereby spread over all its segments.
    """
    item = F.struct(F.col(order), F.col("command"), *[F.col(c) for c in carry])
    rows = commands.withColumn("_seg", segments.segment_of(order, width))
    listed = rows.groupBy(job, "_seg").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    marked = listed.join(_entries(rows, job, order), [job, "_seg"], "left")
    before = _states_before("_items", F.coalesce("_entry", F.lit("pending")))
    zipped = F.arrays_zip(F.col("_items").alias("i"), before.alias("before"))
    out = marked.select(job, F.explode(zipped).alias("_x"))
    after = _accepted(F.col("_x.before"), F.col("_x.i.command"))
    return out.select(
        job, F.col(f"_x.i.{order}").alias(order), F.col("_x.i.command").alias("command"), F.col("_x.before").alias("before"),
        F.coalesce(after, F.col("_x.before")).alias("after"), after.isNotNull().alias("accepted"),
        *[F.col(f"_x.i.{c}").alias(c) for c in carry],
    )


def _states_before(items: str, entry: Column, chunk: int = 64) -> Column:
    """The state before each of the sorted commands, as an array.

    Appending copies what is there, so commands are taken in chunks, and the chunks appended.
    """
    chunks = F.transform(
        F.sequence(F.lit(0), ((F.size(items) - 1) / chunk).cast("int")), lambda i: F.slice(items, i * chunk + 1, chunk)
    )

    def one(state: Column, i: Column) -> Column:
        return F.struct(_next(state["now"], i["command"]).alias("now"), F.concat(state["seen"], F.array(state["now"])).alias("seen"))

    def several(state: Column, part: Column) -> Column:
        start = F.struct(state["now"].alias("now"), F.array().cast("array<string>").alias("seen"))
        ended = F.aggregate(part, start, one)
        # The struct once, then its parts.
        return F.element_at(F.transform(F.array(ended), lambda e: F.struct(
            e["now"].alias("now"), F.concat(state["seen"], F.array(e["seen"])).alias("seen")
        )), 1)

    start = F.struct(entry.alias("now"), F.array().cast("array<array<string>>").alias("seen"))
    return F.flatten(F.aggregate(chunks, start, several)["seen"])


def _entries(rows: DataFrame, job: str, order: str) -> DataFrame:
    """(`job`, `_seg`, `_entry`): the state a segment starts in, of jobs with several segments."""
    states = [*STATES, ABSENT]
    spread = rows.groupBy(job).agg(F.min("_seg").alias("_first"), F.max("_seg").alias("_last")).where("_first < _last")
    parts = rows.join(spread.select(job), job, "left_semi").groupBy(job, "_seg").agg(
        F.sort_array(F.collect_list(F.struct(order, "command"))).alias("_items")
    )
    ends = F.aggregate(
        "_items", F.array(*[F.lit(s) for s in states]), lambda now, i: F.transform(now, lambda s: _next(s, i["command"]))
    )
    maps = parts.select(job, "_seg", F.map_from_arrays(F.array(*[F.lit(s) for s in states]), ends).alias("_ends"))
    before = F.collect_list("_ends").over(W.partitionBy(job).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1))
    return maps.withColumn("_before", before).select(
        job, "_seg", F.aggregate("_before", F.lit("pending"), lambda s, m: m[s]).alias("_entry")
    )


def lifecycle_state(marked: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """Per job: final state, counts, completion time, and whether its lease is cleared.

    `marked` is a lifecycle that carries `ts_ms`.
    """
    accepted = F.col("accepted")
    last = F.max_by("command", F.when(accepted, F.col(order)))
    return marked.groupBy(job).agg(
        F.max_by("after", order).alias("state"),
        F.count(F.when(accepted, F.lit(1))).alias("accepted"),
        F.count(F.when(~accepted, F.lit(1))).alias("rejected"),
        F.max(F.when(accepted & F.col("after").isin(*TERMINAL), F.col("ts_ms"))).alias("completed_ms"),
        F.coalesce(last.isin(*CLEARS_LEASE), F.lit(False)).alias("lease_cleared"),
    )
