"""Idempotent delivery: ledger lookups, ledger upkeep and de-duplication by time to live.

A ledger has one row per idempotency key: `processed_at`, `job_id`, `expires_at`
(epoch ms).  An entry counts while `expires_at > now`.

Aggregates by key are combined before the shuffle, so a key with very many copies
costs one row per task.  Joins by key put the ledger on the right and rely on
adaptive execution to split a skewed left side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.operators.apply import apply_status
from tidelog.session import cut_lineage

KEY = "idempotency_key"
TTL_MS = 7 * 86_400_000


def mark_duplicates(df: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """Add `was_duplicate`: the key is in the ledger and has not expired."""
    live = ledger.where(F.col("expires_at") > now_ms).select(KEY, F.lit(True).alias("_hit"))
    return df.join(live, KEY, "left").withColumn("was_duplicate", F.coalesce("_hit", F.lit(False))).drop("_hit")


def drop_processed(df: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """Rows whose key is not live in the ledger."""
    return df.join(ledger.where(F.col("expires_at") > now_ms).select(KEY), KEY, "left_anti")


def upsert_ledger(ledger: DataFrame, applied: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """The ledger after marking `applied` (key, processed_at, job_id): the latest mark of a key wins."""
    marks = applied.select(
        KEY, "processed_at", "job_id", (F.col("processed_at") + ttl_ms).alias("expires_at")
    )
    latest = F.max(F.struct("processed_at", "job_id", "expires_at")).alias("m")
    return (
        ledger.select(KEY, "processed_at", "job_id", "expires_at")
        .unionByName(marks)
        .groupBy(KEY)
        .agg(latest)
        .select(KEY, "m.processed_at", "m.job_id", "m.expires_at")
    )


def check_and_mark(df: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """Rows that are new: the first of each key, if the ledger has no entry (expired or not)."""
    others = [c for c in df.columns if c != KEY and c not in order]
    # Row images are maps, which have no order, so only `order` is compared.
    first = df.groupBy(KEY).agg(F.min_by(F.struct(*order, *others), F.struct(*order)).alias("r"))
    return first.join(ledger.select(KEY), KEY, "left_anti").select(KEY, "r.*")


def dedup_by_ttl(
    df: DataFrame, time: str, order: str, ttl_ms: int = TTL_MS, key: str = KEY, slices: int = 1024, limit: int = 2048
) -> DataFrame:
    """The deliveries that are applied: `key`, `time` (epoch ms), `order`.

    A delivery is a duplicate iff it comes less than `ttl_ms` after the last *applied*
    one of its key; at exactly `ttl_ms` it is applied again.  Of several at one instant the
    least `order` counts.  A row without key or time is a delivery of nothing and not in the result.

    The instants of a key are walked in order by one higher-order function.  A key with more than
    `limit` of them is no task's work: there every instant points to the first one at or after
    its own expiry, and the applied ones are those the first instant leads to.  Pointers are
    doubled, so a chain of n takes log2(n) rounds, and after k rounds only instants with 2^k
    more to come are left.
    """
    # Written once: the key is computed from whole row images and is read several times.
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    instants = cut_lineage(df.where(known).groupBy(key, time).agg(F.min(order).alias(order)))
    long = cut_lineage(instants.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key))
    walked = _walk(instants.join(long, key, "left_anti"), time, order, ttl_ms, key)
    if long.isEmpty():
        return walked
    return walked.union(_follow(instants.join(long, key, "left_semi"), time, order, ttl_ms, key, slices))


def _walk(instants: DataFrame, time: str, order: str, ttl_ms: int, key: str) -> DataFrame:
    instant = F.struct(F.col(time), F.col(order))
    listed = instants.groupBy(key).agg(F.sort_array(F.collect_list(instant)).alias("_all"))

    def step(applied: Column, i: Column) -> Column:
        due = F.element_at(applied, -1)[time] + ttl_ms
        return F.when(i[time] >= due, F.concat(applied, F.array(i))).otherwise(applied)

    # A key delivered once has nothing to walk.
    chain = F.when(F.size("_all") == 1, F.col("_all")).otherwise(
        F.aggregate(F.slice("_all", 2, F.size("_all")), F.slice("_all", 1, 1), step)
    )
    return listed.select(key, F.explode(chain).alias("_x")).select(key, f"_x.{time}", f"_x.{order}")


def _follow(instants: DataFrame, time: str, order: str, ttl_ms: int, key: str, slices: int) -> DataFrame:
    jumps = cut_lineage(_next_after_expiry(instants.select(key, F.col(time).alias("_at")), ttl_ms, key, slices))
    powers = []  # pointers over 1, 2, 4, ... applied deliveries
    while not jumps.isEmpty():
        powers.append(jumps)
        rest = jumps.select(key, F.col("_from").alias("_to"), F.col("_to").alias("_end"))
        jumps = cut_lineage(jumps.join(rest, [key, "_to"]).select(key, "_from", F.col("_end").alias("_to")))
    reached = cut_lineage(instants.groupBy(key).agg(F.min(time).alias("_from")))
    for power in reversed(powers):
        reached = cut_lineage(reached.union(reached.join(power, [key, "_from"]).select(key, F.col("_to").alias("_from"))))
    return instants.join(reached.withColumnRenamed("_from", time), [key, time]).select(key, time, order)


def _next_after_expiry(instants: DataFrame, ttl_ms: int, key: str, slices: int) -> DataFrame:
    """`_from` and `_to` of a key: an instant, and the key's first one at least `ttl_ms` later.

    A key's time is cut into slices of ttl / `slices`, each looked at by itself, with the
    first instant behind the slice put at its end.  So a task holds the instants of one
    slice, or one row per slice of a key, however many deliveries the key has.
    """
    width = max(1, -(-ttl_ms // slices))
    at = F.col("_at")
    none = F.lit(None).cast("bigint")
    cut = F.floor(at / width)
    starts = instants.groupBy(key, cut.alias("_slice")).agg(F.min("_at").alias("_first"))
    # Expiries of a slice's instants fall into these two.
    asked = starts.select(
        key, F.explode(F.array(*[F.col("_slice") + ttl_ms // width + n for n in (0, 1)])).alias("_slice"), none.alias("_first")
    )
    later = W.partitionBy(key).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    behind = (
        starts.union(asked).groupBy(key, "_slice").agg(F.min("_first").alias("_first"))
        .select(key, "_slice", F.min("_first").over(later).alias("_at"), none.alias("_from"))
        .where("_at IS NOT NULL")
    )
    there = instants.select(key, cut.alias("_slice"), "_at", none.alias("_from"))
    expiries = instants.select(key, at.alias("_from"), (at + ttl_ms).alias("_at")).select(key, cut.alias("_slice"), "_at", "_from")
    # From the end of the slice back, with all rows of an instant at once.
    back = W.partitionBy(key, "_slice").orderBy(F.desc("_at"))
    found = F.min(F.when(F.col("_from").isNull(), at)).over(back)
    rows = there.unionByName(behind).unionByName(expiries).withColumn("_to", found)
    return rows.where("_from IS NOT NULL AND _to IS NOT NULL").select(key, "_from", "_to")


def drop_expired(ledger: DataFrame, now_ms: int) -> DataFrame:
    """The ledger without entries that expired before now."""
    return ledger.where(~(F.col("expires_at") < now_ms))


def cleanup_counts(ledger: DataFrame, now_ms: int) -> DataFrame:
    expired = F.col("expires_at") < now_ms
    return ledger.agg(
        F.count(F.when(~expired, F.lit(1))).alias("kept"), F.count(F.when(expired, F.lit(1))).alias("removed")
    )


def classify(
    df: DataFrame, ledger: DataFrame, now_ms: int, lookup_failed: Column | None = None
) -> DataFrame:
    """Add `outcome` and `error_type` of each delivery.

    In the order of processing: no key can be built -> unknown; the ledger cannot be
    read (`lookup_failed`) -> dedup_error; key is live -> duplicate_skipped; the change
    cannot be applied -> apply_error; else applied.
    """
    marked = mark_duplicates(df, ledger, now_ms)
    lookup_failed = F.lit(False) if lookup_failed is None else lookup_failed
    error = (
        F.when(F.col(KEY).isNull(), F.lit("unknown"))
        .when(lookup_failed, F.lit("dedup_error"))
        .when(F.col("was_duplicate"), F.lit(None).cast("string"))
        .when(apply_status() == "apply_error", F.lit("apply_error"))
    )
    outcome = F.when(F.col("error_type").isNotNull(), F.lit("failed")).otherwise(
        F.when(F.col("was_duplicate"), F.lit("duplicate_skipped")).otherwise(F.lit("applied"))
    )
    return marked.withColumn("error_type", error).withColumn("outcome", outcome)
