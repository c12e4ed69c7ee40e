"""Queries over a request log: audit rows and rate-limit admission."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidelog.operators import segments
from tidelog.operators.fold import fold_sorted
from tidelog.session import cut_lineage

# Audited methods, lifecycle actions, exempt paths.
MUTATING = ("POST", "PATCH", "PUT", "DELETE")
LIFECYCLE_ACTIONS = ("start", "pause", "resume", "cancel")
EXEMPT = ("/api/v1/health", "/metrics")

PIECE_MS = 4 * 3_600_000


def _segments(path: Column) -> Column:
    """Path segments without a leading `api/vN`."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    versioned = (F.size(parts) >= 2) & (F.get(parts, 0) == "api") & F.get(parts, 1).startswith("v")
    return F.when(versioned, F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)


def resource_type(path: Column) -> Column:
    head = F.get(_segments(path), 0)
    return F.when(head.isNull(), F.lit("unknown")).when(head == "jobs", F.lit("replay_job")).otherwise(head)


def resource_id(path: Column) -> Column:
    return F.when(resource_type(path) != "auth", F.get(_segments(path), 1))


def action(method: Column, path: Column) -> Column:
    parts, kind = _segments(path), resource_type(path)
    tail = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lower(method))
    verb = (
        F.when((method == "POST") & resource_id(path).isNotNull() & tail.isin(*LIFECYCLE_ACTIONS), tail)
        .when((method == "POST") & (kind == "auth"), tail)
        .when(method == "POST", F.lit("create"))
        .when(method.isin("PATCH", "PUT"), F.lit("update"))
        .when(method == "DELETE", F.lit("delete"))
        .otherwise(F.lower(method))
    )
    return F.concat_ws(".", kind, verb)


def audit_log(df: DataFrame) -> DataFrame:
    """One audit row per mutating request."""
    path, method = F.col("path"), F.col("method")
    return df.where(method.isin(*MUTATING)).select(
        "seq",
        F.col("ts_ms").alias("timestamp_ms"),
        "username",
        action(method, path).alias("action"),
        resource_type(path).alias("resource_type"),
        resource_id(path).alias("resource_id"),
        F.col("ip").alias("ip_address"),
        "method",
        "path",
        "status_code",
    )


def rate_limit(
    df: DataFrame,
    capacity: int = 100,
    refill_per_s: float = 10.0,
    client: str = "ip",
    time: str = "ts_ms",
    order: str = "seq",
    piece_ms: int = PIECE_MS,
) -> DataFrame:
    """Every limited request with `allowed` and `remaining` under a token bucket per client.

    A bucket starts full, refills continuously up to `capacity`, and a request takes one
    token if there is one.  Tokens are counted in whole units such that a millisecond
    refills a whole number of them, so the arithmetic is exact.

    Only the number of requests per (client, ms) matters, so they are counted first.  An
    idle time that fills any bucket starts a session, which can be folded by itself.  A
    session longer than `piece_ms` is cut into pieces: what a piece does to every possible
    fill level is computed piece by piece in parallel, a pass over these tables gives the
    level each piece starts with, and then all pieces are folded.
    """
    per_ms = Fraction(str(refill_per_s)) / 1000
    cost, refill = per_ms.denominator, per_ms.numerator
    full = capacity * cost

    limited = df.withColumn(client, F.coalesce(client, F.lit("unknown")))
    for prefix in EXEMPT:
        limited = limited.where(~F.coalesce("path", F.lit("")).startswith(prefix))
    # Both are written once, as every step below reads them more than once.
    ticks = cut_lineage(limited.groupBy(client, time).agg(F.count(F.lit(1)).alias("n")))
    ticks = segments.previous(ticks, [client], time, F.col(time), "_before")
    opens = F.col("_before").isNull() | ((F.col(time) - F.col("_before")) * refill >= full)
    ticks = segments.running_max(ticks, [client], time, F.when(opens, F.col(time)), "_session")
    piece = F.expr(f"(`{time}` - _session) div {int(piece_ms)}L")
    ticks = cut_lineage(ticks.select(client, time, "n", "_session", piece.alias("_piece")))
    group = [client, "_session", "_piece"]

    client_type = df.schema[client].dataType
    key_fields = [T.StructField(client, client_type), T.StructField("_session", T.LongType())]
    piece_field = T.StructField("_piece", T.LongType())

    def place(row):
        return {c: row[c] for c in group}

    def all_levels(row, state):
        """Run the piece from every fill level, merging levels that have become equal."""
        if state is None:
            levels = np.arange(full + 1)
            state = {**place(row), "at": row[time], "now": levels, "which": levels, "steps": 0}
        now = np.minimum(full, state["now"] + (row[time] - state["at"]) * refill)
        now = now - np.minimum(row["n"], now // cost) * cost
        steps, which = state["steps"] + 1, state["which"]
        if steps % 32 == 1 and len(now) > 1:
            now, index = np.unique(now, return_inverse=True)
            which = index[which]
        return {**state, "at": row[time], "now": now, "which": which, "steps": steps}, ()

    def table(state):
        ends = state["now"][state["which"]].tolist()
        return [{**{c: state[c] for c in group}, "ends": ends, "last": state["at"]}]

    def level_at(row, state):
        """`state` is the level after the piece before, and when it was reached."""
        level, at = state or (full, None)
        line = {**place(row), "_level": level, "_at": at}
        # A table is entered at the first request of its piece, with the refill until then.
        if at is not None:
            level = min(full, level + (row["first"] - at) * refill)
        return (row["ends"][level], row["last"]), [line]

    def admit(row, state):
        if state is None:
            state = (full, row[time]) if row["_at"] is None else (row["_level"], row["_at"])
        level, at = state
        level = min(full, level + (row[time] - at) * refill)
        allowed = min(row["n"], level // cost)
        line = {client: row[client], time: row[time], "_level": level, "_allowed": allowed}
        return (level - allowed * cost, row[time]), [line]

    long = ticks.where("_piece > 0").select(client, "_session").distinct()
    cut = ticks.join(long, [client, "_session"], "left_semi")
    tables = fold_sorted(
        cut, group, time, all_levels,
        T.StructType([*key_fields, piece_field, T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("last", T.LongType())]),
        finish=table,
    )
    firsts = cut.groupBy(*group).agg(F.min(time).alias("first"))
    levels = fold_sorted(
        tables.join(firsts, group), [client, "_session"], "_piece", level_at,
        T.StructType([*key_fields, piece_field, T.StructField("_level", T.LongType()), T.StructField("_at", T.LongType())]),
    )
    admitted = fold_sorted(
        ticks.join(levels, group, "left"), group, time, admit,
        T.StructType([
            T.StructField(client, client_type), T.StructField(time, T.LongType()),
            T.StructField("_level", T.LongType()), T.StructField("_allowed", T.LongType()),
        ]),
    )
    ranked = segments.running_count(limited, [client, time], order, "_rank")
    allowed = F.col("_rank") <= F.col("_allowed")
    remaining = F.when(allowed, F.floor((F.col("_level") - F.col("_rank") * cost) / cost)).otherwise(F.lit(0))
    return (
        ranked.join(admitted, [client, time])
        .withColumn("allowed", allowed)
        .withColumn("remaining", remaining.cast("bigint"))
        .drop("_rank", "_level", "_allowed")
    )
