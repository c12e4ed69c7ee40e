"""Changes whose effect depends on the rows they meet: guarded, key-changing, and of many rows.

A *guarded* change tests columns besides the key, a *move* changes the key, a change of *many
rows* names them by other columns.  What they do depends on what changes before them did.

* **Row identity.**  A key's changes are cut into runs at the moves assumed to succeed.  Such a
  move links the run it leaves to the one it starts; linked runs are one row's history, a
  *chain*, found by doubling pointers over the links.
* **Guards.**  A chain is folded in log order by one higher-order function over its sorted
  changes.  Long chains are cut into segments of the log, each folded from the state that the
  segments before leave under the outcomes assumed so far (`apply.pieces`), so that a hot key
  is spread over its segments.
* **Outcomes.**  A fold says which guards failed and which moves met an occupied key.  If this
  is what was assumed, the assumption is right for every change, by induction over the log.
  If not, the next round assumes what was found; the earliest wrong outcome of every row is
  right from then on.  Rows without moves whose history is one segment need no second round.
* **Many rows.**  Such a change becomes a guarded change of every key that may at some time
  hold all the values it tests: keys that such values are written to, by an equality join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.operators import apply, segments
from tidelog.session import cut_lineage

#: A chain of more changes than this is cut into segments.
LIMIT = 16_384

#: Log positions of a segment of a long chain.
WIDTH = 65_536

ARRIVE = "ARRIVE"


def resolved(rows: DataFrame, target: apply.Target, limit: int | None = None, width: int | None = None) -> DataFrame:
    """Target rows after a log.

    `rows` are what `apply.typed_changes` makes of changes past the last TRUNCATE: with
    `_old`, the values to test, `_to`, the key after a move, and `_special`; they are read several
    times and should be a written table.  `limit` and `width` replace `LIMIT` and `WIDTH`.
    """
    limit, width = limit or LIMIT, width or WIDTH
    keys, values = list(target.keys), target.values
    items = rows.select(
        "tbl", F.struct(*keys).alias("key"), "seq", "operation", F.struct(*values).alias("new"), "_old", "_to", "_special"
    )
    arriving = items.where("_to IS NOT NULL").select(
        "tbl", F.col("_to").alias("key"), "seq", F.lit(ARRIVE).alias("operation"),
        *[F.lit(None).cast(items.schema[c].dataType).alias(c) for c in ("new", "_old", "_to")], F.lit(True).alias("_special"),
    )
    items = items.unionByName(arriving)
    moving = cut_lineage(arriving.select("tbl", "key").union(items.where("_to IS NOT NULL").select("tbl", "key")).distinct())
    items = items.join(moving.withColumn("_moving", F.lit(True)), ["tbl", "key"], "left")
    items = cut_lineage(_sized(items.withColumn("_moving", F.coalesce("_moving", F.lit(False))), ["tbl", "key"], limit))

    # Most keys neither move nor are long: their histories are whole, and one fold is final.
    whole = items.where("NOT _moving AND NOT _long").select(
        "tbl", "key", F.struct("key", F.lit(0).cast("bigint").alias("run")).alias("chain"), F.lit(0).cast("bigint").alias("_seg"),
        "seq", "operation", "new", "_old", "_to", "_special", F.lit(True).alias("_hit"),
    )
    out = [_folded(whole, None, target)]
    rest = items.where("_moving OR _long").drop("_long")
    if not rest.isEmpty():
        out.append(_settled(rest, target, limit, width))
    state = reduce(DataFrame.unionByName, [o.select("tbl", "state") for o in out]).where("state.alive")
    return state.select("tbl", *[F.col(f"state.key.{k}").alias(k) for k in keys], *[F.col(f"state.row.{c}").alias(c) for c in values])


def _sized(items: DataFrame, by: list[str], limit: int) -> DataFrame:
    """`items` with `_long`: whether a group has more than `limit` of them."""
    long = items.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return items.join(long.select(*by, F.lit(True).alias("_long")), by, "left").withColumn("_long", F.coalesce("_long", F.lit(False)))


def _settled(items: DataFrame, target: apply.Target, limit: int, width: int) -> DataFrame:
    """The last state of every chain, once the outcomes found are those assumed."""
    failed = None  # (tbl, seq) of special changes that do nothing
    while True:
        assumed = items.withColumn("_hit", F.lit(True))
        if failed is not None:
            known = failed.select("tbl", "seq", F.lit(False).alias("_hit"))
            assumed = items.join(known, ["tbl", "seq"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(True)))
        chained = cut_lineage(_sized(_chains(assumed), ["tbl", "chain"], limit).withColumn(
            "_seg", F.when(F.col("_long"), segments.segment_of("seq", width)).otherwise(0).cast("bigint")
        ))
        carried = _carried(chained.where("_long"), target)
        folded = cut_lineage(_folded(chained, carried, target))
        found = folded.select("tbl", F.explode(F.concat("state.missed", "state.occupied")).alias("seq")).distinct()
        before = found.limit(0) if failed is None else failed
        differing = found.withColumn("_now", F.lit(True)).join(before.withColumn("_then", F.lit(True)), ["tbl", "seq"], "full")
        if differing.where("_now IS NULL OR _then IS NULL").isEmpty():
            return folded.groupBy("tbl", "chain").agg(F.max_by("state", "_seg").alias("state"))
        failed = found


def _chains(items: DataFrame) -> DataFrame:
    """`items` with `chain`: the first run (`key`, `run`) of the row history they belong to."""
    breaks = F.when((F.col("_to").isNotNull() | (F.col("operation") == ARRIVE)) & F.col("_hit"), 1).otherwise(0)
    items = segments.running_sum(items, ["tbl", "key"], "seq", breaks, "run").withColumn("run", F.col("run") - breaks)
    items = cut_lineage(items.withColumn("run", F.col("run").cast("bigint")))
    node = F.struct("key", "run")
    left = items.where("_to IS NOT NULL AND _hit").select("tbl", "seq", node.alias("root"))
    entered = items.where((F.col("operation") == ARRIVE) & F.col("_hit")).select(
        "tbl", "seq", F.struct("key", (F.col("run") + 1).alias("run")).alias("node")
    )
    up = entered.join(left, ["tbl", "seq"]).select("tbl", "node", "root")
    linked = up.select("tbl", F.col("node").alias("root"), F.lit(True).alias("open"))
    up = cut_lineage(up.join(linked, ["tbl", "root"], "left").select("tbl", "node", "root", F.coalesce("open", F.lit(False)).alias("open")))
    while not up.where("open").isEmpty():
        further = up.select("tbl", F.col("node").alias("root"), F.col("root").alias("next"))
        up = cut_lineage(up.join(further, ["tbl", "root"], "left").select(
            "tbl", "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")
        ))
    linked = items.withColumn("node", node).join(up.select("tbl", "node", "root"), ["tbl", "node"], "left")
    return linked.withColumn("chain", F.coalesce("root", "node")).drop("node", "root", "run")


def _carried(items: DataFrame, target: apply.Target) -> DataFrame:
    """(`tbl`, `chain`, `_seg`, `before`): the state a segment starts from, if the assumed outcomes hold."""
    values = target.values
    doing = items.where((F.col("operation") != ARRIVE) & F.col("_hit"))
    rows = doing.select(
        "tbl", "chain", "_seg", "seq", "operation", *[F.col(f"new.{c}").alias(c) for c in values], "_to"
    )
    pieces = apply.pieces(rows.drop("_to"), ["tbl", "chain"], values)
    moved = rows.where("_to IS NOT NULL").groupBy("tbl", "chain", "_seg").agg(F.max_by("_to", "seq").alias("_at"))
    # A segment that does nothing still passes a state on.
    places = items.select("tbl", "chain", "_seg").distinct()
    pieces = places.join(pieces, ["tbl", "chain", "_seg"], "left").join(moved, ["tbl", "chain", "_seg"], "left")
    so_far = W.partitionBy("tbl", "chain").orderBy("_seg").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = pieces.withColumn("_d", F.max(F.when(F.col("_del").isNotNull(), F.col("_seg"))).over(so_far))
    since = W.partitionBy("tbl", "chain", "_d").orderBy("_seg").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = pieces.withColumn("_b", F.min(F.when(F.col("_birth").isNotNull(), F.col("_seg"))).over(since))
    shown = [
        F.last(F.when(F.col("_seg") == F.col("_b"), F.col(f"_b_{c}")).when(F.col("_seg") > F.col("_b"), F.col(f"_u_{c}")), True)
        .over(since).alias(c)
        for c in values
    ]
    after = pieces.select(
        "tbl", "chain", "_seg", F.col("_b").isNotNull().alias("alive"),
        F.coalesce(F.last("_at", True).over(so_far), F.col("chain.key")).alias("key"), F.struct(*shown).alias("row"),
    )
    in_order = W.partitionBy("tbl", "chain").orderBy("_seg")
    state = F.lag(F.struct("alive", "key", "row")).over(in_order).alias("before")
    return after.select("tbl", "chain", "_seg", state).where("before IS NOT NULL")


def _folded(items: DataFrame, carried: DataFrame | None, target: apply.Target) -> DataFrame:
    """(`tbl`, `chain`, `_seg`, `state`): every segment folded in log order.

    `state` has `alive`, `key`, `row`, and the places in the log of guards and moves that
    `missed` their row and of moves that met an `occupied` key.
    """
    values = target.values
    change = F.struct("seq", "operation", "new", "_old", "_to", "_special", "_hit")
    groups = items.groupBy("tbl", "chain", "_seg").agg(F.sort_array(F.collect_list(change)).alias("items"))
    row_type = items.schema["new"].dataType
    nothing = F.struct(
        F.lit(False).alias("alive"), F.col("chain.key").alias("key"), F.struct(*[F.lit(None).cast(row_type[c].dataType).alias(c) for c in values]).alias("row")
    )
    start = nothing
    if carried is not None:
        groups = groups.join(carried, ["tbl", "chain", "_seg"], "left")
        start = F.coalesce("before", nothing)
    none = F.array().cast("array<bigint>")

    def step(state: Column, item: Column) -> Column:
        op, to = item["operation"], item["_to"]
        alive, row = state["alive"], state["row"]
        held = [item["_old"][c].isNull() | row[c].eqNullSafe(item["_old"][c]) for c in values]
        matched = reduce(lambda a, b: a & b, held, alive)
        updates = (op == "UPDATE") & matched & (to.isNull() | item["_hit"])
        born = (op == "INSERT") & ~alive
        told = lambda seqs, condition: F.when(condition, F.concat(seqs, F.array(item["seq"]))).otherwise(seqs)
        return F.struct(
            F.when(op == "INSERT", True).when((op == "DELETE") & matched, False).otherwise(alive).alias("alive"),
            F.when(updates & to.isNotNull(), to).otherwise(state["key"]).alias("key"),
            F.struct(*[
                F.when(born, item["new"][c]).when(updates, F.coalesce(item["new"][c], row[c])).otherwise(row[c]).alias(c) for c in values
            ]).alias("row"),
            told(state["missed"], item["_special"] & op.isin("UPDATE", "DELETE") & ~matched).alias("missed"),
            told(state["occupied"], (op == ARRIVE) & alive).alias("occupied"),
        )

    first = F.struct(start["alive"].alias("alive"), start["key"].alias("key"), start["row"].alias("row"), none.alias("missed"), none.alias("occupied"))
    return groups.select("tbl", "chain", "_seg", F.aggregate("items", first, step).alias("state"))


def of_many_rows(rows: DataFrame, wide: DataFrame, target: apply.Target) -> DataFrame:
    """`wide`, changes that name their rows by other columns than the whole key, as guarded changes of single keys.

    `rows` are all other changes.  A candidate is a key that all tested values are written to
    at some time, whatever the order: by a change of its own, by a move from another key, or by a
    change of many rows, so candidates are sought until there are no more.  The fold decides.
    """
    keys, columns = list(target.keys), list(target.columns)
    key = F.struct(*keys)
    entry = lambda values: F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), v.cast("string").alias("value")) for c, v in values.items()
    ])).alias("x")
    shown = {**{k: F.col(k) for k in keys}, **{c: F.col(c) for c in target.values}}
    known = ["tbl", "key", "x.column", "x.value"]
    written = rows.where("operation <> 'DELETE'").select("tbl", key.alias("key"), entry(shown)).select(*known)
    arrived = rows.where("_to IS NOT NULL").select("tbl", F.col("_to").alias("key"), entry({k: F.col(f"_to.{k}") for k in keys}))
    held = cut_lineage(written.union(arrived.select(*known)).where("value IS NOT NULL").distinct())
    moves = cut_lineage(rows.where("_to IS NOT NULL").select("tbl", key.alias("key"), F.col("_to").alias("to")).distinct())
    tests = wide.select("tbl", "seq", entry({c: F.col(f"_tests.{c}") for c in columns})).select("tbl", "seq", "x.column", "x.value")
    tests = cut_lineage(tests.where("value IS NOT NULL"))
    needed = tests.groupBy("tbl", "seq").agg(F.count(F.lit(1)).alias("needed"))
    changed = wide.where("operation = 'UPDATE'").select("tbl", "seq", entry({c: F.col(c) for c in target.values}))
    changed = cut_lineage(changed.select("tbl", "seq", "x.column", "x.value").where("value IS NOT NULL"))
    while True:
        met = tests.join(held, ["tbl", "column", "value"]).groupBy("tbl", "seq", "key").agg(F.count_distinct("column").alias("n"))
        candidates = cut_lineage(met.join(needed, ["tbl", "seq"]).where("n = needed").select("tbl", "seq", "key"))
        more = candidates.join(changed, ["tbl", "seq"]).select("tbl", "key", "column", "value")
        carried = held.where(~F.col("column").isin(*keys)).join(moves, ["tbl", "key"]).select("tbl", F.col("to").alias("key"), "column", "value")
        new = cut_lineage(more.union(carried).distinct().join(held, ["tbl", "key", "column", "value"], "left_anti"))
        if new.isEmpty():
            break
        held = cut_lineage(held.union(new))
    single = wide.drop(*keys).join(candidates, ["tbl", "seq"])
    return single.select(*[F.col(f"key.{c}").alias(c) if c in keys else F.col(c) for c in rows.columns])
