import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import apply, identity

TARGET = apply.Target(keys=("id",), columns={"id": "bigint", "amt": "double", "kind": "string"})
SCHEMA = "seq bigint, tbl string, operation string, old map<string,string>, new map<string,string>"


def fold(changes, base=(), many_rows=False):
    """Apply a log one change at a time."""
    tables = {}
    for tbl, key, amt, kind in base:
        tables.setdefault(tbl, {})[key] = {"amt": amt, "kind": kind}
    types = {"id": int, "amt": float, "kind": str}
    for _, tbl, op, old, new in sorted(changes):
        rows = tables.setdefault(tbl, {})
        try:
            new = {c: types[c](v) for c, v in new.items()}
            old = {c: types[c](v) for c, v in old.items()}
        except (KeyError, ValueError):
            continue
        if many_rows and op in ("UPDATE", "DELETE") and old and "id" not in old and "id" not in new and (new or op == "DELETE"):
            for key in [k for k, row in rows.items() if all(row[c] == v for c, v in old.items())]:
                if op == "UPDATE":
                    rows[key] = {**rows[key], **new}
                else:
                    del rows[key]
        elif op == "INSERT" and new and "id" in new:
            rows.setdefault(new["id"], {"amt": new.get("amt"), "kind": new.get("kind")})
        elif op == "UPDATE" and old and new and "id" in old:
            row = rows.get(old["id"])
            if row is None or any(row[c] != v for c, v in old.items() if c != "id"):
                continue
            key = new.get("id", old["id"])
            if key != old["id"] and key in rows:
                continue
            del rows[old["id"]]
            rows[key] = {**row, **{c: v for c, v in new.items() if c != "id"}}
        elif op == "DELETE" and old and "id" in old:
            row = rows.get(old["id"])
            if row is not None and all(row[c] == v for c, v in old.items() if c != "id"):
                del rows[old["id"]]
        elif op == "TRUNCATE":
            rows.clear()
    return sorted((t, k, r["amt"], r["kind"]) for t, rows in tables.items() for k, r in rows.items())


def random_log(rng, n, ids=6, rekey=0.0, full=0.0, wide=0.0):
    out = []
    for seq in range(n):
        op = rng.choices(["INSERT", "UPDATE", "DELETE", "TRUNCATE", "MERGE"], [30, 50, 15, 1, 1])[0]
        key = str(rng.randrange(ids) if rng.random() < 0.6 else 0)  # key 0 is hot
        new = {"id": key, "amt": f"{rng.randint(1, 9)}.5", "kind": rng.choice("xyz")}
        new = {c: v for c, v in new.items() if c == "id" or rng.random() < 0.7}
        old = {"id": key}
        if op == "UPDATE" and rng.random() < rekey:
            new["id"] = str(rng.randrange(ids))
        if op in ("UPDATE", "DELETE") and rng.random() < full:
            old["kind"] = rng.choice("xyz")
        if op in ("UPDATE", "DELETE") and rng.random() < wide:
            old = {c: v for c, v in [("kind", rng.choice("xyz")), ("amt", f"{rng.randint(1, 9)}.50")] if rng.random() < 0.6}
            new = {c: v for c, v in new.items() if c != "id"} if rng.random() < 0.9 else new
        if rng.random() < 0.03:
            new = {}
        if rng.random() < 0.03:
            old = {}
        if rng.random() < 0.02 and new:
            new["amt"] = "n/a"
        if op == "INSERT" or op == "TRUNCATE":
            old = {}
        if op in ("DELETE", "TRUNCATE"):
            new = {}
        out.append((seq, rng.choice(["t", "t", "u"]), op, old, new))
    return out


def rows(df):
    return sorted((r.tbl, r.id, r.amt, r.kind) for r in df.collect())


def sort_key(r):
    return tuple((v is None, v) for v in r)


@pytest.mark.parametrize("seed", range(3))
def test_log_matches_fold(spark, seed):
    rng = random.Random(seed)
    log = random_log(rng, 150)
    base = [("t", 0, 1.0, "b"), ("t", 9, 2.0, None), ("u", 3, None, "b")]
    got = rows(apply.apply_log(spark.createDataFrame(log, SCHEMA), TARGET,
                               spark.createDataFrame(base, "tbl string, id bigint, amt double, kind string"), width=11))
    assert sorted(got, key=sort_key) == sorted(fold(log, base), key=sort_key)


BASE = [("t", 0, 1.0, "b"), ("t", 9, 2.0, "c"), ("u", 3, 4.0, "x")]
BASE_SCHEMA = "tbl string, id bigint, amt double, kind string"


@pytest.mark.parametrize("seed, limit", [(0, 3), (1, 3), (2, 10_000)])
def test_key_changes_match_fold(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(identity, "LIMIT", limit)  # so that chains need several segments
    monkeypatch.setattr(identity, "WIDTH", 16)
    log = random_log(random.Random(100 + seed), 150, ids=8, rekey=0.1, full=0.3)
    got = rows(apply.apply_general(spark.createDataFrame(log, SCHEMA), TARGET, spark.createDataFrame(BASE, BASE_SCHEMA), width=17))
    assert sorted(got, key=sort_key) == sorted(fold(log, BASE), key=sort_key)


def test_full_identity_matches_fold(spark, monkeypatch):
    """Every `old` is the whole row as it was, but for a few that miss; one key has most of the log."""
    monkeypatch.setattr(identity, "LIMIT", 20)
    monkeypatch.setattr(identity, "WIDTH", 32)
    rng, state, log = random.Random(5), {}, []
    for seq in range(400):
        key = 0 if rng.random() < 0.7 else rng.randrange(1, 8)
        new = {"amt": f"{rng.randint(1, 9)}.5", "kind": rng.choice("xyz")}
        if key not in state:
            state[key] = new
            log.append((seq, "t", "INSERT", {}, {"id": str(key), **new}))
            continue
        old = {"id": str(key), **state[key]}
        if rng.random() < 0.1:
            old["kind"] = "w"
        op = "DELETE" if rng.random() < 0.05 else "UPDATE"
        log.append((seq, "t", op, old, {} if op == "DELETE" else new))
        if old["kind"] != "w":
            state.pop(key)
            if op == "UPDATE":
                state[key] = new
    got = rows(apply.apply_log(spark.createDataFrame(log, SCHEMA), TARGET))
    assert got == fold(log) == sorted(("t", k, float(r["amt"]), r["kind"]) for k, r in state.items())


@pytest.mark.parametrize("seed", range(2))
def test_changes_of_many_rows_match_fold(spark, seed, monkeypatch):
    monkeypatch.setattr(identity, "LIMIT", 12)
    monkeypatch.setattr(identity, "WIDTH", 16)
    target = apply.Target(TARGET.keys, TARGET.columns, many_rows=True)
    log = random_log(random.Random(200 + seed), 150, ids=8, rekey=0.08, full=0.1, wide=0.3)
    got = rows(apply.apply_general(spark.createDataFrame(log, SCHEMA), target, spark.createDataFrame(BASE, BASE_SCHEMA), width=17))
    assert sorted(got, key=sort_key) == sorted(fold(log, BASE, many_rows=True), key=sort_key)


def test_truncated_changes_of_many_rows_meet_no_key(spark, monkeypatch):
    """What a TRUNCATE empties is not spread over the keys it met: 20 changes of 20 rows would be 400."""
    spread, of_many_rows = [], identity.of_many_rows
    monkeypatch.setattr(identity, "of_many_rows", lambda *args: spread.append(of_many_rows(*args)) or spread[-1])
    target = apply.Target(TARGET.keys, TARGET.columns, many_rows=True)
    log = [(s, "t", "INSERT", {}, {"id": str(s), "kind": "x"}) for s in range(20)]
    log += [(s, "t", "UPDATE", {"kind": "x"}, {"amt": f"{s}.5"}) for s in range(20, 40)]
    log += [(40, "t", "TRUNCATE", {}, {}), (41, "t", "INSERT", {}, {"id": "1", "kind": "x"}), (42, "t", "INSERT", {}, {"id": "7", "kind": "y"})]
    log += [(43, "t", "UPDATE", {"kind": "x"}, {"amt": "3.5"}), (44, "u", "INSERT", {}, {"id": "2", "kind": "x"})]
    got = rows(apply.apply_general(spark.createDataFrame(log, SCHEMA), target))
    assert sorted(got, key=sort_key) == sorted(fold(log, many_rows=True), key=sort_key)
    assert sum(s.where("seq BETWEEN 20 AND 43 AND operation = 'UPDATE'").count() for s in spread) == 1


def test_general_without_special_changes(spark):
    log = [(0, "t", "INSERT", {}, {"id": "1", "amt": "2"}), (1, "t", "UPDATE", {"id": "1"}, {"kind": "x"})]
    assert rows(apply.apply_general(spark.createDataFrame(log, SCHEMA), TARGET)) == [("t", 1, 2.0, "x")]


def test_single_operations(spark):
    base = spark.createDataFrame([("t", 1, 1.0, "a"), ("t", 2, 2.0, "b"), ("u", 1, 3.0, "c")], "tbl string, id bigint, amt double, kind string")
    log = spark.createDataFrame([
        (0, "t", "INSERT", {}, {"id": "1", "amt": "9"}), (1, "t", "INSERT", {}, {"id": "5", "amt": "5"}),
        (2, "t", "INSERT", {}, {"id": "5", "amt": "6"}), (3, "t", "UPDATE", {"id": "1"}, {"kind": "z"}),
        (4, "t", "UPDATE", {"id": "1"}, {"amt": "7"}), (5, "t", "UPDATE", {"id": "8"}, {"amt": "7"}),
        (6, "t", "DELETE", {"id": "2"}, {}), (7, "u", "TRUNCATE", {}, {}),
    ], SCHEMA)
    assert [r[1:3] for r in rows(apply.apply_inserts(base, log, TARGET))] == [(1, 1.0), (2, 2.0), (5, 5.0), (1, 3.0)]
    assert rows(apply.apply_updates(base, log, TARGET))[0] == ("t", 1, 7.0, "z")
    assert [r[:2] for r in rows(apply.apply_deletes(base, log, TARGET))] == [("t", 1), ("u", 1)]
    assert [r[0] for r in rows(apply.apply_truncates(base, log))] == ["t", "t"]


def test_status(spark):
    cases = [
        ("INSERT", {}, {"id": "1"}, "applied"), ("INSERT", {}, {}, "noop"), ("INSERT", {}, {"amt": "1"}, "apply_error"),
        ("INSERT", {}, {"id": "x"}, "apply_error"), ("INSERT", {}, {"id": "1", "nope": "1"}, "apply_error"),
        ("UPDATE", {}, {"id": "1"}, "noop"), ("UPDATE", {"id": "1"}, {}, "noop"), ("UPDATE", {"id": "1"}, {"amt": "x"}, "apply_error"),
        ("DELETE", {"id": "1"}, {}, "applied"), ("DELETE", {}, {}, "noop"), ("DELETE", {"kind": "x"}, {}, "apply_error"),
        ("TRUNCATE", {}, {}, "applied"), ("insert", {}, {"id": "1"}, "apply_error"), (None, {}, {}, "apply_error"),
    ]
    df = spark.createDataFrame([(i, "t", op, old, new) for i, (op, old, new, _) in enumerate(cases)], SCHEMA)
    got = [r.s for r in df.select("seq", apply.apply_status(TARGET).alias("s")).orderBy("seq").collect()]
    assert got == [c[3] for c in cases]


def test_hot_key_is_spread_over_segments(spark):
    """Every update hits one key; pieces of the first shuffle stay within the segment width."""
    log = [(0, "t", "INSERT", {}, {"id": "1", "amt": "0"})] + [(s, "t", "UPDATE", {"id": "1"}, {"amt": str(s)}) for s in range(1, 200)]
    df = spark.createDataFrame(log, SCHEMA)
    assert rows(apply.apply_log(df, TARGET, width=10)) == [("t", 1, 199.0, None)]
    pieces = apply.summarise(apply._effective(df, TARGET), ["tbl", "id"], ["amt"], 10)
    assert "_seg" in pieces._jdf.queryExecution().optimizedPlan().toString()
