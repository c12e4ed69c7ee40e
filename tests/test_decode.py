import json

import pytest
from pyspark.sql import functions as F, types as T

from tidelog.functions import keys, wal
from tidelog.operators import decode
from tidelog.schemas import CHANGE_RECORD, SchemaMismatch, require_schema


def records(spark, *payloads):
    rows = [(str(100 + i), 5000, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "lsn string, ingest_ms bigint, payload string")
    return decode.decode_payloads(df).orderBy("lsn", "change_idx").collect()


def pairs(**values):
    return [{"name": k, "type": "text", "value": v} for k, v in values.items()]


def test_both_encodings_and_null_drop(spark):
    rows = records(
        spark,
        {"change": [
            {"action": "I", "schema": "public", "table": "users", "columns": pairs(id=1, name="a", note=None)},
            {"kind": "update", "schema": "s", "table": "t", "columnnames": ["id", "x", "y"], "columnvalues": [1, None, True],
             "oldkeys": {"keynames": ["id"], "keyvalues": [1]}},
            {"action": "D", "table": "t", "identity": pairs(id=7)},
        ]},
    )
    assert [(r.operation, r.tbl, r.new, r.old) for r in rows] == [
        ("INSERT", "public.users", {"id": "1", "name": "a"}, {}),
        ("UPDATE", "s.t", {"id": "1", "y": "true"}, {"id": "1"}),
        ("DELETE", "public.t", {}, {"id": "7"}),
    ]
    assert [r.change_idx for r in rows] == [0, 1, 2] and {r.lsn for r in rows} == {"100"}


def test_values_become_text(spark):
    (row,) = records(spark, {"change": [{"action": "I", "columns": pairs(a=1.5, b={"x": [1, 2]}, c="é", d=False, e=12345678901234567)}]})
    assert row.new == {"a": "1.5", "b": '{"x":[1,2]}', "c": "é", "d": "false", "e": "12345678901234567"}
    assert row.tbl == "public.unknown"


def test_repeated_name_keeps_last_and_short_lists_truncate(spark):
    rows = records(
        spark,
        {"change": [{"action": "I", "columns": [{"name": "a", "value": 1}, {"name": "b", "value": 2}, {"name": "a", "value": 3}]}]},
        {"change": [{"action": "I", "columnnames": ["a", "b"], "columnvalues": [1]}]},
    )
    assert rows[0].new == {"a": "3", "b": "2"}
    assert rows[1].new == {"a": "1"}


def test_kind_wins_unknown_passes_empty_gives_nothing(spark):
    rows = records(spark, {"change": [{"kind": "T", "action": "I"}, {"action": "M"}]}, {"change": []}, {}, {"action": "B"})
    assert [r.operation for r in rows] == ["TRUNCATE", "M"]


def test_top_level_change(spark):
    (row,) = records(spark, {"action": "I", "schema": "public", "table": "e", "columns": pairs(id=1), "timestamp": "2024-01-15 10:30:00.123456+00"})
    assert (row.operation, row.tbl, row.commit_time) == ("INSERT", "public.e", 1705314600123)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_commit_time(spark, zone):
    stamps = {
        "2024-01-15 10:30:00.123456+00": 1705314600123,
        "2024-01-15T10:30:00": 1705314600000,
        "2024-01-15 10:30:00Z": 1705314600000,
        "2024-01-15 10:30:00-08": 1705343400000,
        "2024-01-15T10:30:00.5+05:30": 1705294800500,
        "2024-01-15": 1705276800000,
        "yesterday": None,
        "": None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(s,) for s in stamps], "s string")
        got = {r.s: r.ms for r in df.select("s", wal.commit_ms(F.col("s")).alias("ms")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == stamps


def test_missing_time_falls_back_and_bad_rows_are_split(spark):
    rows = records(spark, {"change": [{"action": "I", "columns": pairs(id=1)}]}, '{"change": [{"action": "I"')
    assert [(r.commit_time, r.commit_time_missing) for r in rows] == [(5000, True)]
    df = spark.createDataFrame([("1", '{"a'), ("2", "{}"), ("3", None)], "lsn string, payload string")
    assert sorted(r.lsn for r in decode.quarantine(df).collect()) == ["1", "3"]


def test_lsn_number(spark):
    df = spark.createDataFrame([("16",), ("1/0",), ("FFFFFFFF/FFFFFFFF",), ("x",)], "l string")
    got = [r[0] if r[0] is None else int(r[0]) for r in df.select(wal.lsn_number(F.col("l"))).collect()]
    assert got == [16, 2**32, 2**64 - 1, None]


def test_globs(spark):
    df = spark.createDataFrame([("public.a",), ("public.ab",), ("audit.a",), ("publicxa",)], "tbl string")

    def kept(globs):
        return sorted(r.tbl for r in decode.capture_filter(df, globs).collect())

    assert kept("public.*") == ["public.a", "public.ab"]
    assert kept("public.?,audit.*") == ["audit.a", "public.a"]


def test_envelope_defaults(spark):
    df = spark.createDataFrame([('{"lsn":"1","commit_time":5,"table":"t","new_field":1}',), ("{}",)], "envelope string")
    rows = decode.decode_envelopes(df).collect()
    assert [tuple(r) for r in rows] == [("1", 5, "t", "INSERT", {}, {}), ("", 0, "", "INSERT", {}, {})]


def test_keys(spark):
    import hashlib

    row = [("7/1F0", "shop.visits", "DELETE", {"id": "9007"}, {}), ("7/2E8", "shop.basket_lines", "INSERT", {}, {"b": "x9", "a": "k3"})]
    df = spark.createDataFrame(row, "lsn string, tbl string, operation string, old map<string,string>, new map<string,string>")
    c = [F.col(x) for x in ("lsn", "tbl", "operation", "old", "new")]
    pk = [r[0] for r in df.select(keys.primary_key(*c, ["id"])).collect()]
    assert pk == ["7/1F0:shop.visits:9007", "7/2E8:shop.basket_lines:"]
    two = [r[0] for r in df.select(keys.primary_key(*c, ["a", "b"])).collect()]
    assert two[1] == "7/2E8:shop.basket_lines:k3:x9"
    content = [r[0] for r in df.select(keys.content_key(c[0], c[1], c[3], c[4])).collect()]
    for known in (["a", "b"], ["b", "id", "a", "zz"], ["a"], ["id"]):
        assert [r[0] for r in df.select(keys.content_key(c[0], c[1], c[3], c[4], known)).collect()] == content
    md5 = hashlib.md5(b"a=k3:b=x9").hexdigest()[:16]
    assert content[1] == f"7/2E8:shop.basket_lines:{md5}"


def test_schema_guard(spark):
    df = spark.createDataFrame([], CHANGE_RECORD)
    assert require_schema(df, CHANGE_RECORD) is df
    with pytest.raises(SchemaMismatch, match="commit_time: expected bigint, found nothing"):
        require_schema(df.drop("commit_time"), CHANGE_RECORD)
    with pytest.raises(SchemaMismatch, match="found int"):
        require_schema(df.withColumn("commit_time", F.lit(1)), T.StructType([CHANGE_RECORD["commit_time"]]))
