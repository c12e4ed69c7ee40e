"""Schemas of the data model and the fail-fast schema guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

_STRINGS = T.MapType(T.StringType(), T.StringType())

CHANGE_RECORD = T.StructType(
    [
        T.StructField("lsn", T.StringType()),
        T.StructField("commit_time", T.LongType()),
        T.StructField("tbl", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("old", _STRINGS),
        T.StructField("new", _STRINGS),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("processed_at", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("expires_at", T.LongType()),
    ]
)

_PAIRS = "array<struct<name string, type string, value string>>"
CHANGE_FIELDS = (
    "kind string, action string, schema string, table string, "
    f"columns {_PAIRS}, columnnames array<string>, columnvalues array<string>, "
    f"identity {_PAIRS}, oldkeys struct<keynames array<string>, keyvalues array<string>>"
)
# A payload holds either `change[]` or one change in its top-level fields.
PAYLOAD_DDL = (
    f"timestamp string, change array<struct<{CHANGE_FIELDS}>>, {CHANGE_FIELDS}, _corrupt string"
)

ENVELOPE_DDL = (
    "lsn string, commit_time bigint, table string, operation string, "
    "old map<string,string>, new map<string,string>"
)


class SchemaMismatch(ValueError):
    """A table does not have the schema this library was built against."""


def require_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return `df` unchanged if it has every expected column with its type, else fail at once."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    problems = [
        f"{f.name}: expected {f.dataType.simpleString()}, "
        f"found {actual[f.name].simpleString() if f.name in actual else 'nothing'}"
        for f in expected.fields
        if actual.get(f.name) != f.dataType
    ]
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return df
