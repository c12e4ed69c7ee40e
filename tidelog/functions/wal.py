"""Column expressions that normalise the fields of a change-log payload."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Operation codes of the log format.
OPERATION_CODES = {"I": "INSERT", "U": "UPDATE", "D": "DELETE", "T": "TRUNCATE"}
OPERATIONS = ("INSERT", "UPDATE", "DELETE", "TRUNCATE")
DEFAULT_SCHEMA = "public"
DEFAULT_TABLE = "unknown"

_OFFSET = r"(?:[Zz]|[+-]\d{1,2}(?::?\d{2})?)$"


def operation_name(kind: Column, action: Column) -> Column:
    """Operation name; `kind` wins over `action`; unknown codes pass through unchanged."""
    raw = F.coalesce(kind, action, F.lit(""))
    upper = F.upper(raw)
    out = F.when(upper.isin(*OPERATIONS), upper)
    for code, name in OPERATION_CODES.items():
        out = out.when(upper == code, F.lit(name))
    return out.otherwise(raw)


def qualified_table(schema: Column, table: Column) -> Column:
    return F.concat_ws(
        ".", F.coalesce(schema, F.lit(DEFAULT_SCHEMA)), F.coalesce(table, F.lit(DEFAULT_TABLE))
    )


def commit_ms(text: Column) -> Column:
    """Epoch milliseconds of a timestamp text, honouring its offset (none means UTC); NULL if bad."""
    stamp = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    zoned = F.when(F.substring_index(stamp, "T", -1).rlike(_OFFSET), stamp).otherwise(
        F.concat(stamp, F.lit("+00:00"))
    )
    date = r"^\d{4}-\d{2}-\d{2}"
    midnight = F.concat(stamp, F.lit("T00:00:00+00:00"))
    return F.unix_millis(
        F.when(stamp.rlike(date + r"T\d"), zoned.try_cast("timestamp")).when(
            stamp.rlike(date + "$"), midnight.try_cast("timestamp")
        )
    )


def lsn_number(lsn: Column) -> Column:
    """Unsigned 64-bit log position as DECIMAL(20,0), from decimal or `hi/lo` hex text."""
    high = F.conv(F.substring_index(lsn, "/", 1), 16, 10).try_cast("decimal(20,0)")
    low = F.conv(F.substring_index(lsn, "/", -1), 16, 10).try_cast("decimal(20,0)")
    return F.when(
        lsn.contains("/"), (high * F.lit(4294967296).cast("decimal(20,0)") + low).cast("decimal(20,0)")
    ).otherwise(lsn.try_cast("decimal(20,0)"))


def row_image(names: Column, values: Column) -> Column:
    """name -> value map of a row image: NULL values dropped, a repeated name keeps its last value."""
    pairs = F.filter(
        F.arrays_zip(names.alias("k"), values.alias("v")),
        lambda e: e["k"].isNotNull() & e["v"].isNotNull(),
    )
    return image_from_entries(pairs)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def image_from_entries(pairs: Column) -> Column:
    def build(p):
        last_wins = F.filter(
            p,
            lambda e, i: ~F.exists(
                F.slice(p, i + F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda later: later["k"] == e["k"]
            ),
        )
        unique = F.size(F.array_distinct(p["k"])) == F.size(p)
        return F.map_from_entries(F.when(unique, p).otherwise(last_wins))

    return let(pairs, build)


def pair_list(pairs: Column) -> Column:
    """`[{name, type, value}]` to the entries that `image_from_entries` takes."""
    return F.filter(
        F.transform(
            pairs, lambda e: F.struct(F.coalesce(e["name"], F.lit("")).alias("k"), e["value"].alias("v"))
        ),
        lambda e: e["v"].isNotNull(),
    )


def empty_image() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def glob_regex(globs: str | list[str]) -> str:
    """One anchored regex for a comma-separated list of `schema.table` globs (`*`, `?`)."""
    items = globs.split(",") if isinstance(globs, str) else globs
    special = set(".^$+(){}|\\[]")
    parts = []
    for item in (i.strip() for i in items):
        parts.append(
            "".join(
                ".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in item
            )
        )
    return "^(?:" + "|".join(p for p in parts if p) + ")$"
