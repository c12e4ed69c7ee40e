"""Raw log payloads and JSON envelopes to change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions import wal
from tidelog.operators import wire
from tidelog.schemas import CHANGE_FIELDS, ENVELOPE_DDL, PAYLOAD_DDL


def parse_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `doc` (the parsed payload) and `bad` (the text was not valid JSON)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("doc", F.from_json(F.col(payload), PAYLOAD_DDL, options))
    bad = F.col(payload).isNull() | F.col("doc._corrupt").isNotNull()
    return parsed.withColumn("bad", bad)


def quarantine(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads that cannot be decoded, with their error type."""
    return (
        parse_payloads(df, payload)
        .where("bad")
        .drop("doc", "bad")
        .withColumn("error_type", F.lit("json_parse"))
    )


def _changes_of(doc: str) -> Column:
    """The `change` array; a payload without one is itself a change if its operation is a row change.

    NULL for a corrupt payload, so that exploding drops it without a filter, which would parse twice.
    """
    fields = [
        "kind", "action", "schema", "table", "columns",
        "columnnames", "columnvalues", "identity", "oldkeys",
    ]
    corrupt = F.col(f"{doc}._corrupt").isNotNull()
    top = F.array(F.struct(*[F.col(f"{doc}.{f}").alias(f) for f in fields]))
    operation = wal.operation_name(F.col(f"{doc}.kind"), F.col(f"{doc}.action"))
    none = F.lit(None).cast(f"array<struct<{CHANGE_FIELDS}>>")
    return F.when(corrupt, none).when(F.col(f"{doc}.change").isNotNull(), F.col(f"{doc}.change")).when(
        operation.isin(*wal.OPERATIONS), top
    )


def _image(pairs: Column, names: Column, values: Column) -> Column:
    return (
        F.when(pairs.isNotNull(), wal.image_from_entries(wal.pair_list(pairs)))
        .when(names.isNotNull() & values.isNotNull(), wal.row_image(names, values))
        .otherwise(wal.empty_image())
    )


def decode_payloads(
    df: DataFrame, payload: str = "payload", lsn: str = "lsn", ingest_ms: str = "ingest_ms"
) -> DataFrame:
    """One row per change, in payload order (`change_idx`).  Undecodable payloads give no rows.

    The commit time falls back to `ingest_ms` (with `commit_time_missing` set) when
    the payload has none that can be read.
    """
    good = parse_payloads(df, payload)
    stamp = wal.commit_ms(F.col("doc.timestamp"))
    changes = good.select(
        F.col(lsn).cast("string").alias("lsn"),
        F.coalesce(stamp, F.col(ingest_ms)).alias("commit_time"),
        stamp.isNull().alias("commit_time_missing"),
        F.posexplode(_changes_of("doc")).alias("change_idx", "c"),
    )
    return changes.select(
        "lsn",
        wal.lsn_number(F.col("lsn")).alias("lsn_num"),
        "change_idx",
        "commit_time",
        "commit_time_missing",
        wal.qualified_table(F.col("c.schema"), F.col("c.table")).alias("tbl"),
        wal.operation_name(F.col("c.kind"), F.col("c.action")).alias("operation"),
        _image(F.col("c.identity"), F.col("c.oldkeys.keynames"), F.col("c.oldkeys.keyvalues")).alias("old"),
        _image(F.col("c.columns"), F.col("c.columnnames"), F.col("c.columnvalues")).alias("new"),
    )


def capture_filter(df: DataFrame, globs: str | list[str] = "public.*", table: str = "tbl") -> DataFrame:
    """Keep the tables matching any of the `schema.table` globs."""
    return df.where(F.col(table).rlike(wal.glob_regex(globs)))


def _parsed_envelopes(df: DataFrame, envelope: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("e", F.from_json(F.col(envelope), f"{ENVELOPE_DDL}, _corrupt STRING", options))
    return parsed.withColumn("bad", F.col("e").isNull() | F.col("e._corrupt").isNotNull())


def quarantine_envelopes(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    """Stored envelopes that cannot be decoded, with their error type."""
    bad = _parsed_envelopes(df, envelope).where("bad").drop("e", "bad")
    return bad.withColumn("error_type", F.lit("parse_error"))


def decode_envelopes(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    """JSON envelopes to change records.

    Unknown fields are ignored; an absent field becomes "", 0 or an empty map; an
    empty operation means INSERT.  Envelopes that are NULL or no JSON are left out: they are
    what `quarantine_envelopes` returns.
    """
    return _with_defaults(_parsed_envelopes(df, envelope), df, envelope)


def _with_defaults(parsed: DataFrame, df: DataFrame, envelope: str) -> DataFrame:
    e = parsed.where("NOT bad")
    operation = F.coalesce(F.col("e.operation"), F.lit(""))
    return e.select(
        F.coalesce("e.lsn", F.lit("")).alias("lsn"),
        F.coalesce("e.commit_time", F.lit(0)).cast("bigint").alias("commit_time"),
        F.coalesce("e.table", F.lit("")).alias("tbl"),
        F.when(operation == "", F.lit("INSERT")).otherwise(operation).alias("operation"),
        F.coalesce("e.old", wal.empty_image()).alias("old"),
        F.coalesce("e.new", wal.empty_image()).alias("new"),
        *[c for c in df.columns if c != envelope],
    )


def decode_binary_envelopes(df: DataFrame, value: str = "value") -> DataFrame:
    """Binary envelopes to change records, with the defaults of `decode_envelopes`.

    Unknown fields are skipped, the last of repeated fields and map keys counts.  Envelopes that
    are NULL, cut off or no UTF-8 are left out: they are what `quarantine_binary_envelopes` returns.
    """
    return _with_defaults(wire.parsed(df, value), df, value)


def quarantine_binary_envelopes(df: DataFrame, value: str = "value") -> DataFrame:
    """Stored binary envelopes that cannot be decoded, with their error type."""
    bad = wire.parsed(df, value).where("bad").drop("e", "bad")
    return bad.withColumn("error_type", F.lit("parse_error"))
