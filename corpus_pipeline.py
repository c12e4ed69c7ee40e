"""A corpus from documents: quality, repeated lines, near copies, benchmark passages, token ids.

Every stage works on what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, line_dedup, quality, queries, simhash
from tidelog.llm.steps import written
from tidelog.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of lines; documents of which nothing is left go."""
    # Any further columns wait under other names while the added ones are there.
    added = {c: c + "_of_input" for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(added)).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        own = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", own.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(added.get(c, c)).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token count and digests of ids and decoded text."""
    return queries.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("simhash_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]

#: None: SQL cannot express the classifier, the fingerprints and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    out = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, out, sf_dir)
        if n < len(STAGES):
            out = written(out)
    return out
