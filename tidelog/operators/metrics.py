"""Counters, latency histograms, percentiles, rates, and parsing of metric text pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.functions import wal
from tidelog.operators import segments

# Histogram bounds in seconds, and the levels of the two gauges.
INGEST_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
REPLAY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
BUFFER_BANDS = ((50, "green"), (80, "yellow"))
THROUGHPUT_BANDS = ((33, "green"), (66, "yellow"))
TOP_BAND = "red"
BUFFER_CAPACITY = 100_000
THROUGHPUT_MAX = 1000.0
HISTORY = 60
PERCENTILES = (0.5, 0.9, 0.99)

# Metric pages, from the public text format: a line is a name, labels in braces, and a value.
_LABEL = r'[a-zA-Z_][a-zA-Z0-9_]*[ \t]*=[ \t]*"(?:[^"\\]|\\.)*+"'
_LINE = rf"^([a-zA-Z_:][a-zA-Z0-9_:]*+)?[ \t]*(?:\{{((?:[ \t]*{_LABEL}[ \t]*,?)*+)[ \t]*\}})?[ \t]*([^ \t{{}}\"]+)$"
_LABEL_PARTS = _LABEL.replace("[a-zA-Z_][a-zA-Z0-9_]*", "([a-zA-Z_][a-zA-Z0-9_]*)", 1).replace('"(?:', '"((?:').replace('*+"', '*+)"')
FAMILY_SUFFIXES = ("_bucket", "_count", "_sum", "_total")


# --- counters and histograms ----------------------------------------------------


def counters(df: DataFrame, labels: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """One row per metric and label values: the number of rows that meet the metric's condition.

    All metrics are counted in one pass; label values that were never counted have no row.
    """
    names = list(metrics)
    counted = df.groupBy(*labels).agg(*[F.count(F.when(metrics[n], F.lit(1))).alias(n) for n in names])
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    return counted.select(*labels, F.inline(F.array(*pairs))).where("value > 0")


def histogram(df: DataFrame, labels: Sequence[str], value: str, buckets: Sequence[float]) -> DataFrame:
    """Cumulative histogram: per label values and bound `le` (last +Infinity) the count, with sum and total."""
    bounds = [*buckets, float("inf")]
    within = [F.count(F.when(F.col(value) <= F.lit(b), F.lit(1))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    one = df.groupBy(*labels).agg(*within, F.sum(value).alias("sum"), F.count(value).alias("total"))
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)]
    return one.select(*labels, "sum", "total", F.inline(F.array(*pairs)))


def percentiles(
    buckets: DataFrame,
    labels: Sequence[str],
    points: Sequence[float] = PERCENTILES,
    count: str = "count",
    unbounded: float | None = None,
) -> DataFrame:
    """Percentiles of cumulative histograms (`le`, count): one row per label values and point.

    The first bucket that holds the target share, linearly interpolated from the bucket
    below; 0 for an empty histogram.  In the last, unbounded bucket it is `unbounded`, or the
    highest finite bound if that is None.  A histogram has a dozen buckets, so its window is small.
    """
    rising = W.partitionBy(*labels).orderBy("le")
    everything = W.partitionBy(*labels)
    rows = (
        buckets.withColumn("_low", F.coalesce(F.lag("le").over(rising), F.lit(0.0)))
        .withColumn("_below", F.coalesce(F.lag(count).over(rising), F.lit(0)))
        .withColumn("_all", F.max(count).over(everything))
        .withColumn("p", F.explode(F.array(*[F.lit(p) for p in points])))
    )
    target = F.col("_all") * F.col("p")
    inside = F.col(count) - F.col("_below")
    finite = ~F.col("le").isin(float("inf"))
    value = F.when(
        finite & (inside > 0),
        F.col("_low") + (target - F.col("_below")) / inside * (F.col("le") - F.col("_low")),
    ).otherwise(F.when(finite, F.col("le")).otherwise(F.col("_low") if unbounded is None else F.lit(unbounded)))
    first = F.min_by(value, F.when(F.col(count) >= target, F.col("le")))
    return rows.groupBy(*labels, "p").agg(
        F.when(F.max("_all") > 0, first).otherwise(F.lit(0.0)).alias("value")
    )


def sampled_gauge(
    df: DataFrame, capacity: int, every: int = 100, order: str = "seq", width: int = segments.SEGMENT_ROWS
) -> DataFrame:
    """Length of the capped buffer at every 100th event."""
    counted = segments.running_count(df, [], order, "n", width).where(F.col("n") % every == 0)
    return counted.withColumn("length", F.least(F.col("n"), F.lit(capacity)))


# --- metric pages ------------------------------------------------------------------


def parse_pages(df: DataFrame, page: Sequence[str], text: str = "text") -> DataFrame:
    """Samples of metric text pages, in order (`pos`), with the latest HELP and TYPE above them.

    Comments, lines with a timestamp and lines that do not parse are skipped.  Escapes in label
    values are undone.
    """
    # A line that parses becomes its three parts, each on a line of its own; others have no line break.
    parts = lambda line: F.when(line.startswith("#"), line).otherwise(F.regexp_replace(line, _LINE, "$1\n$2\n$3"))
    trimmed = F.transform(F.split(F.col(text), "\n"), lambda raw: F.trim(raw))
    lines = df.select(*page, F.posexplode(F.transform(trimmed, parts)).alias("pos", "line"))
    part = [F.get(F.split("line", "\n"), i) for i in range(3)]

    # A comment that tells something has four words: the mark, HELP or TYPE, a name, the rest.
    words = F.split("line", "[ \\t]+", 4)
    told = lambda kind: F.when(
        (words[0] == "#") & (words[1] == kind) & (F.size(words) == 4), words[3]
    )
    above = W.partitionBy(*page).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = part[2]
    sign = F.when(found.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    bare = F.lower(F.regexp_replace(found, "^[+-]", ""))
    value = (
        F.when(bare == "nan", F.lit(float("nan")))
        .when(bare.isin("inf", "infinity"), sign * F.lit(float("inf")))
        .when(bare.rlike("^[0-9.]"), found.try_cast("double"))
    )
    lines = (
        lines.withColumn("help", F.coalesce(F.last(told("HELP"), True).over(above), F.lit("")))
        .withColumn("type", F.coalesce(F.last(told("TYPE"), True).over(above), F.lit("")))
        .where(F.col("line").contains("\n"))
        .withColumn("value", value)
        .where(F.col("value").isNotNull())
    )
    label_text = part[1]
    names = F.regexp_extract_all(label_text, F.lit(_LABEL_PARTS), F.lit(1))
    # In label values, a backslash escapes itself, a quote, and n for a new line.
    raw = F.regexp_extract_all(label_text, F.lit(_LABEL_PARTS), F.lit(2))
    values = F.transform(
        raw,
        lambda v: F.when(
            v.contains("\\"),
            F.translate(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")), "\0", "\\"),
        ).otherwise(v),
    )
    return lines.select(
        *page, "pos", part[0].alias("name"),
        wal.row_image(names, values).alias("labels"), "value", "help", "type",
    )


def read_pages(spark, path: str) -> DataFrame:
    """Metric pages from text files, one page per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page"), F.col("value").alias("text")
    )


def family_name(name: Column) -> Column:
    for suffix in FAMILY_SUFFIXES:
        name = F.regexp_replace(name, suffix + "$", "")
    return name


def families(samples: DataFrame, page: Sequence[str]) -> DataFrame:
    """Metric families of a page: help and type of their first sample, and their sample count."""
    first = F.min_by(F.struct("help", "type"), "pos")
    grouped = samples.groupBy(*page, family_name(F.col("name")).alias("family")).agg(
        first.alias("f"), F.count(F.lit(1)).alias("samples")
    )
    kind = F.when(F.col("f.type") == "", F.lit("untyped")).otherwise(F.col("f.type"))
    return grouped.select(*page, "family", F.col("f.help").alias("help"), kind.alias("type"), "samples")


def lookup(samples: DataFrame, page: Sequence[str], name: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Value of the first sample of each page with this name and these labels."""
    rows = samples.where(F.col("name") == name)
    for key, value in (labels or {}).items():
        rows = rows.where(F.col("labels")[key] == value)
    return rows.groupBy(*page).agg(F.min_by("value", "pos").alias("value"))


def by_label(samples: DataFrame, page: Sequence[str], name: str, label: str) -> DataFrame:
    """Value of the last sample of each page with this name, per non-empty value of a label."""
    rows = samples.where(F.col("name") == name).withColumn(label, F.col("labels")[label])
    rows = rows.where(F.col(label) != "")
    return rows.groupBy(*page, label).agg(F.max_by("value", "pos").alias("value"))


# --- rates ---------------------------------------------------------------------------


def rate(delta: Column, interval_ms: Column) -> Column:
    """Change per second; 0 for a counter reset or an empty interval."""
    return F.when((interval_ms <= 0) | (delta < 0), F.lit(0.0)).otherwise(delta / interval_ms * 1000)


def snapshot_rate(samples: DataFrame, series: Sequence[str], time: str = "scrape_ms") -> DataFrame:
    """Rate of each counter sample against the one before; 0 for the first.

    Samples of a series come at the pace of the scrapes, so no series outgrows the others.
    """
    w = W.partitionBy(*series).orderBy(time)
    delta, interval = F.col("value") - F.lag("value").over(w), F.col(time) - F.lag(time).over(w)
    return samples.withColumn("rate", F.coalesce(rate(delta, interval), F.lit(0.0)))


def range_rate(
    samples: DataFrame, series: Sequence[str], range_ms: int, step_ms: int, time: str = "scrape_ms"
) -> DataFrame:
    """Rate per second over the trailing `range_ms`, at every multiple of `step_ms` (`eval_ms`).

    The increase is the sum of the changes between consecutive samples in
    (eval - range, eval], where a drop means a restart from 0, over the time between the
    first and the last of them.  A range with fewer than two samples has no rate.
    """
    risen = _range_rise(samples, series, range_ms, step_ms, time)
    return risen.select(*series, "eval_ms", (F.col("rise") / (F.col("span_ms") / 1000)).alias("rate"))


def _range_rise(
    samples: DataFrame, series: Sequence[str], range_ms: int, step_ms: int, time: str = "scrape_ms"
) -> DataFrame:
    """What `range_rate` divides: `rise` over `span_ms`."""
    w = W.partitionBy(*series).orderBy(time)
    before, at = F.lag("value").over(w), F.lag(time).over(w)
    rise = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    changes = samples.withColumn("_rise", rise).withColumn("_from", at).where(F.col("_from").isNotNull())
    step = F.lit(int(step_ms))
    # Evaluation times whose range holds both samples of the change.
    first = F.ceil(F.col(time) / step) * step
    last = F.ceil((F.col("_from") + range_ms) / step) * step - step
    # All changes of a step go into the same ranges, so they are summed up before they are spread.
    sums = [F.sum("_rise").alias("_rise"), F.max(time).alias("_to"), F.min("_from").alias("_from")]
    steps = changes.groupBy(*series, first.alias("_first"), last.alias("_last")).agg(*sums).where("_last >= _first")
    evals = F.sequence("_first", "_last", step.cast("bigint"))
    return steps.withColumn("eval_ms", F.explode(evals)).groupBy(*series, "eval_ms").agg(
        F.sum("_rise").alias("rise"), (F.max("_to") - F.min("_from")).alias("span_ms")
    )


def quantile_over_rate(
    bucket_samples: DataFrame,
    series: Sequence[str],
    range_ms: int,
    step_ms: int,
    points: Sequence[float] = PERCENTILES,
) -> DataFrame:
    """Percentiles of a histogram over the trailing range: bucket rates summed by bound over all series.

    A series' rate is rounded to a whole number of 10**-9 per second.  Sums of whole numbers
    don't depend on their order, and buckets stay cumulative, so a share that meets a bound
    exactly does so in every run.
    """
    risen = _range_rise(bucket_samples, [*series, "le"], range_ms, step_ms)
    whole = F.expr(
        "(cast(rise AS DECIMAL(20, 0)) * cast(1000000000000 AS DECIMAL(13, 0)) + cast(span_ms div 2 AS DECIMAL(20, 0)))"
        " div cast(span_ms AS DECIMAL(20, 0))"
    )
    summed = risen.withColumn("rate", whole).groupBy("eval_ms", "le").agg(F.sum("rate").alias("count"))
    return percentiles(summed, ["eval_ms"], points)


# --- dashboard -------------------------------------------------------------------------


def snapshots(samples: DataFrame, time: str = "scrape_ms", history: int = HISTORY) -> DataFrame:
    """The newest `history` scrapes, one row each: counters summed over series, and their rates.

    `samples` has `metric`, `operation`, `value`; ingested events are also given by operation.
    """

    def total(metric, operation=None):
        hit = F.col("metric") == metric
        if operation:
            hit = hit & (F.col("operation") == operation)
        return F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0))

    wide = samples.groupBy(time).agg(
        *[total(m).alias(m) for m in ("ingested", "replayed", "failed")],
        *[total("ingested", op).alias(f"ingested_{op.lower()}") for op in wal.OPERATIONS],
    )
    newest = wide.orderBy(F.desc(time)).limit(history + 1)
    w = W.orderBy(time)  # history + 1 rows
    rates = [
        F.coalesce(rate(F.col(m) - F.lag(m).over(w), F.col(time) - F.lag(time).over(w)), F.lit(0.0)).alias(f"{m}_rate")
        for m in ("ingested", "replayed")
    ]
    return newest.select("*", *rates).orderBy(F.desc(time)).limit(history)


def replay_shares(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Per outcome its count and share in percent, and the failure rate of the whole."""
    names = ("applied", "duplicate_skipped", "failed")
    counts = df.agg(*[F.count(F.when(F.col(outcome) == n, F.lit(1))).alias(n) for n in names])
    total = sum((F.col(n) for n in names), F.lit(0))
    tried = F.col("applied") + F.col("failed")
    pairs = [F.struct(F.lit(n).alias("outcome"), F.col(n).alias("events")) for n in names]
    return (
        counts.withColumn("_total", total)
        .withColumn("failure_rate", F.when(tried > 0, F.round(F.col("failed") / tried * 100, 3)).otherwise(0.0))
        .select("_total", "failure_rate", F.inline(F.array(*pairs)))
        .withColumn("share", F.when(F.col("_total") > 0, F.round(F.col("events") / F.col("_total") * 100, 1)).otherwise(0.0))
        .select("outcome", "events", "share", "failure_rate")
    )


def utilisation(value: Column, maximum: float) -> Column:
    return F.least(value / F.lit(float(maximum)) * 100, F.lit(100.0))


def band(percent: Column, bands) -> Column:
    out = F.when(F.lit(False), F.lit(TOP_BAND))
    for below, name in bands:
        out = out.when(percent < below, F.lit(name))
    return out.otherwise(F.lit(TOP_BAND))


def consumer_lag(archive: DataFrame, checkpoint: DataFrame, threshold: int = 10_000) -> DataFrame:
    """Unread messages per partition: its end minus the offset after the checkpoint (0 if none)."""
    ends = archive.groupBy("part").agg((F.max("off") + 1).alias("end_off"))
    lag = F.col("end_off") - F.coalesce(F.col("checkpoint_off") + 1, F.lit(0))
    return (
        ends.join(checkpoint, "part", "left")
        .select("part", lag.alias("lag"))
        .withColumn("critical", F.col("lag") > threshold)
    )
