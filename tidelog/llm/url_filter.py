"""URL verdicts from rules and patterns, fetched by their rarest literal token.

A rule's literal tokens are the words that a URL must hold as whole words for the rule to
fit.  Each rule is filed under the one that the fewest URLs hold.  A URL's distinct tokens
fetch its candidate rules, and only for those a regular expression runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import written


@dataclass(frozen=True)
class Rule:
    """`verdict` for `host` and all its subdomains, for paths that begin with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host and path; a host has no slash, and a path begins with one."""
        return "^([^/]*[.])?" + re.escape(self.host + self.path)

    @property
    def tokens(self) -> list[str]:
        """Words of the rule with an end of its own: the last of a path may be longer in a URL."""
        held = re.findall(r"[a-z0-9]+", self.host)
        held += re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", self.path.lower())
        if not held:
            raise ValueError(f"rule {self.name} has no literal token")
        return sorted(set(held))


@dataclass(frozen=True)
class Pattern:
    """Block URLs with all `tokens` as words of their host that match `expression`, if no rule fits."""

    tokens: tuple[str, ...]
    expression: str


#: Words of hosts that are blocked where no rule says otherwise.
BLOCKED_WORDS = ("adult", "bets", "casino", "porn", "sex", "xxx")

PATTERNS = tuple(Pattern((w,), rf"^([^/]*[^a-z0-9/])?{w}([^a-z0-9/][^/]*)?(/|\z)") for w in BLOCKED_WORDS)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    lowered = F.translate(found[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(found[1], F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], patterns: tuple[Pattern, ...] = PATTERNS, url: str = "url") -> DataFrame:
    """`page_id`, `host`, `path`, `rule` (null if none fits) and `verdict` of every row.

    Of several rules that fit, the longest wins (of equal ones the first by name).  Where none
    fits, a URL that some pattern matches is blocked and any other allowed, null and malformed
    ones included.  Rows are independent: repeated rows have equal verdicts.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    rows = written(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")))
    words = F.regexp_extract_all(F.translate(F.concat_ws("/", "host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0))
    tokens = rows.select("row", F.concat("host", "path").alias("place"), F.explode(F.array_distinct(words)).alias("token"))
    # The rules are given by the caller, as is their number; their tokens are counted over all URLs.
    filed = [(n, len(r.name), r.name, r.verdict, r.pattern, r.tokens) for n, r in enumerate(sorted(rules, key=lambda r: r.name))]
    filed += [(len(filed) + n, 0, None, "block", p.expression, sorted(p.tokens)) for n, p in enumerate(patterns)]
    schema = "number int, length int, rule string, verdict string, pattern string, tokens array<string>"
    index = spark.createDataFrame(filed, schema).select("*", F.explode("tokens").alias("token")).drop("tokens")
    held = tokens.join(index.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    index = index.join(held, "token", "left").groupBy("number", "length", "rule", "verdict", "pattern").agg(rarest["token"].alias("token"))
    fits = tokens.join(index, "token").where(F.expr("place rlike pattern"))
    best = fits.groupBy("row").agg(F.min(F.struct((-F.col("length")).alias("length"), "number", "rule", "verdict")).alias("best"))
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )
