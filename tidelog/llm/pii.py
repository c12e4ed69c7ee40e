"""Personal data by kind, and identifiers found through the contexts of known ones.

Native: DataFrame functions only.  Four kinds are found by expressions and checks.  They are
seeds: the two words before a seed are a lexical pattern, and what looks like an identifier
after the same words is an instance of it: a token (`CANDIDATE`), which may be of any kind, or
the loosened form of one kind (`LOOSE`), which takes the place of a shorter token for that kind.
Scores spread over this graph:

* a pattern's confidence in a kind is the mean score of its distinct instances that may be of it,
  each unknown one counting as zero at first, with one more that scores zero;
* an instance's score for a kind is what its patterns say together, 1 - product of (1 - confidence);
* patterns whose instances score under `SUPPORT` together say nothing.

After `ROUNDS` rounds, candidates that score `ACCEPT` or more join the spans, with the kind that
scores highest.  They never replace or overlap a seed, and one inside another is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

KINDS = ("email", "ip", "card", "phone")

# \G is the end of the match before, where the next one may begin inside a run of characters.
# Quantifiers that cannot give back are possessive, which keeps long runs linear.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What may be an identifier: a run of these with a digit and at least six characters.
CANDIDATE = r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z0-9._@+-]{6})(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]*+(?<=[A-Za-z0-9])"

#: What may be an identifier of one kind behind a pattern that speaks for it: loosened forms of `EXPRESSIONS`,
#: with spaces, brackets and other separators, without a top-level domain, a plus or a check.
_GROUP, _BREAK = r"(?:[0-9]++|\([0-9]++\)|\[[0-9]++\])(?![0-9A-Za-z])", r"[\x20./-]{1,3}+|(?<=[)\]])|(?=[(\[])"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:\x20?@\x20?|\x20?[(\[]\x20?(?:at|AT|@)\x20?[)\]]\x20?){_DOMAIN}++(?:\.{_DOMAIN}++)*+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]++(?:\x20?(?:[.:]|[(\[]\.[)\]])\x20?[0-9]++){3}+(?![0-9A-Za-z])|[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:.]))",
    "card": rf"(?<![0-9A-Za-z+]){_GROUP}(?:(?:{_BREAK}){_GROUP})*+",
    "phone": rf"(?<![0-9A-Za-z])\+?{_GROUP}(?:(?:{_BREAK}){_GROUP})*+",
}
SUPPORT, ACCEPT, ROUNDS = 3.0, 0.8, 3

_TAIL = 64


def _worth_a_look(text: Column) -> dict[str, Column]:
    """Cheap conditions that any text with a match meets."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": text.contains("+"),
        "candidate": text.rlike(r"[0-9][A-Za-z0-9._@+-]{2}|[A-Za-z0-9._@+-]{2}[0-9]"),
        "loose_email": text.rlike(r"@|[(\[]\x20?(?:at|AT)\x20?[)\]]"),
        "loose_ip": text.rlike(r":[0-9A-Fa-f]{0,4}:|[0-9]\x20?(?:[.:]|[(\[]\.[)\]])\x20?[0-9]"),
        "loose_card": text.rlike(r"[0-9](?:[\x20./()\[\]-]{0,5}[0-9]){11}"),
        "loose_phone": text.rlike(r"[0-9](?:[\x20./()\[\]-]{0,5}[0-9]){6}"),
    }


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + worth(i))
    return total % 10 == 0


def _passes(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "candidate", F.length(found) >= 6)
        .when(kind.isin("loose_email", "loose_ip"), F.length(found) >= 6)
        .when(kind == "loose_card", n.between(12, 19))
        .when(kind == "loose_phone", n.between(7, 15))
        .otherwise(True)
    )


def _described(kind: str):
    def match(found: Column, i: Column) -> Column:
        gap = F.get(f"{kind}_between", i)
        # Each match has a character at least, so these pieces reach back `_TAIL` characters.
        first = F.greatest(i - _TAIL, F.lit(0))
        pieces = F.zip_with(
            F.slice(f"{kind}_between", first + 1, i - first), F.slice(kind, first + 1, i - first),
            lambda between, match: F.concat(F.right(between, F.lit(_TAIL)), F.right(match, F.lit(_TAIL))),
        )
        before = F.concat(F.array_join(pieces, ""), F.right(gap, F.lit(_TAIL)))
        return F.struct(
            F.lit(kind).alias("kind"), (i + 1).alias("i"), F.length(gap).alias("gap"), found.alias("found"),
            F.right(before, F.lit(_TAIL)).alias("before"),
        )

    return match


def matches(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows, written (`row`, `doc_id`), and their matches that pass.

    A match: `row`, `kind`, `start`, `end` (code points), `found`, `before` (the text in front, at most
    64 characters).
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), whole.alias("whole"))
    look = _worth_a_look(F.col("whole"))
    # Leftmost matches that do not overlap, and the pieces between them.
    for kind, expression in {**EXPRESSIONS, "candidate": CANDIDATE, **{f"loose_{k}": e for k, e in LOOSE.items()}}.items():
        rows = rows.withColumn(kind, F.when(look[kind], F.regexp_extract_all("whole", F.lit(expression), F.lit(0))))
        rows = rows.withColumn(f"{kind}_between", F.when(F.size(kind) > 0, F.split("whole", expression, -1)))
        rows = rows.withColumn(f"{kind}_all", F.when(F.size(kind) > 0, F.transform(kind, _described(kind))))
    every = [F.coalesce(f"{k}_all", F.array().cast("array<struct<kind: string, i: int, gap: int, found: string, before: string>>")) for k in look]
    rows = written(rows.select("doc_id", F.concat(*every).alias("all"), F.monotonically_increasing_id().alias("row")))
    hits = rows.select("row", F.explode("all").alias("m")).select("row", "m.*")
    # Where a match ends: the gaps and matches up to it, within its row and kind.
    reached = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("found")).over(reached)
    hits = hits.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("found"))
    hits = hits.where(_passes(F.col("kind"), F.col("found")))
    return rows.select("row", "doc_id"), hits.select("row", "kind", "start", "end", "found", "before")


def _discovered(hits: DataFrame) -> DataFrame:
    """`row`, `kind`, `start`, `end` of candidates that the graph accepts."""
    seeds, candidates = hits.where(F.col("kind").isin(*KINDS)), hits.where(~F.col("kind").isin(*KINDS))
    # A candidate that overlaps a seed of its row is that seed.
    spans = seeds.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("seeds"))
    free = candidates.join(spans, "row", "left").where(
        F.col("seeds").isNull() | ~F.exists("seeds", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    )
    words = F.regexp_extract_all(F.lower("before"), F.lit(r"[^\s]+"), F.lit(0))
    pattern = F.when(F.size(words) >= 2, F.regexp_replace(F.concat_ws(" ", F.slice(words, -2, 2)), "[0-9]", "0"))
    known = written(seeds.select(pattern.alias("pattern"), "kind", F.lower("found").alias("instance")).where("pattern IS NOT NULL").distinct())
    # A single token may be of any kind that has no longer form at its place, a loose form is of its own.
    kinds = F.when(F.col("kind") == "candidate", F.array(*map(F.lit, KINDS))).otherwise(F.array(F.expr("substr(kind, 7)")))
    of_kind = free.select("row", "start", F.explode(kinds).alias("kind"), F.struct("end", F.lower("found").alias("instance"), pattern.alias("pattern")).alias("form"))
    unknown = of_kind.groupBy("row", "start", "kind").agg(F.max("form").alias("form")).select("row", "start", "kind", "form.*")
    unknown = written(unknown.where("pattern IS NOT NULL"))
    edges = written(unknown.select("pattern", "instance", "kind").distinct())
    # A pattern's instances: the known ones of all kinds, and what may be of the kind.
    told = known.select("pattern", "instance").distinct()
    new = F.count(F.when(F.col("old").isNull(), 1))
    sizes = edges.join(told.withColumn("old", F.lit(True)), ["pattern", "instance"], "left").groupBy("pattern", "kind").agg(new.alias("new"))
    sizes = sizes.join(told.groupBy("pattern").agg(F.count("*").alias("told")), "pattern", "left")
    sizes = written(sizes.select("pattern", "kind", (F.col("new") + F.coalesce("told", F.lit(0))).alias("size")))
    seeded = written(known.groupBy("pattern", "kind").agg(F.count("*").alias("sure")))
    scores = None
    for _ in range(ROUNDS):
        mass = seeded.select("pattern", "kind", F.col("sure").cast("double").alias("mass"))
        if scores is not None:
            more = edges.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
            mass = mass.unionByName(more).groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"))
        says = mass.where(F.col("mass") >= SUPPORT).join(sizes, ["pattern", "kind"]).select(
            "pattern", "kind", F.least(F.col("mass") / (F.col("size") + 1), F.lit(0.999999)).alias("confidence")
        )
        doubt = F.sum(F.log(1 - F.col("confidence")))
        scores = written(edges.join(says, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score")))
    # The best kind of each place, and no part of what is found already.
    order = F.struct("score", (-F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))).alias("order"), "kind", "end")
    best = unknown.join(scores.where(F.col("score") >= ACCEPT), ["instance", "kind"]).groupBy("row", "start").agg(F.max(order).alias("best"))
    best = written(best.select("row", "start", "best.kind", "best.end"))
    within = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("end").over(within)
    return best.withColumn("reached", reached).where("reached IS NULL OR reached < end").drop("reached").select("row", "kind", "start", "end")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id`, `base` and `spans` of every row: arrays of (`start`, `order`, `kind`, `end`), sorted.

    `base` has the four kinds' matches, `spans` these and the discovered ones.  A null or empty
    text has none.  Rows are told apart by number, so repeated rows each have their result;
    an empty table gives an empty one.
    """
    rows, hits = matches(docs, text)
    hits = written(hits)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", place.alias("order"), "kind", "end")
    base = hits.where(F.col("kind").isin(*KINDS)).select("row", "kind", "start", "end", F.lit(True).alias("sure"))
    every = base.unionByName(_discovered(hits).withColumn("sure", F.lit(False)))
    gathered = every.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("sure"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans")
    )
    none = F.array().cast("array<struct<start: int, order: int, kind: string, end: int>>")
    return rows.join(gathered, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
