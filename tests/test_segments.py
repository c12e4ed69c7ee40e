import random

from pyspark.sql import functions as F

from tidelog.operators import segments


def test_scans_match_a_plain_loop(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab"), s, rng.randint(0, 50)) for s in sorted(rng.sample(range(500), 200))]
    df = spark.createDataFrame(data, "k string, seq bigint, v bigint")
    df = segments.running_count(df, ["k"], "seq", "n", 13)
    df = segments.running_sum(df, ["k"], "seq", F.col("v"), "total", 13)
    df = segments.running_max(df, ["k"], "seq", F.col("v"), "top", 13)
    df = segments.previous(df, ["k"], "seq", F.col("v"), "before", 13)
    df = segments.running_count(df, [], "seq", "all", 13)
    got = {r.seq: (r.n, r.total, r.top, r.before, r.all) for r in df.collect()}
    seen, want = {}, {}
    for i, (k, s, v) in enumerate(data):
        past = seen.setdefault(k, [])
        before = past[-1] if past else None
        past.append(v)
        want[s] = (len(past), sum(past), max(past), before, i + 1)
    assert got == want


def test_newest(spark):
    df = spark.range(0, 1000, 3)
    for n in (1, 7, 400):
        got = sorted(r.id for r in segments.newest(df, n, "id", 10).collect())
        assert got == list(range(0, 1000, 3))[-n:]
