import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidelog.operators import dedup, jobs, requests


@pytest.mark.parametrize("seed", range(2))
def test_ttl_dedup_matches_fold(spark, seed):
    rng = random.Random(seed)
    times = sorted((rng.randrange(150), rng.choice("aaab")) for _ in range(150))
    data = [(k, t, i) for i, (t, k) in enumerate(times)]
    kept, last = set(), {}
    for k, t, i in data:
        if k not in last or t >= last[k] + 30:
            last[k] = t
            kept.add(i)
    df = spark.createDataFrame(data, "idempotency_key string, at bigint, i bigint")
    assert {r.i for r in dedup.dedup_by_ttl(df, "at", "i", 30).collect()} == kept


def test_ttl_edge(spark):
    df = spark.createDataFrame([("a", d, d) for d in (0, 5, 8, 20)], "idempotency_key string, at bigint, i bigint")
    assert sorted(r.i for r in dedup.dedup_by_ttl(df, "at", "i", 7).collect()) == [0, 8, 20]
    edge = spark.createDataFrame([("a", 0, 0), ("a", 6, 1), ("a", 7, 2)], df.schema)
    assert sorted(r.i for r in dedup.dedup_by_ttl(edge, "at", "i", 7).collect()) == [0, 2]


def test_ledger(spark):
    ledger = spark.createDataFrame([("a", 1, "j", 100), ("b", 1, "j", 50)], "idempotency_key string, processed_at bigint, job_id string, expires_at bigint")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4)], "idempotency_key string, i bigint")
    marked = {r.i: r.was_duplicate for r in dedup.mark_duplicates(df, ledger, 50).collect()}
    assert marked == {1: True, 2: False, 3: False, 4: False}  # expiring now is expired
    assert sorted(r.i for r in dedup.drop_processed(df, ledger, 50).collect()) == [2, 3, 4]
    assert sorted(r.i for r in dedup.check_and_mark(df, ledger, ["i"]).collect()) == [3]  # ignores expiry
    applied = df.where("i in (1, 3)").select("idempotency_key", F.lit(60).cast("bigint").alias("processed_at"), F.lit("k").alias("job_id"))
    after = {r.idempotency_key: (r.job_id, r.expires_at) for r in dedup.upsert_ledger(ledger, applied, 10).collect()}
    assert after == {"a": ("k", 70), "b": ("j", 50), "c": ("k", 70)}
    assert [r.idempotency_key for r in dedup.drop_expired(ledger, 51).collect()] == ["a"]
    assert tuple(dedup.cleanup_counts(ledger, 50).first()) == (2, 0)


def test_lifecycle_table(spark):
    legal = [("pending", "start"), ("queued", "acquire"), ("running", "pause"), ("paused", "resume"), ("pending", "cancel"),
             ("queued", "cancel"), ("running", "cancel"), ("paused", "cancel"), ("completed", "delete"), ("running", "set_speed")]
    illegal = [("completed", "resume"), ("failed", "start"), ("cancelled", "start"), ("pending", "pause"), ("queued", "pause"),
               ("running", "start"), ("completed", "cancel"), ("running", "delete"), ("queued", "set_speed"), ("deleted", "start")]
    assert all(jobs._after(s, c) for s, c in legal)
    assert not any(jobs._after(s, c) for s, c in illegal)


def test_lifecycle_matches_fold(spark):
    rng = random.Random(3)
    names = list(jobs.TRANSITIONS)
    data = [(rng.choice([1, 1, 2, 3]), s, rng.choice(names)) for s in range(200)]
    state, want = {}, {}
    for job, s, c in data:
        before = state.get(job, "pending")
        after = jobs._after(before, c)
        state[job] = after or before
        want[s] = (before, after or before, after is not None)
    df = spark.createDataFrame(data, "job_id bigint, seq bigint, command string")
    got = {r.seq: (r.before, r.after, r.accepted) for r in jobs.lifecycle(df, width=9).collect()}
    assert got == want


@pytest.mark.parametrize("piece_ms", [10**9, 700])
def test_rate_limit_matches_bucket(spark, piece_ms):
    """`piece_ms` 700 cuts the busy client's one long session into many pieces."""
    rng = random.Random(5)
    data, at = [], 0
    for i in range(600):
        at += rng.choice([0, 0, 20, 60, 150]) if i % 200 else 30_000
        data.append((i, "hot" if rng.random() < 0.8 else "cold", at, "/api/v1/jobs"))
    data.append((600, "hot", at, "/api/v1/health/live"))
    capacity, rate = 5, Fraction(10)
    want, buckets = {}, {}
    for i, ip, ts, path in data[:-1]:
        tokens, last = buckets.get(ip, (Fraction(capacity), ts))
        tokens = min(Fraction(capacity), tokens + (ts - last) * rate / 1000)
        ok = tokens >= 1
        tokens -= ok
        buckets[ip] = (tokens, ts)
        want[i] = (ok, int(tokens) if ok else 0)
    df = spark.createDataFrame(data, "seq bigint, ip string, ts_ms bigint, path string")
    got = {r.seq: (r.allowed, r.remaining) for r in requests.rate_limit(df, capacity, 10.0, piece_ms=piece_ms).collect()}
    assert got == want
    assert 0 < sum(ok for ok, _ in want.values()) < len(want)


def test_audit(spark):
    cases = [
        ("POST", "/api/v1/jobs", "replay_job", None, "replay_job.create"),
        ("PATCH", "/api/v1/jobs/abc-123", "replay_job", "abc-123", "replay_job.update"),
        ("POST", "/api/v1/jobs/abc/start", "replay_job", "abc", "replay_job.start"),
        ("POST", "/api/v1/auth/register", "auth", None, "auth.register"),
        ("DELETE", "/jobs/9/", "replay_job", "9", "replay_job.delete"),
        ("GET", "/", "unknown", None, "unknown.get"),
        ("POST", "/api/v1", "unknown", None, "unknown.create"),
    ]
    df = spark.createDataFrame([(i, m, p) for i, (m, p, *_) in enumerate(cases)], "i int, method string, path string")
    path, method = F.col("path"), F.col("method")
    got = df.orderBy("i").select(requests.resource_type(path), requests.resource_id(path), requests.action(method, path)).collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]
