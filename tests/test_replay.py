import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelog.operators import browse, jobs, replay
from tidelog.sources import archive as stored

ARCHIVE = "part int, off bigint, publish_ms bigint, seq bigint"


def archive(rng, parts=3, rows=40):
    out, seq = [], 0
    for p in range(parts):
        t = 0
        for o in range(rows):
            t += rng.randrange(4)
            out.append((p, o, t + rng.randrange(10), seq))
            seq += 1
    return out


def scan(rows, start, end, checkpoint):
    """Read each partition from its frontier to its first row past the end."""
    out = []
    for p in sorted({r[0] for r in rows}):
        part = [r for r in rows if r[0] == p]
        if p in checkpoint:
            at = checkpoint[p] + 1
        else:
            at = next((r[1] for r in part if r[2] >= start), len(part))
        for r in part[at:]:
            if r[2] > end:
                break
            out.append((r[0], r[1]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_archive_range_matches_scan(spark, seed):
    rng = random.Random(seed)
    rows = archive(rng)
    df = spark.createDataFrame(rows, ARCHIVE)
    for checkpoint in ({}, {0: 10}, {0: 39, 1: 0, 7: 5}):
        start = rng.randrange(60)
        end = start + rng.randrange(40)
        got = sorted((r.part, r.off) for r in replay.archive_range(df, start, end, checkpoint).collect())
        assert got == scan(rows, start, end, checkpoint)
    strict = replay.archive_range(df, 10, 30, strict=True).count()
    assert strict == sum(10 <= r[2] <= 30 for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_archive_range_reads_only_needed_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = archive(rng)
    path = f"{tmp_path}/archive"
    stored.store(spark.createDataFrame(rows, ARCHIVE), path, file_rows=5)
    files = {r.file for r in stored.zones(spark, path).collect()}
    assert len(files) >= 24
    for checkpoint in ({}, {0: 10}, {0: 39, 1: 0, 7: 5}):
        start = rng.randrange(60)
        end = start + rng.randrange(20)
        found = stored.read_range(spark, path, start, end, checkpoint)
        assert sorted((r.part, r.off) for r in found.collect()) == scan(rows, start, end, checkpoint)
        plain = replay.archive_frontier(spark.createDataFrame(rows, ARCHIVE), start, checkpoint)
        frontier = stored.read_frontier(spark, path, start, checkpoint)
        assert sorted((r.part, r.frontier) for r in frontier.collect()) == sorted((r.part, r.frontier) for r in plain.collect())
        wanted = stored.needed(stored.zones(spark, path), start, end, checkpoint)
        opened = stored.read_files(spark, path, wanted)
        base = lambda files: {f.rpartition("/")[2] for f in files}
        assert base(opened.inputFiles()) == base(r.file for r in wanted.collect())
        if not checkpoint:
            assert len(opened.inputFiles()) < len(files)
    strict = stored.read_range(spark, path, 10, 30, strict=True)
    assert strict.count() == sum(10 <= r[2] <= 30 for r in rows) and len(strict.inputFiles()) < len(files)


def test_archive_range_pushes_its_range_down(spark, tmp_path):
    rows = archive(random.Random(9))
    stored.store(spark.createDataFrame(rows, ARCHIVE), f"{tmp_path}/archive", file_rows=10)
    found = stored.read_range(spark, f"{tmp_path}/archive", 10, 40)
    assert sorted((r.part, r.off) for r in found.collect()) == scan(rows, 10, 40, {})
    assert "GreaterThanOrEqual(off" in found._jdf.queryExecution().toString()


def test_frontier_golden(spark):
    df = spark.createDataFrame([(0, o, o) for o in range(200)] + [(2, o, 100 + o) for o in range(60)] + [(3, o, 1) for o in range(999)], "part int, off bigint, publish_ms bigint")
    got = {r.part: r.frontier for r in replay.archive_frontier(df, 150, {0: 100}).collect()}
    assert got == {0: 101, 2: 50, 3: 999}


def test_hot_resume(spark):
    df = spark.createDataFrame([(5000, 0), (5000, 1), (4000, 9), (5001, 0), (9001, 0)], "stream_ms bigint, stream_seq bigint")
    assert [tuple(r) for r in replay.hot_resume(df, "5000-0", 9000).collect()] == [(5000, 1), (5001, 0)]
    assert [tuple(r) for r in replay.hot_range(df, 4000, 5000).collect()] == [(4000, 9), (5000, 0), (5000, 1)]


def test_checkpoint_formats(spark):
    df = spark.createDataFrame([('{"0":100,"1":200}',), ("0:456",), ("{}",)], "c string")
    got = [r[0] for r in df.select(replay.parse_checkpoint(F.col("c"))).collect()]
    assert got == [{0: 100, 1: 200}, {0: 456}, {}]
    assert [replay.checkpoint_map(c) for c in ('{"0":100,"1":200}', "0:456", "{}")] == got
    with pytest.raises(PySparkException):
        spark.createDataFrame([("garbage",)], "c string").select(replay.parse_checkpoint(F.col("c"))).collect()
    with pytest.raises(ValueError):
        replay.checkpoint_map("garbage")


def test_checkpoint_advance(spark):
    df = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 7, 2), (1, 0, 6, 3)], "job_id int, part int, off bigint, seq bigint")
    row = replay.checkpoint_advance(df).first()
    assert (row.checkpoint, row.last_processed_id) == ({0: 6, 1: 7}, "0:6")


def test_offset_count(spark):
    df = spark.createDataFrame([(0, o, o * 10) for o in range(10)] + [(1, 0, 5)], "part int, off bigint, publish_ms bigint")
    assert replay.offset_count(df, 20, 50).first()[0] == 3  # end excluded, partition 1 counts 0
    assert replay.offset_count(df, 20, 500).first()[0] == 0
    assert replay.window_count(df, 20, 50).first()[0] == 4


def test_route_and_validate(spark):
    hour = 3_600_000
    cases = [(hour // 2, hour // 6, None, "hot"), (2 * hour, hour // 6, None, "archive"), (hour // 2, 2 * hour, None, "archive"), (2 * hour, 1, "hot", "hot")]
    df = spark.createDataFrame([(10 * hour, 10 * hour - age, 10 * hour - age + width, pin) for age, width, pin, _ in cases], "now_ms bigint, start_ms bigint, end_ms bigint, pinned string")
    assert [r.source for r in replay.route(df).collect()] == [c[3] for c in cases]
    with pytest.raises(PySparkException):
        replay.route(df.withColumn("pinned", F.lit("tape"))).collect()
    bad = spark.createDataFrame([(0, 1, 1.0, "grpc"), (1, 1, 0.05, "ftp"), (0, 1, 100.0, "http")], "start_ms bigint, end_ms bigint, speed double, target string")
    assert [len(r.violations) for r in replay.validate(bad).collect()] == [0, 3, 0]


def test_schedule(spark):
    df = spark.createDataFrame([("j", 1, 1000), ("j", 2, 3000), ("j", 3, 2000), ("j", 4, 9000)], "job string, seq bigint, commit_time bigint")
    rows = replay.schedule(df, F.lit(2.0), 50, ["job"], width=2).orderBy("seq").collect()
    assert [(r.due_ms, r.release_ms) for r in rows] == [(50.0, 50.0), (1050.0, 1050.0), (550.0, 1050.0), (4050.0, 4050.0)]


def test_retries_and_summary(spark):
    log = [(1, 1, 1, False, False), (1, 1, 2, True, False), (1, 1, 3, True, False), (1, 2, 1, False, True)]
    log += [(1, 3, a, False, False) for a in (1, 2, 3, 4, 5)] + [(1, 4, 1, True, False)]
    df = spark.createDataFrame(log, "job_id int, seq bigint, attempt int, ok boolean, dup boolean")
    folded = replay.fold_retries(df, ["job_id", "seq"], max_retries=2)
    got = {r.seq: (r.attempts, r.success, r.was_duplicate, r.backoff_s) for r in folded.collect()}
    assert got == {1: (2, True, False, 1.0), 2: (1, False, True, 0.0), 3: (3, False, False, 3.0), 4: (1, True, False, 0.0)}
    good = F.col("success") | F.col("was_duplicate")
    assert sorted(r.seq for r in replay.fail_fast(folded, ~good).collect()) == [1, 2]
    s = replay.run_summary(folded).first()
    assert (s.total, s.processed, s.duplicates, s.failed, s.status, s.progress, s.handled_percent, s.is_terminal) == (4, 1, 1, 1, "failed", 25.0, 50.0, True)
    assert s.error == "Event 3 failed after 3 attempts"


def test_job_queries(spark):
    df = spark.createDataFrame([(i, "queued" if i % 2 else "done", 100 - i, None if i < 3 else 10 * i) for i in range(10)], "job_id int, status string, created_ms bigint, lease_expires_ms bigint")
    page = jobs.page(df, "queued", 2, 2).collect()
    assert [(r.job_id, r.total, r.pages) for r in page] == [(5, 5, 3), (7, 5, 3)]
    assert {r.state: r.jobs for r in jobs.active_counts(df).collect()} == {"queued": 5, "running": 0}
    assert [r.job_id for r in jobs.eligible(df, 60).collect()] == [5, 3, 1]
    with pytest.raises(ValueError):
        jobs.page(df, None, 1, 101)


def test_idle_gaps(spark):
    df = spark.createDataFrame([(0, 0), (1, 4999), (2, 9999), (3, 25000)], "seq bigint, commit_time bigint")
    got = [(r.seq, r.heartbeats) for r in browse.idle_gaps(df, width=2).orderBy("seq").collect()]
    assert got == [(2, 1), (3, 3)]
