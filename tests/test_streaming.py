import os
import random

import pytest
from pyspark.sql import functions as F

from test_apply import SCHEMA, TARGET, fold, random_log, rows
from tidelog.operators import apply, dedup as batch_dedup, replay
from tidelog.plans import streaming_queries
from tidelog.sources import logs
from tidelog.streaming import capture, dedup
from tidelog.streaming.target import maintain, maintained, release


def write(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_dedup_over_restarts_equals_batch(spark, tmp_path):
    schema = "idempotency_key string, at bigint, i bigint"
    rng = random.Random(2)
    data = [(rng.choice("abc"), t, t) for t in range(0, 300, 2)]
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"

    def run():
        stream = logs.stream_log(spark, src, spark.createDataFrame([], schema).schema, files_per_trigger=1)
        kept = dedup.dedup_stream(stream, "at", "i", 40, expire=False)
        sink = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
        capture.run(kept, sink, f"{tmp_path}/progress").awaitTermination()

    write(spark, data[:70], schema, src)
    run()
    write(spark, data[70:], schema, src)
    write(spark, data[140:], schema, src)  # the end of the log is delivered again
    run()
    want = {r.i for r in batch_dedup.dedup_by_ttl(spark.createDataFrame(data, schema), "at", "i", 40).collect()}
    got = [r.i for r in capture.committed(spark, out).collect()]
    assert sorted(got) == sorted(want)


def test_fan_out_replaces_a_rerun_batch(spark, tmp_path):
    sink = capture.fan_out(f"{tmp_path}/hot", f"{tmp_path}/archive")
    batch = spark.range(10)
    sink(batch, 0)
    sink(batch, 0)
    sink(spark.range(10, 15), 1)
    for name in ("hot", "archive"):
        assert sorted(r.id for r in capture.committed(spark, f"{tmp_path}/{name}").collect()) == list(range(15))


def test_quarantine(spark, tmp_path):
    seen = []
    sink = capture.quarantine_to(f"{tmp_path}/bad", lambda df, n: seen.extend(r.operation for r in df.collect()))
    batch = spark.createDataFrame(
        [("1", 0, '{"change":[{"action":"I","table":"t"}]}'), ("2", 0, "{")], "lsn string, ingest_ms bigint, payload string"
    )
    sink(batch, 0)
    assert seen == ["INSERT"]
    assert [r.lsn for r in spark.read.parquet(f"{tmp_path}/bad/batch=0").collect()] == ["2"]


def test_tail_chunks_run_on_over_batches(spark, tmp_path):
    sink = capture.tail(f"{tmp_path}/tail", f"{tmp_path}/counted", 10, "id")
    for n, (low, high) in enumerate([(0, 25), (25, 25), (25, 38), (38, 40)]):
        sink(spark.range(low, high), n)
        sink(spark.range(low, high), n)  # a batch run again after a crash
    got = [(r.id, r.chunk) for r in capture.committed(spark, f"{tmp_path}/tail").collect()]
    assert sorted(got) == [(i, i // 10) for i in range(40)]


@pytest.mark.parametrize("many_rows", [False, True])
def test_maintained_target_matches_fold_over_a_restart(spark, tmp_path, many_rows):
    target = apply.Target(TARGET.keys, TARGET.columns, many_rows)
    log = random_log(random.Random(11), 200, rekey=0.03, full=0.3, wide=0.2 if many_rows else 0)
    src, progress = f"{tmp_path}/src", f"{tmp_path}/progress"
    moves = [c for c in log if c[2] == "UPDATE" and c[3].get("id", c[4].get("id")) != c[4].get("id", c[3].get("id"))]

    def run():
        stream = logs.stream_log(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
        sink = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/rejected/batch={n}")
        capture.run(maintain(stream, target, buckets=3), sink, progress).awaitTermination()

    write(spark, log[:80], SCHEMA, src)
    run()
    write(spark, log[80:130], SCHEMA, src)
    write(spark, log[130:], SCHEMA, src)
    run()
    key = lambda r: tuple((v is None, v) for v in r)
    kept = [c for c in log if c not in moves]
    assert sorted(rows(maintained(spark, progress, target)), key=key) == sorted(fold(kept, many_rows=many_rows), key=key)
    rejected = {r.seq for r in capture.committed(spark, f"{tmp_path}/rejected").collect()}
    assert rejected >= {c[0] for c in moves if "amt" not in c[4] or c[4]["amt"] != "n/a"} - {c[0] for c in log if not c[3] or not c[4]}


def test_release_waits_for_each_slot(spark):
    df = spark.createDataFrame([("j", s, 1000 + 400 * s) for s in range(5)], "job string, seq bigint, commit_time bigint")
    planned = replay.release_slots(replay.schedule(df, F.lit(1.0), 0, ["job"]), 1000, 0)
    clock, waits, sent = [0], [], []

    def wait(seconds):
        waits.append(seconds)
        clock[0] += int(seconds * 1000)

    n = release(planned, lambda d, slot: sent.append(sorted(r.seq for r in d.collect())), 1000, 0, lambda: clock[0], wait)
    assert (n, sent, waits) == (2, [[0, 1, 2], [3, 4]], [1.0])


def test_hot_table_stays_bounded(spark, tmp_path):
    hot = f"{tmp_path}/hot"
    sink = capture.fan_out(hot, f"{tmp_path}/archive", size=25)
    for n in range(12):
        for _ in range(2 if n % 5 == 0 else 1):  # some batches run again after a crash
            sink(spark.range(10 * n, 10 * n + 10).withColumnRenamed("id", "seq"), n)
        left = [f for f in os.listdir(hot) if f.startswith("batch=")]
        assert len(left) <= 3 and len(os.listdir(f"{hot}-counts")) == len(left)
        newest = sorted(r.seq for r in capture.hot_rows(spark, hot, 25).collect())
        assert newest == list(range(max(0, 10 * n - 15), 10 * n + 10))
    assert capture.committed(spark, f"{tmp_path}/archive").count() == 120


def test_tail_from_now_goes_on_after_a_restart(spark, tmp_path):
    src, marker = f"{tmp_path}/src", f"{tmp_path}/start"
    for n in range(3):
        spark.range(10 * n, 10 * n + 10).withColumnRenamed("id", "seq").coalesce(1).write.mode("append").parquet(src)
        stored = spark.read.parquet(src)
        tail = capture.from_now(logs.stream_log(spark, src, stored.schema), stored, marker)
        sink = lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")
        capture.run(tail, sink, f"{tmp_path}/progress").awaitTermination()
    assert sorted(r.seq for r in capture.committed(spark, f"{tmp_path}/out").collect()) == list(range(10, 30))


def test_fan_out_query_counts_every_change_in_both_tables(spark, tmp_path):
    rows = [(i, i % 9, "click" if i % 3 else "signup", float(i)) for i in range(1000)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double")
    events.withColumn("ts", F.expr("timestamp_ntz'2024-01-02 03:04:05'")).write.parquet(f"{tmp_path}/events.parquet")
    counts = {"archive": 0, "hot": 0, "hot, kept": 0}
    for r in streaming_queries.stream_fanout(spark, str(tmp_path)).collect():
        counts[r.sink] += r.n
    assert counts == {"archive": 1000, "hot": 1000, "hot, kept": 1000}


def test_large_micro_batches_have_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming_queries, "_FILE_ROWS", 10)
    gaps = spark.range(400).where("id < 100 OR id >= 299")  # one stretch has a single row
    for name, df in (("even", spark.range(400)), ("gaps", gaps)):
        seen, src = [], f"{tmp_path}/{name}"
        made = lambda rows: rows.withColumn("twice", F.col("id") * 2)
        stream = streaming_queries._in_order(df, src, "id", made=made)
        sink = lambda b, n: seen.append(sorted((r.id, r.twice) for r in b.collect()))
        capture.run(stream, sink, f"{tmp_path}/{name}-progress").awaitTermination()
        assert sum(seen, []) == [(r.id, 2 * r.id) for r in df.orderBy("id").collect()]
        if name == "even":
            assert len(seen) == 4 and len([f for f in os.listdir(src) if f.endswith(".parquet")]) == 40
