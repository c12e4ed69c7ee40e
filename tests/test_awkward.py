"""Cases that went wrong once: unreadable envelopes, maps in records, short logs, null keys, full `old` images."""

from tidelog.operators import apply, decode, dedup, metrics, replay, requests, segments

TARGET = apply.Target(keys=("id",), columns={"id": "bigint", "kind": "string"})
CHANGE = "seq long, tbl string, operation string, old map<string, string>, new map<string, string>"


def test_unreadable_envelopes_are_no_inserts(spark):
    rows = [(1, '{"table": "t", "new": {"id": "1"}}'), (2, '{"table": "t", "ne'), (3, "not json"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "seq long, envelope string")
    assert [r.seq for r in decode.decode_envelopes(df).collect()] == [1]
    bad = decode.quarantine_envelopes(df).orderBy("seq").collect()
    assert [(r.seq, r.error_type) for r in bad] == [(n, "parse_error") for n in (2, 3, 4, 5)]


def test_check_and_mark_takes_change_records(spark):
    rows = [("k", 2, {"a": "2"}), ("k", 1, {"a": "1"}), ("seen", 1, {"a": "3"})]
    df = spark.createDataFrame(rows, f"{dedup.KEY} string, at long, new map<string, string>")
    ledger = spark.createDataFrame([("seen",)], f"{dedup.KEY} string")
    assert [(r.at, r.new) for r in dedup.check_and_mark(df, ledger, ["at"]).collect()] == [(1, {"a": "1"})]


def test_short_attempt_logs_stay_short(spark):
    rows = [(1, 1, False, False), (1, 2, False, False)] + [(2, n, False, False) for n in (1, 2, 3, 4)] + [(3, 1, False, False), (3, 2, True, False)]
    df = spark.createDataFrame(rows, "event int, attempt int, ok boolean, dup boolean")
    got = {r.event: (r.attempts, r.success, r.backoff_s, r.finished) for r in replay.fold_retries(df, ["event"]).collect()}
    assert got == {1: (2, False, 1.0, False), 2: (4, False, 7.0, True), 3: (2, True, 1.0, True)}


def test_full_old_images_must_match(spark):
    rows = [
        (1, "t", "INSERT", {}, {"id": "1", "kind": "a"}),
        (2, "t", "UPDATE", {"id": "1", "kind": "zzz"}, {"id": "1", "kind": "b"}),
        (3, "t", "DELETE", {"id": "1", "kind": "zzz"}, {}),
        (4, "t", "INSERT", {}, {"id": "2", "kind": "a"}),
        (5, "t", "UPDATE", {"id": "2", "kind": "a"}, {"id": "2", "kind": "c"}),
        (6, "t", "INSERT", {}, {"id": "3", "kind": "x"}),
        (7, "t", "DELETE", {"id": "3", "kind": "x"}, {}),
    ]
    changes = spark.createDataFrame(rows, CHANGE)
    state = lambda df: sorted((r.id, r.kind) for r in df.collect())
    assert state(apply.apply_log(changes, TARGET)) == [(1, "a"), (2, "c")]
    base = spark.createDataFrame([("t", 1, "a"), ("t", 2, "a"), ("t", 3, "x")], "tbl string, id long, kind string")
    assert state(apply.apply_updates(base, changes, TARGET)) == [(1, "a"), (2, "c"), (3, "x")]
    assert state(apply.apply_deletes(base, changes, TARGET)) == [(1, "a"), (2, "a")]


def test_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 30)], "k string, seq long")
    got = segments.running_count(df, ["k"], "seq", "n", width=10).collect()
    assert sorted((r.seq, r.n) for r in got) == [(1, 1), (2, 1), (30, 2)]


def test_requests_without_a_path_count(spark):
    df = spark.createDataFrame([(1, "c", 0, None), (2, "c", 0, "/x")], "seq long, ip string, ts_ms long, path string")
    assert requests.rate_limit(df).count() == 2


def test_page_labels_and_values(spark):
    page = "\n".join([
        '# HELP up  Is it up?', '# TYPE up gauge', 'up{a="x\\"y}",b="p\\\\n\\n"} 1.5', "up 2 1700000000", "up -Inf", "{a=\"1\"} NaN", "up{a=1} 3", "up", "9bad 1",
    ])
    got = metrics.parse_pages(spark.createDataFrame([(1, page)], "page int, text string"), ["page"]).orderBy("pos").collect()
    assert [(r.name, r.labels, str(r.value), r.help, r.type) for r in got] == [
        ("up", {"a": 'x"y}', "b": "p\\n\n"}, "1.5", "Is it up?", "gauge"),
        ("up", {}, "-inf", "Is it up?", "gauge"), ("", {"a": "1"}, "nan", "Is it up?", "gauge"),
    ]


def test_last_bucket(spark):
    buckets = spark.createDataFrame([("s", 1.0, 0), ("s", float("inf"), 4)], "s string, le double, count long")
    value = lambda **o: metrics.percentiles(buckets, ["s"], [0.5], **o).first()["value"]
    assert value() == 1.0 and value(unbounded=float("inf")) == float("inf")
