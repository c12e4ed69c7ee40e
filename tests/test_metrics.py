import math

from pyspark.sql import functions as F

from tidelog.operators import alerts, metrics
from tidelog.plans import metric_datasets as m

TEXT = """# HELP a_total Things
# TYPE a_total counter
a_total{op="x",t="1"} 3
a_total{op="y",t="1"} 4e1
a_total{op="y",t="2"} 7
a_total 5 1700000000
# HELP g Gauge
g NaN
g +Inf
  g -Inf
broken line here
{op="z"} 1
"""


def test_parse(spark):
    parsed = metrics.parse_pages(spark.createDataFrame([("p", TEXT)], "page string, text string"), ["page"])
    rows = parsed.orderBy("pos").collect()
    assert [(r.name, r.labels) for r in rows[:3]] == [("a_total", {"op": "x", "t": "1"}), ("a_total", {"op": "y", "t": "1"}), ("a_total", {"op": "y", "t": "2"})]
    assert [r.value for r in rows[:3]] == [3.0, 40.0, 7.0]
    assert math.isnan(rows[3].value) and rows[4].value == math.inf and rows[5].value == -math.inf
    assert (rows[6].name, rows[6].labels) == ("", {"op": "z"})
    assert {(r.help, r.type) for r in rows[:3]} == {("Things", "counter")} and rows[3].help == "Gauge" and rows[3].type == "counter"
    assert len(rows) == 7
    assert {r.op: r.value for r in metrics.by_label(parsed, ["page"], "a_total", "op").collect()} == {"x": 3.0, "y": 7.0}
    assert metrics.lookup(parsed, ["page"], "a_total", {"op": "y"}).first().value == 40.0
    assert {r.family: r.samples for r in metrics.families(parsed, ["page"]).collect()} == {"a": 3, "g": 3, "": 1}


def percentiles(spark, counts, points=(0.5, 0.99)):
    df = spark.createDataFrame([("s", float(le), n) for le, n in counts], "s string, le double, count bigint")
    return {r.p: r.value for r in metrics.percentiles(df, ["s"], points).collect()}


def test_percentiles(spark):
    got = percentiles(spark, [(0.1, 50), (0.5, 90), (1.0, 100), (math.inf, 100)], (0.5, 0.7, 0.95))
    assert got[0.5] == 0.1 and abs(got[0.7] - 0.3) < 1e-12 and abs(got[0.95] - 0.75) < 1e-12
    assert percentiles(spark, [(0.1, 0), (math.inf, 0)]) == {0.5: 0.0, 0.99: 0.0}
    assert percentiles(spark, [(0.1, 1), (0.5, 1), (math.inf, 100)])[0.99] == 0.5  # overflow bucket


def test_rates(spark):
    df = spark.createDataFrame([("s", 0, 0), ("s", 10_000, 50), ("s", 20_000, 20), ("s", 30_000, 40)], "s string, scrape_ms bigint, value bigint")
    assert [r.rate for r in metrics.snapshot_rate(df, ["s"]).orderBy("scrape_ms").collect()] == [0.0, 5.0, 0.0, 2.0]
    got = {r.eval_ms: r.rate for r in metrics.range_rate(df, ["s"], 25_000, 10_000).collect()}
    # (5, 30] holds 10, 20 and 30 s: restart to 20, then +20, over 20 s.
    assert got[30_000] == 2.0 and got[20_000] == (50 + 20) / 20


def test_histogram(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (3.0,)], "v double")
    rows = {r.le: (r["count"], r.total) for r in metrics.histogram(df, [], "v", (0.1, 1.0)).collect()}
    assert rows == {0.1: (2, 3), 1.0: (2, 3), math.inf: (3, 3)}


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (79.9,), (80.0,)], "v double")
    assert [r[0] for r in df.select(metrics.band(F.col("v"), metrics.BUFFER_BANDS)).collect()] == ["green", "yellow", "yellow", "red"]
    assert df.select(metrics.utilisation(F.lit(5), 2)).first()[0] == 100.0


def evals(spark, alert, severity, component, times):
    return spark.createDataFrame([(t, alert, severity, component, 1.0) for t in times], "eval_ms bigint, alert string, severity string, component string, value double")


def test_hold_inhibit_notify(spark):
    minute = 60_000
    crit = evals(spark, "C", "critical", "x", [t * minute for t in range(0, 40)])
    warn = evals(spark, "W", "warning", "x", [t * minute for t in [*range(0, 3), *range(30, 60)]])
    other = evals(spark, "O", "warning", "y", [t * minute for t in range(0, 8)])
    fired = alerts.firing(crit.union(warn).union(other), minute, {"C": 5 * minute, "W": 5 * minute, "O": 7 * minute})
    got = {}
    for r in fired.collect():
        got.setdefault(r.alert, []).append(r.eval_ms // minute)
    assert sorted(got["C"]) == list(range(5, 40)) and sorted(got["W"]) == list(range(35, 60)) and got["O"] == [7]
    active = alerts.inhibit(fired)
    assert sorted(r.eval_ms // minute for r in active.where("alert = 'W'").collect()) == list(range(40, 60))
    sent = sorted((r.alert, r.notify_ms / minute, r.status) for r in alerts.notifications(active, minute).collect())
    assert sent == [("C", 5.5, "firing"), ("C", 20.5, "firing"), ("C", 35.5, "firing"), ("C", 40.5, "resolved"),
                    ("W", 45.0, "firing"), ("W", 60.0, "resolved")]  # O ends before its wait is over


def test_every_rule_fires_on_the_test_log(spark):
    held = alerts.predicates(m.health(spark, "/root/testdata/sf0.01"))
    fired = alerts.firing(held, m.SLOT_MS, alerts.hold_times(scale=m.HOLD_SCALE)).cache()
    assert {r.alert for r in fired.select("alert").distinct().collect()} == {r.alert for r in alerts.RULES}
    assert 0 < alerts.inhibit(fired).count() < fired.count()


def test_consumer_lag(spark):
    archive = spark.createDataFrame([(0, o) for o in range(50)] + [(1, 0)], "part int, off bigint")
    checkpoint = spark.createDataFrame([(0, 39)], "part int, checkpoint_off bigint")
    got = {r.part: (r.lag, r.critical) for r in metrics.consumer_lag(archive, checkpoint, 5).collect()}
    assert got == {0: (10, True), 1: (1, False)}


def test_series_fire_on_their_own(spark):
    minute = alerts.MINUTE_MS
    rows = [("a", t, 0.0) for t in [*range(0, 9), *range(10, 30)]] + [("b", t, 0.0 if t % 7 else 1.0) for t in range(30)]
    rate = spark.createDataFrame([(s, t * minute, v) for s, t, v in rows], "series string, eval_ms long, value double")
    active = spark.createDataFrame([("x", t * minute, float(t > 15)) for t in range(30)], "series string, eval_ms long, value double")
    held = alerts.series_predicates({"ingest_rate": rate, "replay_rate": rate, "active_jobs": active})
    fired = alerts.series_firing(held, minute, alerts.hold_times(), width=4)
    got = {}
    for r in fired.collect():
        got.setdefault((r.alert, r.series), []).append((r.eval_ms // minute, r.active_ms // minute))
    want = {("IngestorStalled", "a"): [(t, 0) for t in range(5, 9)] + [(t, 10) for t in range(15, 30)]}
    want["IngestorStalled", "b"] = [(t, t - 5) for t in range(6, 30, 7)]
    want["ReplayerStalled", "a"] = [(t, 16) for t in range(26, 30)]
    assert {k: sorted(v) for k, v in got.items()} == want
