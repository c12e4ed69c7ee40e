"""Pages, vectors, URLs, the classifier and the pipeline."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from compare import compare, connect  # noqa: E402

from tidelog.llm import html_extract, quality, queries, topk, url_filter  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], queries.ORACLES[name]) is None


PAGES = [
    (None, ""), ("", ""), ("plain words", "plain words"),
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three<p>Fo<b>ur</b>.</article><footer>c</footer>",
     "A & B One two three Four."),
    ("<article><p>Text.</p><div class='ad'>Buy</div><aside>Side</aside><form>Name <input></form><p>More &eacute;&#33;&am"
     "</p><section id=comments><p>Nice</p></section></article>", "Text. More é!&am"),
    ("<article>a<script>var t='</p>';</script><!-- <p>no --><style>p{}</style>b", "ab"),
    ("<p>" + "long enough text " * 20 + "</p><ul><li><a href=1>menu one</a><li><a href=2>menu two</a></ul><div>x</div>", ("long enough text " * 20).strip()),
    ("<main><header><p>Head</p></header><p class=lead>Body</p><div role=alert>Notice</div></main>", "Body"),
    ("<article>cut <p", "cut"), ("<article>" + "<p>para</p>" * 3000, " ".join(["para"] * 3000)),
]


def test_html(spark):
    rows = [(i, None, page, "clash") for i, (page, _) in enumerate(PAGES)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {r.page_id: r.text for r in got} == {i: text for i, (_, text) in enumerate(PAGES)}


def test_html_keeps_the_article_of_given_pages(spark):
    """The given pages have one article, whose tags are all there is in it."""
    import html
    import re

    for page in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        inside = re.search("(?s)<article>(.*?)(?:</article>|$)", page.html or "")
        plain = re.sub("<[^>]*>?", " ", inside[1]) if inside else ""
        assert html_extract.main_text(page.html or "") == " ".join(html.unescape(plain).split())


@pytest.mark.parametrize("sizes", [(16384, 1024, 256, 4096), (64, 16, 8, 7)])
def test_top_k(spark, monkeypatch, sizes):
    for name, size in zip(("SHARD", "SMALL", "BLOCK", "TILE"), sizes):
        monkeypatch.setattr(topk, name, size)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, 0.25, 1.0, 0.1, -0.3]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5)]
    rows += [(500, [1.0] * 6), (500, [1.0] * 6), (None, [9.0] * 6), (550, []), (600, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, shard int, q int").repartition(3)
    got = topk.quantized(df, block=sizes[2])
    got = topk.nearest(got, got.where("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == brute.top_k(spark_rows(rows))
    big = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e3, 1.0]), (50, [1e3, 2.0])], "vec_id long, embedding array<double>")
    rows = topk.quantized(big)
    most = 2**63 - 1  # where a score ends that is no long
    assert sorted(map(tuple, topk.nearest(rows, rows.where("vec_id = 0")).collect())) == [(0, 1, 1, most), (0, 2, 50, most)]


def spark_rows(rows):
    """Floats as a float column holds them."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_top_k_without_rows(spark):
    rows = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.nearest(rows, rows).collect() == []


URLS = [
    (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://", "", "", None, "allow"),
    ("HTTP://WWW.Example.ORG/es/x?q#f", "www.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
    ("http://a.org", "a.org", "", None, "allow"), ("http://a.com/fr/casino", "a.com", "/fr/casino", "com/fr/", "allow"),
    ("http://casino-win.com/de/", "casino-win.com", "/de/", "com/de/", "block"), ("x://my.CASINO.net?a=/fr/", "my.casino.net", "", None, "block"),
    ("http://casinos.net/casino", "casinos.net", "/casino", None, "allow"), ("a://b.com/DE/", "b.com", "/DE/", None, "allow"),
    ("http://example.org:80/es/", "example.org:80", "/es/", None, "allow"), ("a\n://\nb.org/x\ny", "\nb.org", "/x\ny", "org/", "allow"),
]


def test_url_filter(spark):
    rows = [(i, u, "clash") for i, (u, *_) in enumerate(URLS)] * 2
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, token string"), queries.RULES).collect()
    assert sorted(map(tuple, got)) == sorted((i, *x) for i, (_, *x) in enumerate(URLS) for _ in range(2))


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("op1_html_extraction", "op9_url_filter"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.QUERIES["op2_quality_classifier"](spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    print("accuracy", right, "auc", above, "kept good", sum(s >= 0.7 for s in good) / len(good), "kept bad", sum(s >= 0.7 for s in bad) / len(bad))
    assert right > 0.95 and above > 0.95


def test_quality_awkward_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "word " * 50_000), (4, "\n" * 100)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (9, 1), (3, 7)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.classify(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.score == 1 for r in got)


def test_pooled_levels_rise():
    levels = quality.pooled([0, 3, 1, 4, 4], [4, 4, 4, 4, 4])
    assert levels.tolist() == [0, 0.5, 0.5, 1, 1]


def test_pipeline_against_plain_version(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, sf_dir).collect()
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op2_quality_classifier"](spark, sf_dir).collect()}
    assert {r.doc_id for r in good} == {i for i, p in scores.items() if p}
    rows = [(r.doc_id, r.text) for r in good]
    kept = brute.lines_kept(rows)
    rows = [(i, kept[i, t][0]) for i, t in rows if kept[i, t][2] == 0 or kept[i, t][2] < kept[i, t][1]]
    groups = brute.components([i for i, _ in rows], [brute.simhash(t) for _, t in rows])
    rows = [(i, t) for (i, t), g in zip(rows, groups) if i == g]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r, c in zip(rows, brute.contamination([t for _, t in rows], items)) if not c[1]]
    expected = queries.encoded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, expected))


def test_pipeline_stages_return_documents(spark):
    rows = [(1, None, "en", None, 0), (None, "a\nb\nc", None, "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["_doc", "_KEY", "_own", "_null", "_covered", "_lines", "_kept", "text_key", "n_lines", "n_removed", "first", "label"]
    wide = docs.select("*", *[F.lit(c).alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        same = stage(spark, wide, SF_DIR)
        assert same.columns == wide.columns, name
        got = sorted(map(repr, (tuple(r) for r in out.collect())))
        assert got == sorted(repr(tuple(r)[:5]) for r in same.collect()), name
        assert all(tuple(r)[5:] == tuple(clashing) for r in same.collect()), name
        assert stage(spark, docs.limit(0), SF_DIR).collect() == []
