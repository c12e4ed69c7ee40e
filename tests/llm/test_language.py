"""Language identification: sums over segmentations against enumeration, and held-out accuracy."""

import base64
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import language_id, queries

PIECES = [b" ", b"a", b"b", b"ab", b"ba", b" a", b" ab", b"aba", "é".encode(), "aé".encode(), b"A", b"b c", b"!"]


@pytest.fixture
def pieces(tmp_path):
    path = tmp_path / "vocabulary"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(PIECES)))
    return language_id.Pieces.read(str(path))


def number_of(pieces, piece):
    data = np.frombuffer(piece, np.uint8)
    return int(pieces.find(language_id.RangeHash(data)(np.array([0]), np.array([len(data)])))[0])


def segmentations(word, pieces):
    """Every way to cut `word` into pieces, as lists of their numbers."""
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        found = [number_of(pieces, word[a:b]) for a, b in zip(at, at[1:])]
        if min(found) >= 0:
            yield found


def test_pieces_are_words_or_bytes(pieces):
    assert len(pieces.hashes) == 256 + 7  # every byte; A-Z never occur, and neither do pieces over two words
    assert number_of(pieces, b"b c") == -1 and number_of(pieces, b" ab") >= 0


def test_sums_over_all_segmentations(pieces):
    words = [b" ab", b" abab", " aébaé".encode(), b" b", " xé".encode()]
    rng = np.random.default_rng(3)
    logs = np.log(rng.random((len(pieces.hashes), 2)))
    data, at = np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum([len(w) for w in words])]
    lattice = language_id._Lattice(pieces, data, at)
    want = [[np.log(sum(np.exp(logs[s, k].sum()) for s in segmentations(w, pieces))) for k in (0, 1)] for w in words]
    assert np.allclose(lattice.totals(logs), want)

    language, n, counts = np.array([0, 1, 1, 0, 1]), np.array([1, 2, 3, 4, 5]), np.zeros(logs.shape)
    for w, k, times in zip(words, language, n):
        shares = [(s, np.exp(logs[s, k].sum())) for s in segmentations(w, pieces)]
        for s, p in shares:
            for piece in s:
                counts[piece, k] += times * p / sum(q for _, q in shares)
    to, piece, sums = lattice.expected(logs, language, n)
    got = np.zeros(logs.shape)
    np.add.at(got, (piece, to), sums / language_id._UNIT)
    assert np.allclose(got, counts, atol=1e-4)


def test_long_words_come_in_parts():
    data = np.frombuffer(("é" * 100).encode(), np.uint8)
    i, start, end = language_id._parts(data, np.array([0]), np.array([200]))
    assert (i == 0).all() and start[0] == 0 and end[-1] == 200 and (start[1:] == end[:-1]).all()
    assert (end - start).max() <= language_id.PART and not (start % 2).any()


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = queries.QUERIES["op11_language_id"](spark, sf_dir)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").where("lang IS NOT NULL")
    held = out.where("held_out").join(given, "doc_id")
    n, right, low, high = held.agg(
        F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")
    ).first()
    assert n > 100 and right >= 0.97 and 0 <= low and high <= 1


def test_awkward_rows(spark, pieces):
    learn = spark.createDataFrame([("ab ab ab", "x"), ("ba bé bé", "y"), (None, "x"), ("ab", None), ("", "z")], "text string, lang string")
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "ab"), (4, "ab"), (None, "bé"), (5, "漢字"), (6, "ab " * 200_000), (7, "b" * 100_000)]
    docs = spark.createDataFrame([(i, t, "c", 1.0) for i, t in rows], "doc_id long, text string, Lang_Pred string, score double")
    model = language_id.train(learn.where("lang IS NOT NULL AND text IS NOT NULL"), pieces)
    assert model.languages == ["x", "y"]  # a text without words teaches nothing
    got = language_id.predict(docs, model, pieces)
    assert got.columns == ["doc_id", "text", "Lang_Pred", "score", "lang_pred_", "score_"]
    by_id = {(r[0], r[1] and r[1][:3]): (r[4], r[5]) for r in got.collect()}
    assert got.count() == len(rows) and all(by_id[k] == ("und", 0.0) for k in [(1, None), (2, ""), (3, "12 ")])
    assert by_id[4, "ab"][0] == by_id[6, "ab "][0] == "x" and by_id[None, "bé"][0] == "y" and by_id[5, "漢字"][0] in "xy"
    nothing = language_id.train(learn.limit(0), pieces)
    assert {r[4] for r in language_id.predict(docs, nothing, pieces).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model, pieces).count() == 0
