"""Hard negatives against a plain version; exact products by residues."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import hard_negatives


@pytest.mark.parametrize("size, width, largest", [(5, 3, 10), (40, 64, 300), (7, 3000, 255), (6, 5, 2**27), (3, 1, 0)])
def test_products_are_exact(size, width, largest):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-largest, largest + 1, (size + k, width)) for k in (0, 1))
    a[0], b[0] = largest, -largest  # the ends of the range
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert hard_negatives.products(a, b).tolist() == want


def test_scores_beyond_a_long_raise():
    with pytest.raises(ValueError):
        hard_negatives.products(np.full((1, 2), 2**40), np.full((1, 2), 2**40))


def plain(rows):
    rows = [
        (i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, label, v) in enumerate(rows):
        if i % 5:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(rows) if b != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(fits[:3], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, label int, row string, tile int, q int"


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_mining(spark, cells, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 20)
    monkeypatch.setattr(hard_negatives, "SMALL", 20)
    monkeypatch.setattr(hard_negatives, "TILE", 4)
    monkeypatch.setattr(hard_negatives, "CELLS", cells)
    rng = random.Random(1)
    rows = [(i, [rng.randint(-2, 6) / 64 for _ in range(4)], rng.randrange(3)) for i in range(70)]
    rows += [rows[5], rows[5], rows[11]]  # repeated rows
    rows += [(100, None, 1), (105, [0.1, None, 0.2, 0.3], 1), (110, [0.1, math.nan, 0.2, 0.3], 1), (115, [math.inf] * 4, 1)]
    rows += [(120, [0.1] * 4, None), (None, [0.1] * 4, 1), (125, [0.1] * 3, 2), (130, [], 2)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty, F.col("vec_id") % 5 == 0).count() == 0
    alone = spark.createDataFrame([(5, [1.0], 1, "", 0, 0), (6, [1.0], 1, "", 0, 0)], SCHEMA)
    assert hard_negatives.mine(alone, F.col("vec_id") % 5 == 0).count() == 0
