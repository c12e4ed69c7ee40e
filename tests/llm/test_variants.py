"""Spelling variants against a plain version."""

import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_text import AWKWARD  # noqa: E402

from tidelog.llm import variants  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    *AWKWARD,
    *[(50, "abcdefgh " * 400 + "abcdefg abcdefg bbcdefgh bbcdefgh abdcefgh abdcefgh ABCDEFGHI abcdefghi")],
    *[(51, "naïveté " * 30 + "naiveté naiveté naïvet naïvete naïvete NAÏVETÉ Àéîõüçß Àéîõüçß Àéîõüçßx Àéîõüçßx")],
    *[(52, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa a×aaaaaaab a÷aaaaaaab")],
    *[(53, " ".join(["level" + c * 3 for c in "abcdefghij"] * 2 + ["levelaab"] * 25 + ["levelabb"] * 300))],
    *[(54, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 29_999 + " " + "x" * 29_999)],
]


def plain(rows, every):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
        return len(a) == len(b) + 1 and a[at + 1 :] == b[at:]

    found, form = {}, {}
    for w in n:
        others = sorted((v for v in n if abs(len(v) - len(w)) < 2 and v != w and near(v, w)), key=lambda v: (-n[v], v))
        form[w] = others[0] if others and n[others[0]] >= 10 * n[w] else None
        found[w] = len(others)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], found[w], form[w], n.get(form[w]), root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every", [None, 3])
def test_variants(spark, every, monkeypatch):
    monkeypatch.setattr(variants, "LETTERS", 500)  # so that words come in several parts
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, word string, h int").repartition(3)
    got = variants.variants(docs, every=every).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain(ROWS, every)
    assert sorted(map(tuple, got), key=repr) == want and any(w[3] for w in want)
    assert every or any(w[5] not in (w[0], w[3]) for w in want)  # roots over more than one form


def test_no_words(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (2, "short 1234567 once-only")], "doc_id long, text string")).count() == 0


def test_neighbours_are_the_reduced_words_one_edit_away():
    words = ["abc", "aabb", "i", "xyzzyé"]
    reduced = variants._Reduced(words)
    got = {i: set() for i in range(len(words))}
    for _, word, h in reduced.neighbours():
        for i, x in zip(word.tolist(), h.tolist()):
            got[i].add(x)
    value = lambda s: variants._Reduced(["".join(map(chr, s))]).own()[0] if s else variants._Reduced.named(np.zeros(1, np.uint64), np.zeros(1, np.int64))[0]
    for i, w in enumerate(words):
        symbols = [ord(c) % variants.SYMBOLS for c in w]
        want = {int(value(symbols))}
        for at in range(len(symbols)):
            want.add(int(value(symbols[:at] + symbols[at + 1 :])))
            want |= {int(value([*symbols[:at], s, *symbols[at + 1 :]])) for s in range(variants.SYMBOLS)}
        assert got[i] == want
