"""Operators on documents against plain versions, on given tables and on awkward rows."""

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from tidelog.llm import bpe, decontaminate, line_dedup, pii, queries, simhash, suffix_dedup  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, _own string, ref long, window int, tile int, n long"
LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 12
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "null id\nb\nc\nd"), (None, None),
    (6, LONG), (7, "x" + LONG[100:400] + "y"), (8, "é" * 350 + "漢字😀 end"), (9, "ab" * 700), (10, "a" * 3000),
    (11, "A b C\nd\ne\nA b C\nd\ne\nf"), (12, "A b C\nd\ne\nA b C\nd\ne\nf"), (13, "\n\n\n\n\n"),
    (14, "mail a@b.cd_x@y.zz.q, ip 1.2.3.4 1.2.3.456 0001.2.3.4.5, card 4111 1111 1111 1111 and 4111-1111-1111-1112"),
    (15, "+1 (269) 555-3296 +12 +1+1+1 3 4 5 6 7 8 9 0 " + "9" * 400 + " a.b%c@d-e.f-g..h 😀 x@y.z"),
    (16, "it's we'll  double  spaces\r\n\r\nTHE END 12345 ½ ² x\u00a0y\u2003z \x1c\x85 '"), (17, "the " * 5000),
]


def documents(spark):
    rows = [(i, t, "clash", 1, 2, 3, 4) for i, t in AWKWARD]
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows += [(100 + r[0], r[1], None, 1, 2, 3, 4) for r in given]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), [(r[0], r[1]) for r in rows]


def by_row(rows, key=lambda r: r):
    return sorted(map(key, rows), key=repr)


def test_suffix_dedup(spark):
    docs, rows = documents(spark)
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "removed", F.sha2("kept", 256)).collect()
    got = [(r[0], r[1], sum(s.end - s.start for s in r[2]), len(r[2]), r[3]) for r in got]
    expected = [(i, *x) for (i, _), x in zip(rows, brute.removed_bytes([t for _, t in rows]))]
    assert by_row(got) == by_row(expected)


@pytest.mark.parametrize("tile", [3, 2048])
def test_simhash(spark, tile):
    docs, rows = documents(spark)
    got = simhash.near_copies(docs, tile=tile).select("doc_id", "fingerprint", "component_id").collect()
    prints = [brute.simhash(t) for _, t in rows]
    expected = zip([i for i, _ in rows], prints, brute.components([i for i, _ in rows], prints))
    assert by_row((r[0], r[1] % 2**64, r[2]) for r in got) == by_row(expected)


def test_near_copies_are_linked_across_tiles(spark):
    base = [0, 2**64 - 1, 0xF0F0F0F0F0F0F0F0, 1 << 63]
    prints = sorted({b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 5) for j in range(0, 64, 7)})
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    got = simhash.links(spark.createDataFrame(signed, "fingerprint long"), tile=16).collect()
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in got)
    group = {p: p for p in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in got:
        group[root(a % 2**64)] = root(b % 2**64)
    assert len({root(p) for p in prints}) == len(set(brute.components(list(range(len(prints))), prints)))


def test_one_of_each_group_stays(spark):
    docs, rows = documents(spark)
    prints = [brute.simhash(t) for _, t in rows]
    groups = brute.components([i for i, _ in rows], prints)
    kept = [r[0] for r in simhash.one_of_each(docs).select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == sorted({g for g in groups if g is not None})


def test_line_dedup(spark):
    docs, rows = documents(spark)
    got = line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed").collect()
    kept = brute.lines_kept(rows)
    assert by_row(map(tuple, got)) == by_row((i, *kept[i, t]) for i, t in rows)


ITEMS = [
    (1, "one"), (2, None), (3, ""), (None, "null id b c d"), (4, "dolor sit amet consectetur adipiscing elit lorem ipsum dolor sit amet"),
    (4, "!!"), (5, "the the the the the the the the the the the the"), (6, "漢字😀 end"), (7, "null id b c d"),
]


@pytest.mark.parametrize("shingle", [5, 7])
def test_decontamination(spark, shingle):
    docs, rows = documents(spark)
    given = [(100 + r[0], r[1]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS + given], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(docs, items, shingle=shingle).collect()
    expected = [(i, *x) for (i, _), x in zip(rows, brute.contamination([t for _, t in rows], ITEMS + given))]
    assert by_row((r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in got) == by_row(expected)
    clean = decontaminate.clean(docs, items).select("doc_id").collect()
    assert by_row(r[0] for r in clean) == by_row(x[0] for x in expected if not x[2])


def test_byte_bpe(spark):
    import tiktoken

    tokens = {t: i for i, t in enumerate(bpe.read_ranks(queries.VOCABULARY))}
    plain = tiktoken.Encoding("plain", pat_str=queries.PATTERN, mergeable_ranks=tokens, special_tokens={})
    docs, rows = documents(spark)
    got = bpe.encode_decode(docs, queries.VOCABULARY, queries.PATTERN).collect()
    expected = []
    for i, t in rows:
        ids = b"".join(x.to_bytes(4, "little") for x in plain.encode_ordinary(t or ""))
        expected.append((i, ids, (t or "").encode()))
    assert by_row((r[0], bytes(r[1]), bytes(r[2])) for r in got) == by_row(expected)


def test_personal_data(spark):
    docs, rows = documents(spark)
    got = pii.find(docs).collect()
    expected = [(i, brute.personal(t)) for i, t in rows]
    assert by_row((r.doc_id, [tuple(s) for s in r.base]) for r in got) == by_row(expected)
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"text {i} my card 4111111111111111{i:02d} is") for i in range(3)]
    rows = [(i, f"some words, customer mail user{i}@example.com was seen") for i in range(12)]
    rows += [(50 + i, f"other words, customer mail user{i}.at.example99 was seen") for i in range(2)]
    rows += [(60, "unrelated words before user1234 here"), (61, "")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[50].spans] == [("email", 27, 45)] and not got[50].base
    assert not got[60].spans and not got[61].spans and len(got[0].spans) == 1


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n not in ("op1_html_extraction", "op3_exact_top_k", "op9_url_filter")])
def test_empty_tables(spark, tmp_path, name):
    for table, schema in {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
        "embeddings": "vec_id long, embedding array<float>, label int",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_digest_of_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert queries.encoded(docs).collect()[0][1:] == (0, nothing, nothing)
