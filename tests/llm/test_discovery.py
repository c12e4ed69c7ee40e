"""Identifiers that only their contexts tell."""

import pytest

from tidelog.llm import pii


def found(spark, texts):
    """Per text: kinds and words of what is found besides the four kinds' matches."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    return [[(s.kind, t[s.start : s.end]) for s in rows[i].spans if s not in rows[i].base] for i, t in enumerate(texts)]


def test_candidates_behind_other_tokens(spark):
    texts = [f"customer id 4821{i:04d} phone +1 555 0182 {i:04d} end" for i in range(12)]
    texts += [f"from 10.20.30.{10 + i} mail user{10 + i}@example.com, other{i}@example.com end" for i in range(12)]
    got = found(spark, texts + [
        "customer id 48213377 phone 555-0182-33 end", "from 10.20.30.40 mail user5.at.example end",
        "from 10.20.30.40 mail user77@example.com, other5.at.example end",
    ])
    assert got[-3:] == [[("phone", "555-0182-33")], [("email", "user5.at.example")], [("email", "other5.at.example")]]


def test_text_in_front_of_each_match(spark):
    text = "ab " + "1......x" * 100 + " 123456 654321, a@x.com, b@x.com " + "9" * 400 + " 777777"
    _, hits = pii.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = hits.collect()
    assert {r.kind for r in rows} >= {"candidate", "email"}
    assert all(r.before == text[: r.start][-64:] and r.found == text[r.start : r.end] for r in rows)


FORMS = [
    ("phone", "(555) 123-4567"), ("phone", "020 7946 0958"), ("phone", "555.123.4567"), ("phone", "[020] 7946/0958"),
    ("card", "4111 1111 1111 1112"), ("card", "4111/1111/1111/1111"), ("email", "john.doe@corp"), ("email", "john.doe @ corp"),
    ("email", "john.doe [at] corp.com"), ("ip", "10 . 20 . 30 . 40"), ("ip", "10[.]20[.]30[.]40"), ("ip", "fe80::1ff:fe23:4567:890a"),
]
KNOWN = {"phone": "+1 (555) 010 {:04d}", "card": "4111111111111111", "email": "user{}@example.com", "ip": "10.1.2.{}"}


def test_forms_behind_known_patterns(spark):
    cards = ["4111111111111111", "5555555555554444", "4012888888881881", "378282246310005", "6011111111111117", "30569309025904"] * 40
    texts = [f"words of {kind} number {KNOWN[kind].format(i) if kind != 'card' else cards[i]} end" for kind in KNOWN for i in range(80)]
    got = found(spark, texts + [f"words of {kind} number {form} 2nd end" for kind, form in FORMS] + ["words of no number (777) 123-4567 end", "1 " * 50_000])
    assert got[: len(texts)] == [[]] * len(texts)
    assert got[len(texts) :] == [[form] for form in FORMS] + [[], []]
