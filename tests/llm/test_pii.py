from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import clashing, documents

from factloom.llm import pii, queries
from factloom.llm.pii import KINDS, personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain_base(text):
    """Base spans by the patterns as they are written."""
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(part) <= 255 for part in m.group().split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and plain_luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), order, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a.@-b", "12.+ -(", "0123456789 -", "1.25", "a@b.c%+1 "])
def test_base_spans_equal_plain_patterns(alphabet):
    draw = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 40)))
        assert sorted(pii.base_spans(text)[0]) == plain_base(text), text


def spans_of(df):
    return {row["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in row["spans"]] for row in df.collect()}


def test_query_equals_plain_patterns(spark, sf_dir):
    texts = {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(row["spans"] for row in rows)
    for row in rows:
        spans = plain_base(texts[row["doc_id"]])
        listing = ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)
        assert row["base_sha256"] == hashlib.sha256(listing.encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(filter(None, listing.split(","))) <= set(filter(None, row["spans"].split(",")))
        assert spans or not row["spans"]


def test_estimation_finds_good_and_bad_labelers():
    draw = np.random.default_rng(4)
    truth = draw.random(6000) < 0.4
    right = [0.95, 0.9, 0.85, 0.8, 0.5, 0.75]
    votes = np.stack([np.where(draw.random(6000) < p, truth, ~truth) for p in right], axis=1)
    codes, counts = np.unique(np.where(votes, pii.YES, pii.NO), axis=0, return_counts=True)
    table, posterior = pii.estimate(codes, counts.astype(float))
    for labeler, p in enumerate(right):
        assert abs(table[1, labeler, pii.YES] - p) < 0.05 and abs(table[0, labeler, pii.NO] - p) < 0.05
    known = {tuple(code): p >= 0.5 for code, p in zip(codes.tolist(), posterior, strict=True)}
    guess = np.array([known[tuple(v)] for v in np.where(votes, pii.YES, pii.NO).tolist()])
    assert (guess == truth).mean() > 0.95


def test_classifier_learns_probabilities():
    features = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    weights = pii.fit(features, np.array([4000.0, 4000.0, 4000.0, 4000.0]), np.array([0.1, 0.1, 0.9, 0.9]))
    p = 1 / (1 + np.exp(-(np.hstack([features, np.ones((4, 1))]) @ weights)))
    assert np.abs(p - [0.1, 0.1, 0.9, 0.9]).max() < 0.02


def mixed_documents(count):
    draw = random.Random(1)
    rows = []
    for i in range(count):
        number = f"({draw.randint(212, 989)}) {draw.randint(234, 989)}-{draw.randint(1000, 9999)}"
        rows.append((4 * i, f"Please call our phone {number} or mail ann.{i}@mail{i % 9}.example.com today."))
        rows.append((4 * i + 1, f"See order 10.{draw.randint(1000, 9999)}.{draw.randint(300, 999)}.77777.12 and release {i}."))
        rows.append((4 * i + 2, f"write to bob{i} (at) mail{i % 7} (dot) org or tel +1 (310) 555-{1000 + i % 9000} now"))
        rows.append((4 * i + 3, "Nothing to see at example.com, version 2.0.1, section 4.0 of 1999."))
    return rows


def test_proposed_spans(spark):
    rows = mixed_documents(60)
    found = spans_of(personal_data(documents(spark, rows)))
    texts = dict(rows)
    for doc_id, spans in found.items():
        kinds = [kind for kind, *_ in spans]
        if doc_id % 4 == 0:
            assert kinds == ["phone", "email"] and [base for *_, base in spans] == [False, True], texts[doc_id]
            assert texts[doc_id][spans[0][1] : spans[0][2]].startswith("(")
        elif doc_id % 4 == 2:
            assert kinds == ["email", "phone"] and texts[doc_id][spans[0][1] : spans[0][2]].endswith("org")
        else:
            assert spans == [], texts[doc_id]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (None, "x@y.zz"), (3, "é x@y.zz 😀 1.2.3.4"), (4, "@" * 500), (5, "\0+1\n")]
    found = personal_data(clashing(documents(spark, rows)))
    lines = sorted((row["doc_id"] or 0, [(s["kind"], s["start"], s["end"]) for s in row["spans"]]) for row in found.collect())
    own = [("email", 0, 6)]
    assert lines == [(0, own), (0, own), (1, []), (2, []), (3, [("email", 2, 8), ("ip", 11, 18)]), (4, []), (5, [])]


def test_text_longer_than_a_batch(spark):
    long = "wort " * 3_600_000 + "a@b.cd " + "7" * 200_000 + "x" * 1_000_000 + " +1 (310) 555-2020"
    found = spans_of(personal_data(documents(spark, [(1, long), (2, "b@c.de")])))
    assert found[2] == [("email", 0, 6, True)]
    assert [(kind, long[a:b]) for kind, a, b, _ in found[1]] == [("email", "a@b.cd"), ("phone", "+1 (310) 555-2020")]


def test_counts_do_not_depend_on_partitions(spark):
    rows = mixed_documents(20) * 2
    once = sorted(map(str, personal_data(documents(spark, rows).repartition(7)).collect()))
    assert once == sorted(map(str, personal_data(documents(spark, rows).coalesce(1)).collect()))


def test_empty(spark):
    assert personal_data(documents(spark, [])).count() == 0
    assert spans_of(personal_data(documents(spark, [(1, "plain words")]))) == {1: []}
