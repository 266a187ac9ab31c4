"""Postings against a plain loop, with facts that are grouped in one go and in many."""

from __future__ import annotations

import pytest

from factloom.functions.text import query_tokens
from factloom.operators import index

COLUMNS = "summary string, detail string, symbols_text string"
FACTS = "fact_id long, repo string, category string, confidence double, source string, ts timestamp, linked boolean, " + COLUMNS
TEXTS = [
    (1, "one two one", "Two three", "ONE"),
    (1, "one two one", "Two three", "ONE"),
    (2, None, "", None),
    (None, "Café two", None, "two"),
    (3, "", "--", "x1"),
    (4, "a b c d e f g h a", "h g f", ""),
]


def expected(texts):
    rows = []
    for fact_id, *columns in texts:
        places, counts, length = {}, {}, 0
        for i, text in enumerate(columns):
            for place, token in enumerate(query_tokens(text or "")):
                places.setdefault(token, []).append(place + i * index.COLUMN_SPAN)
                counts.setdefault(token, [0, 0, 0])[i] += 1
                length += 1
        rows += [(str(fact_id), token, length, *counts[token], tuple(found)) for token, found in places.items()]
    return sorted(rows)


@pytest.mark.parametrize("at_once", [1, 7, index.WORDS_AT_ONCE])
def test_postings_do_not_depend_on_how_many_words_are_grouped(spark, monkeypatch, at_once):
    monkeypatch.setattr(index, "WORDS_AT_ONCE", at_once)
    facts = [(i, "r", None, 0.5, "scan", None, True, *texts) for i, *texts in TEXTS]
    found = index.posting_rows(spark.createDataFrame(facts, FACTS).coalesce(1)).collect()
    rows = [(str(r.fact_id), r.token, r.doc_len, r.tf0, r.tf1, r.tf2, tuple(r.positions)) for r in found]
    assert sorted(rows) == expected(TEXTS)
    assert {(r.repo, r.category, r.confidence, r.source, r.ts, r.linked) for r in found} == {("r", None, 0.5, "scan", None, True)}
