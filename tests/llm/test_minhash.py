from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import clashing, documents, rows_of

from factloom.llm import minhash as op
from factloom.llm.graph import components


def shingles(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def expected(rows, similar):
    """All pairs of different sets, then the smallest id of every component."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                label[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        least = min((x for x in members[root(i)] if x is not None), default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def corpus(seed=2):
    """Families of a text and its edited copies, chains of copies, and unrelated texts with common words."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]

    def edited(text, edits):
        own = text.split(" ")
        for _ in range(edits):
            own[draw.randrange(len(own))] = draw.choice(words)
        return " ".join(own)

    texts = []
    for _ in range(12):
        base = " ".join(draw.choice(words) for _ in range(draw.choice([4, 6, 30, 120, 400])))
        texts += [base] + [edited(base, draw.randint(0, 6)) for _ in range(12)]
        chain = base
        for _ in range(8):
            chain = edited(chain, 1)
            texts.append(chain)
    texts += [" ".join(draw.choice(words) for _ in range(60)) for _ in range(40)]
    long = [draw.choice(words) for _ in range(200)]
    texts += [" ".join(long[:n]) for n in range(60, 200, 9)] + [" ".join(long[n:]) for n in range(5, 140, 11)]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("similar", [80, 85])
def test_against_all_pairs(spark, similar):
    rows = corpus()
    found = op.near_duplicates(clashing(documents(spark, rows)), similar)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == expected(rows, similar)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [
        (9, None), (8, ""), (7, " \t\n"), (6, "One two"), (5, "one  TWO"), (4, "one two three"), (None, "one two"),
        (None, "null only"), (3, long), (2, long + " end"), (2, long + " end"), (2, "same id, other text, not alike at all"),
        (11, "É é"), (12, "é é"), (13, "a\xa0b c d e f"), (14, "a b c d e f"),
    ]
    found = op.near_duplicates(documents(spark, rows), 85)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == expected(rows, 85)
    assert op.near_duplicates(documents(spark, [])).collect() == []
    assert rows_of(op.near_duplicates(documents(spark, [(1, ""), (2, None)])), "doc_id", "component_id") == [(1, 1), (2, 2)]


@pytest.mark.parametrize("edits", [8, 25])
def test_no_pair_explosion(spark, monkeypatch, edits):
    """A family whose copies are like the original only, or not even that: few comparisons per copy, not one per pair."""
    base = [f"b{i}" for i in range(400)]
    draw = random.Random(1)
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        own = list(base)
        for place in draw.sample(range(400), edits):
            own[place] = f"n{i}_{place}"
        rows.append((i, " ".join(own)))
    counted = []
    real = op.compare
    monkeypatch.setattr(op, "compare", lambda pairs, *more: counted.append(pairs.count()) or real(pairs, *more))
    found = op.near_duplicates(documents(spark, rows), 80)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == expected(rows, 80)
    assert sum(counted) < 8 * len(rows)


def test_texts_of_null_ids_are_fetched_once(spark, monkeypatch):
    """Many candidates without an id: each text is fetched for its own set, not for all of them."""
    fetched, plain = [], op.shingle_sets

    def watched(texts, shingle):
        fetched.append(texts.count())
        return plain(texts, shingle)

    monkeypatch.setattr(op, "shingle_sets", watched)
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(20)]
    rows = [(None, text + end) for text in texts for end in ("", " end", "")]
    got = rows_of(op.near_duplicates(documents(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == expected(rows, op.SIMILAR) and fetched == [len(rows)]


def test_densification_and_bands():
    """Equal sets have equal signatures; the share of equal bins is near the similarity, also for small sets."""
    draw = np.random.default_rng(0)
    for size in (12, 100, 3000):
        near = []
        for _ in range(60):
            both = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            part = np.sort(np.delete(both, draw.choice(len(both), len(both) // 6, replace=False)))
            a, b = op.signature(both), op.signature(part)
            assert len(a) == op.BINS and (op.signature(both) == a).all()
            near.append((a == b).mean())
        assert abs(np.mean(near) - 5 / 6) < 0.05


def test_parities_never_rule_out_a_link(spark):
    """Parities differ in no more parts than the sets in shingles, whatever the sets; counted natively."""
    draw = np.random.default_rng(6)
    rows, apart = [], []
    for n in (1, 5, 60, 400, 3000, 60_000):
        for share in (0.0, 0.05, 0.2, 1.0):
            pool = np.unique(draw.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
            a, b = pool[:n], np.sort(np.concatenate([pool[int(n * share) : n], pool[n : n + int(n * share)]]))
            rows.append((op.parities(a).tolist(), op.parities(b).tolist()))
            apart.append(len(np.setxor1d(a, b)))
    crowd = np.arange(100_000, dtype=np.uint64)
    rows.append((op.parities(crowd).tolist(), op.parities(crowd[:50_000]).tolist()))
    apart.append(50_000)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    found = [r[0] for r in df.select(op.differing(df.a, df.b)).collect()]
    assert found == [sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + (1 << 64)).bit_count() for x, y in zip(a, b)) for a, b in rows]
    assert all(least <= most for least, most in zip(found, apart, strict=True))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 130)} == {100}
    assert found[200] == found[201] == 200
