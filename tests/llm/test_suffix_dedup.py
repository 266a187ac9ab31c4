from __future__ import annotations

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, documents, rows_of

from factloom.llm import suffix_dedup as op

N = op.LENGTH


def brute(texts):
    """Covered ranges by counting every string of N bytes."""
    counts = Counter(raw[p : p + N] for raw in texts for p in range(len(raw) - N + 1))
    return [op.unite((p, p + N) for p in range(len(raw) - N + 1) if counts[raw[p : p + N]] > 1) for raw in texts]


def corpus(seed, alphabet=b"abcdefgh ", count=30):
    draw = random.Random(seed)

    def noise(n):
        return bytes(draw.choice(alphabet) for _ in range(n))

    base = [noise(draw.choice([50, 150, N - 1, N, N + 1, 300, 900])) for _ in range(6)]
    texts = []
    for _ in range(count):
        own = b"".join(
            draw.choice(base) if draw.random() < 0.5 else noise(draw.randint(1, 400)) for _ in range(draw.randint(0, 5))
        )
        if draw.random() < 0.2:
            own += (noise(draw.randint(1, 9)) * 400)[: draw.randint(100, 900)]
        texts.append(own)
    return texts


@pytest.mark.parametrize("seed", range(8))
def test_runs_and_merge(seed):
    """Runs, front-coded blocks and the loser tree, without Spark: spans, order and common prefixes."""
    texts = list(dict.fromkeys(corpus(seed)))
    hashes = np.concatenate([op._twice_at_most(op.anchors_of(np.frombuffer(t, np.uint8))[1]) for t in texts])
    own, counts = np.unique(hashes, return_counts=True)
    wanted = own[counts > 1]
    hot = wanted[::2] if seed % 2 else wanted[:0]
    runs = defaultdict(list)
    for i, raw in enumerate(texts):
        entries = op.entries_of(i, raw, wanted, hot)
        if entries is not None:
            runs[i % (1, 3, 7)[seed % 3]].append(entries)
    spans, blocks = [], []
    for parts in runs.values():
        entries = op.Entries.join(parts).sorted()
        again, leader = op.repeats(entries, op.common_prefixes(entries.rows))
        spans.append(op.covered(entries, again))
        rest = op.trimmed(entries, again, leader)
        pieces = [rest.take(np.arange(low, min(low + 37, len(rest)))) for low in range(0, len(rest), 37)]
        blocks.append([op.front_coded(p, op.common_prefixes(p.rows)) for p in pieces])
    blocks = [b for b in blocks if b]
    if len(blocks) > 1:
        merged, prefixes = op.merge_blocks(blocks)
        assert (prefixes[1:] == op.common_prefixes(merged.rows)[1:]).all()
        rows = [r.tobytes() for r in merged.rows]
        assert rows == sorted(rows)
        spans.append(op.covered(merged, op.repeats(merged, prefixes)[0]))
    found = defaultdict(list)
    for frame in spans:
        for node, start, end in frame.itertuples(index=False):
            found[node].append((start, end))
    assert [op.unite(found[i]) for i in range(len(texts))] == brute(texts)


def check(spark, rows, **options):
    texts = [(t or "").encode() for _, t in rows]
    wanted = [
        (doc_id, len(raw), sum(b - a for a, b in spans), len(spans), op.without(raw, spans))
        for (doc_id, _), raw, spans in zip(rows, texts, brute(texts), strict=True)
    ]
    found = op.remove_repeats(clashing(documents(spark, rows)).repartition(5), **options)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()), key=repr)
    assert got == sorted(wanted, key=repr)


@pytest.mark.parametrize("hot_anchor", [op.HOT_ANCHOR, 2])
def test_against_brute_force(spark, monkeypatch, hot_anchor):
    monkeypatch.setattr(op, "RANGE_ENTRIES", 20)
    texts = [t.decode() for t in corpus(50, count=60)]
    check(spark, list(enumerate(texts)), hot_anchor=hot_anchor)


def test_defined_cases(spark):
    draw = random.Random(4)
    passage = "".join(draw.choice("abcdefghij ") for _ in range(260))
    exact, short = passage[:N], passage[: N - 1]
    accents = "é" * 50 + "".join(draw.choice("äöü") for _ in range(200))
    rows = [
        (1, None), (2, ""), (3, short), (4, short), (5, exact), (5, exact), (6, "x" + exact + "y"), (None, "z" + passage), (None, None),
        (7, "1" + passage[30:] + "2" + passage), (8, "ab" * 3000), (9, "q" * N), (10, "r" * (N + 1)), (11, accents + "1"),
        (12, "é" + accents), (13, "".join(draw.choice("abcdefghijklmnop") for _ in range(150_000)) + passage), (14, "\0" * 500),
    ]
    check(spark, rows)
    assert rows_of(op.remove_repeats(documents(spark, []))) == []


def test_long_texts_are_segmented():
    """Anchors do not depend on where a segment ends."""
    draw = np.random.default_rng(1)
    data = draw.integers(97, 123, op.SEGMENT + 5000, dtype=np.uint8)
    place, hashes, first, last = op.anchors_of(data)
    assert (last - first).sum() + len(first) == len(data) - N + 1
    again = op.anchors_of(data[op.SEGMENT - 1000 :])
    start = {int(h): 1 for h in again[1]}
    assert all(int(h) in start for h, p in zip(hashes, place, strict=True) if p >= op.SEGMENT - 1000 + N)


def test_spans_of_whole_characters():
    raw = "aéb".encode()
    assert op.whole_characters(raw, [(0, 2)]) == [(0, 1)]
    assert op.whole_characters(raw, [(2, 4)]) == [(3, 4)]
    assert op.whole_characters(raw, [(1, 3)]) == [(1, 3)] and op.whole_characters(raw, [(2, 3)]) == []


def test_what_a_run_passes_on_takes_little_more_than_its_rows():
    """A long run makes no tables of its full size beside its rows."""
    count = 30_000
    rows = np.random.default_rng(3).integers(97, 123, (count, op._WIDTH), dtype=np.uint8)
    number = np.arange(count, dtype=np.int64)
    entries = op.Entries(rows, number, number + N, np.full(count, 5), np.full(count, op.WINDOW - 3), np.full(count, N - op.WINDOW + 1))
    none = np.zeros((count, op.WINDOW), dtype=bool)
    tracemalloc.start()
    out = op.trimmed(entries, none, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * rows.nbytes
    assert len(out) == count and not out.rows[~op._used(out)].any() and out.rows[op._used(out)].all()
