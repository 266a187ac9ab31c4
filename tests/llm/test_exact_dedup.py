from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
from helpers import clashing, documents, rows_of

from factloom.llm import exact_dedup as op


def expected(rows):
    """Brute force: groups of equal texts; of equal rows the first of the largest id is kept."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, done = max(known, default=None), False
        for i in ids:
            kept = not done and i == keep
            done |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "only null ids"), (None, "only null ids"),
    (5, "é" * 70000), (6, "é" * 70000), (7, "é" * 69999 + "e"), (8, "a\0"), (9, "\0a"), (9, "other text, same id"),
]


def test_against_brute_force(spark):
    assert rows_of(op.exact_duplicates(documents(spark, ROWS))) == expected(ROWS)
    assert rows_of(op.exact_duplicates(clashing(documents(spark, ROWS)))) == expected(ROWS)


def test_empty_table(spark):
    found = op.exact_duplicates(documents(spark, []))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and found.count() == 0


def test_colliding_fingerprints_are_told_apart(spark):
    """With tiny primes nearly all texts of one length share a fingerprint."""
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice("ab") for _ in range(draw.randint(1, 4)))) for i in range(200)]
    weak = op.exact_duplicates(documents(spark, rows), primes=(2, 3), bases=(1, 1))
    assert rows_of(weak) == expected(rows)


def test_fingerprints_compose():
    draw = np.random.default_rng(2)
    raw = bytes(draw.integers(0, 256, 5000, dtype=np.uint8))
    prime, base = op.PRIMES[0], op.BASES[0]

    def plain(data):
        value = 0
        for byte in data:
            value = (value * base + byte + 1) % prime
        return value

    for cut in (0, 1, 1023, 1024, 2500, 5000):
        left, right = raw[:cut], raw[cut:]
        assert op.combine(plain(left), plain(right), len(right), base, prime) == plain(raw)
    assert op.fingerprint_texts([b"", raw, raw[:1024], raw[:1]])[1] >> 31 == plain(raw)
    assert op.fingerprint_texts([raw[:1025], b"", raw]).tolist() == [
        int(op.fingerprint_texts([x])[0]) for x in (raw[:1025], b"", raw)
    ]
