from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers import clashing, documents

from factloom.llm import quality as op


@pytest.fixture(scope="module")
def net():
    return op.new_network(5)


def test_whole_texts_are_scored(net):
    """Texts laid together and long texts in parts give what one pass over each text gives."""
    draw = np.random.default_rng(1)
    texts = [bytes(draw.integers(0, 250, n, dtype=np.uint8)) for n in (0, 1, 15, 16, 17, 33, 500, 300_000, 4, 131_072)]
    together = op.pooled(net, texts)
    for row, raw in zip(together, texts, strict=True):
        np.testing.assert_allclose(row, op.responses(net, op.blocks(raw))[0].max(axis=0), rtol=1e-4, atol=1e-5)


def test_every_place_counts(net):
    raw = bytearray(b"plain words here " * 3000)
    before = op.pooled(net, [bytes(raw)])
    for place in (0, 20_000, len(raw) - 40):
        changed = raw.copy()
        changed[place : place + 32] = bytes(range(200, 232))
        assert (op.pooled(net, [bytes(changed)]) != before).any()


def test_gradients(net):
    """Loss falls on a separable sample and held-out rows are told apart."""
    draw = np.random.default_rng(2)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor"]

    def text(bad):
        own = [words[i] for i in draw.integers(0, 6, draw.integers(5, 60))]
        return (" ".join(w.upper() + "!!" for w in own) if bad else " ".join(own)).encode()

    labels = np.array([i % 2 for i in range(400)], dtype=np.float32)
    texts = [text(bad=not label) for label in labels]
    fitted = op.fit(texts[:300], labels[:300], np.ones(300, np.float32), epochs=6)
    assert ((op.score_texts(fitted, texts[300:]) > 0.5) == (labels[300:] > 0.5)).mean() > 0.97


def test_rows(spark, net):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "é" * 200_000)]
    found = op.quality_scores(clashing(documents(spark, rows)), net).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].score == by_id[2].score and by_id[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert op.quality_scores(documents(spark, []), net).count() == 0


def test_training_sample(spark):
    """Bounded, without held-out rows, nulls and long texts; a document with two labels is good only if both say so."""
    docs = documents(spark, [(i, f"text {i}") for i in range(100)] + [(200, "x" * 40_000), (None, "n"), (300, None)])
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(100)] + [(200, 1), (None, 1), (300, 1), (1, 0), (2, None)], "doc_id long, quality int"
    )
    sample = op.training_rows(docs, clashing(labels), rows=20)
    ids = [int(t.split()[1]) for t in sample["text"]]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids) and len(ids) <= 40
    assert all(label == (i % 2 and i != 1) for i, label in zip(ids, sample["label"], strict=True))
    assert len(op.training_rows(documents(spark, []), labels)) == 0
    untrained = op.train(docs, labels.where("false"))
    assert 0 < op.score_texts(untrained, [b"any"])[0] < 1


def test_held_out_accuracy(spark, sf_dir):
    """On the given tables: nearly all good held-out documents stay, most bad ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = op.quality_scores(docs, op.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert (good.predicted == 1).mean() >= 0.95 and (bad.predicted == 0).mean() >= 0.7
