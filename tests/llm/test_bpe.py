from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import clashing, documents
from pyspark.sql import functions as F

from factloom.llm import bpe as op

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ROWS = [
    (1, None), (2, ""), (3, " "), (4, "Hello  world\n\n it's"), (4, "Hello  world\n\n it's"), (None, "no id <|endoftext|>"),
    (5, "ab" * 100_000), (6, "tab\t \n\xa0 nbsp em　\x1c\x85 end \t"), (7, "日本語 ñandú 🙂🙂 12345"), (8, "the " * 50_000),
]
PARTS = [" ", "  ", "\n", "\t", " \n", "\xa0", " ", "foo", "Bar.", "!", "'s", "12", "é", "日本", "\x1c", "\r\n", "\x85", "_"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=op.load_ranks(RANKS), special_tokens={})


def test_stretches_never_cut_a_pretoken(library):
    draw = np.random.default_rng(3)
    for _ in range(5000):
        text = "".join(PARTS[i] for i in draw.integers(0, len(PARTS), draw.integers(0, 12)))
        words = op.stretches(text)
        assert "".join(words) == text
        assert [i for w in words for i in library.encode_ordinary(w)] == library.encode_ordinary(text), repr(text)


@pytest.mark.parametrize(("bucket_bytes", "batch_bytes"), [(1 << 10, 1 << 12), (1 << 30, 1 << 24)])
def test_encode_and_decode(spark, library, monkeypatch, bucket_bytes, batch_bytes):
    """Equal to the library, with many chunks and buckets or one of each; decoding gives the bytes back."""
    monkeypatch.setattr(op, "CHUNK_BYTES", batch_bytes)
    rows = [*ROWS, *[(100 + i, f"word{i % 7} other{i} " * (i % 5)) for i in range(200)]]
    coded = op.encode_documents(clashing(documents(spark, rows)), RANKS, PATTERN, bucket_bytes)
    found = coded.withColumn("back", op.decoded(F.col("ids"), RANKS)).collect()
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.back)) for r in found), key=repr)
    assert all(r.back == r.decoded for r in found)
    wanted = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert got == sorted(wanted, key=repr)


def test_text_longer_than_a_batch(spark, library):
    long = "längere Wörter, und 1234567 Zahlen\n" * 500_000
    coded = op.encode_documents(documents(spark, [(1, long), (2, "kurz"), (3, None)]), RANKS, PATTERN)
    one = library.encode_ordinary("längere Wörter, und 1234567 Zahlen\n" * 3)
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in coded.collect()}
    assert found[2] == library.encode_ordinary("kurz") and found[3] == []
    assert found[1][: len(one)] == one and library.decode(found[1]) == long


def test_repeated_rows_make_no_large_group(spark):
    """Half of all rows are one text: a chunk names its words once, whatever their number."""
    rows = [(i, "the same text " * 50 if i % 2 else f"other text {i}") for i in range(4000)]
    source = documents(spark, rows).repartition(4).toDF("id", "text")
    stored = op.chunks(source, PATTERN, 16, "bigint")
    words = sum(len(op.expand_rising(r.numbers)) for r in stored.where(F.col("bucket") >= 0).collect())
    assert words <= 4 * 10 + 2 * 4000
    coded = op.encode_documents(documents(spark, rows), RANKS, PATTERN, 1 << 14)
    assert coded.count() == 4000
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_words_are_put_together_in_parts(monkeypatch):
    monkeypatch.setattr(op, "WORDS_AT_ONCE", 3)
    words = [[1, 2], [], [7], [4, 5, 6]]
    sizes = np.array([len(w) for w in words])
    flat = np.array([i for w in words for i in w], dtype="<u4")
    sequence = np.array([3, 0, 1, 2, 2, 3, 0, 1], dtype="<u4")
    found = np.frombuffer(op.put_together(sequence, np.cumsum(sizes) - sizes, sizes, flat), "<u4").tolist()
    assert found == [i for n in sequence for i in words[n]]


def test_empty_table(spark):
    assert op.encode_documents(documents(spark, []), RANKS, PATTERN).collect() == []


def test_decoding_null_and_unknown_ids(spark):
    assert spark.sql("SELECT CAST(null AS BINARY) AS ids").select(op.decoded(F.col("ids"), RANKS)).first()[0] is None
    with pytest.raises(Exception, match="index out of range"):
        spark.sql("SELECT X'FFFFFF0F' AS ids").select(op.decoded(F.col("ids"), RANKS)).collect()
