from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from helpers import clashing, documents, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (1, None), (2, ""), (3, "  \n "), (4, "one two"), (4, "one two"), (None, "no id"), (5, "word " * 5000),
    (6, "x" * 30000), (7, "Ünï\tcode\r\n　日本 <|endoftext|> 'S don't"), (8, "a" * 2047 + " b"),
]


def first_fit(lengths, capacity):
    """Brute force: longest first, into the first bin with room."""
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        place = next((b for b, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
        if place == len(bins):
            bins.append(0)
        out[i] = (place, bins[place])
        bins[place] += lengths[i]
    return out


def test_words_are_cut_like_the_tokenizer_does_and_share_their_parts():
    signs = ["'s", "'LL", "<|endoftext|>", "ß", "É", "ÿ", "Ÿ", "ſ", "×", "İ", "e\u0301", "Σ", "Ⅷ", "ﬁ", "\u212a", "\x00", "\x1f", "\x85", "1", "½"]
    draw = np.random.default_rng(7)
    letters = [chr(c) for c in range(0x21, 0x250) if not chr(c).isspace()] + signs * 30
    words = ["".join(draw.choice(letters, n)) for n in draw.integers(1, 8, 4000)] + letters
    encode = op.WordEncoder(PATH)
    wanted = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(words, add_special_tokens=False)]
    assert [ids.tolist() for ids in encode(words)] == wanted

    encode, seen = op.WordEncoder(PATH), []
    model = encode.plain.tokenize
    encode.plain.tokenize = lambda part: seen.append(part) or model(part)
    list(encode(["Haus, haus. (haus)", "HAUS! haus"]))
    assert seen.count("haus") == 1 and len(seen) == 6


def test_tournament_tree_is_first_fit_decreasing():
    draw = np.random.default_rng(4)
    for count in (1, 2, 3, 7, 64, 65, 500):
        lengths = draw.integers(1, 101, count)
        bins, offsets = op.first_fit_decreasing(lengths, 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == first_fit(lengths.tolist(), 100)


def check(found, rows, sequence):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = {}
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for start in range(0, len(ids), sequence):
            piece = ids[start : start + sequence]
            key = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
            wanted[key] = wanted.get(key, 0) + 1
    got, sequences = {}, {}
    for r in found:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded))
    assert got == wanted
    for pieces in sequences.values():
        at = 0
        for offset, length, padded in sorted(pieces):
            assert offset == at
            at += length
        assert at <= sequence and padded == (at if at & (at - 1) == 0 else sequence)


def test_pieces_and_sequences(spark):
    for sequence in (2048, 16):
        check(op.pack_documents(clashing(documents(spark, ROWS)), PATH, sequence).collect(), ROWS, sequence)


def test_groups_are_independent_and_all_packed(spark):
    rows = [(i, "word " * (i % 40)) for i in range(400)]
    found = op.pack_documents(documents(spark, rows), PATH, 64, group_pieces=50).collect()
    check(found, rows, 64)
    assert len({r.sequence_id >> 32 for r in found}) > 4


def test_empty_table(spark):
    assert rows_of(op.pack_documents(documents(spark, []), PATH)) == []


def test_words_encode_as_the_whole_text_does():
    tokenizer, encode = Tokenizer.from_file(PATH), op.WordEncoder(PATH)
    draw = np.random.default_rng(8)
    parts = [" ", "\n", "\t", "\xa0", "\x1c", "Foo", "bar.", "'s", "é", "é", "́", "12", "ΣΑΣ", "日本", "!?", " "]
    texts = ["".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 12))) for _ in range(3000)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_cut_at_words(monkeypatch):
    monkeypatch.setattr(op, "CHARS_AT_ONCE", 50)
    encoder = op.WordEncoder(PATH)
    texts = ["ein wort " * 40, "x" * 300, "", "a\nb " * 30 + "y" * 120, " ", "kurz"]
    whole = [encoder._ids(text).tolist() for text in texts]
    assert [ids.tolist() for ids in encoder(iter(texts))] == whole
    assert "".join(op.parts_of(texts[3], 50)) == texts[3]


def test_equal_rows_are_dealt_over_groups(spark):
    """A third of all rows are one document: no group grows with it."""
    rows = [(1, "same words") if i % 3 == 0 else (i, f"word {i}") for i in range(3000)]
    packed = op.pack_documents(documents(spark, rows).repartition(4), PATH, group_pieces=100)
    sizes = [r["n"] for r in packed.groupBy(F.shiftright("sequence_id", 32).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 200


def test_few_remembered_words_give_the_same_ids():
    texts = ["one two three (four) Five", "six two one", "", "three four five six seven"]
    few = op.WordEncoder(PATH, 2)
    assert [ids.tolist() for text in texts for ids in few([text])] == [ids.tolist() for ids in op.WordEncoder(PATH)(texts)]
    few(["x"])
    assert len(few.known) < 20
