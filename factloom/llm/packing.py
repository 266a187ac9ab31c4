"""Packing of tokenised documents into fixed sequences: first-fit decreasing.

Documents are tokenised and cut into pieces of at most one sequence. Pieces are
dealt into randomised groups of bounded size; each group is packed on its own by
first-fit decreasing. The first bin with room is found in a tournament tree whose
inner nodes hold the largest free capacity below them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, lean, pick
from factloom.session import materialise

SEQUENCE = 2048
END_ID = 1
# Pieces of one group. A group is one task's work: a few MB, whatever the input.
GROUP_PIECES = 16384
# Distinct words a task remembers the ids of before it starts anew.
REMEMBERED_WORDS = 400_000
# Characters of texts whose words are held at one time, and new words that go through the tokenizer together, at most.
CHARS_AT_ONCE = 1 << 20
WORDS_AT_ONCE = 4096

# Steps of a tokenizer before its model by which words of Latin letters and ASCII signs are cut alike by PLAIN_PARTS.
PLAIN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# U+00C0 to U+017F are composed letters but for two; U+0130 is left out, whose lower case is two signs.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN_LETTERS = re.compile(f"[A-Za-z{_LATIN}]+")
PLAIN_WORD = re.compile(f"[!-~{_LATIN}]+")
PLAIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^0-9a-z{_LATIN}]+")

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


@lru_cache(maxsize=2)
def word_encoder(path: str, remembered: int) -> WordEncoder:
    """One encoder per Python worker, so that tasks after the first know most words."""
    return WordEncoder(path, remembered)


class PlainWords(dict):
    """Word -> ids for tokenizers that lower-case words and cut them as PLAIN_SPLIT says; a missing word is encoded.

    Words of Latin letters and ASCII signs are cut here, and only parts that are new (``haus``
    of ``Haus``, ``haus,`` and ``(haus)``) go through the model; others go through the whole
    tokenizer.
    """

    def __init__(self, tokenizer, encode: Callable[[str], np.ndarray], added: list[str]):
        self.tokenize, self.encode = tokenizer.model.tokenize, encode
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        cut = tokenizer.pre_tokenizer.pre_tokenize_str
        letters = filter(re.compile(f"[{_LATIN}]").fullmatch, map(chr, range(0xC0, 0x180)))
        self.as_bytes = {ord(letter): cut(letter)[0][0] for letter in letters}

    def __missing__(self, word: str) -> bytes:
        if not PLAIN_WORD.fullmatch(word) or self.added.search(word):
            ids = self.encode(word).tobytes()
        else:
            low = word.lower()
            parts = [low] if PLAIN_LETTERS.fullmatch(low) else PLAIN_PARTS.findall(low)
            if parts == [word]:
                found = [token.id for token in self.tokenize(word if word.isascii() else word.translate(self.as_bytes))]
                ids = struct.pack(f"<{len(found)}I", *found)
            else:  # a part is a word of its own, and remembered as one
                ids = b"".join([self[part] for part in parts])
        self[word] = ids
        return ids


def plain_words(tokenizer, encode: Callable[[str], np.ndarray]) -> PlainWords | None:
    """The same, if the tokenizer's steps before its model are those that PLAIN_PARTS stands for."""
    whole = json.loads(tokenizer.to_str())
    steps, cut, model = whole["normalizer"] or {}, whole["pre_tokenizer"] or {}, whole["model"]
    split = {"type": "Split", "pattern": {"Regex": PLAIN_SPLIT}, "behavior": "Removed", "invert": True}
    as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    found = [{k: v for k, v in step.items() if k != "trim_offsets"} for step in cut.get("pretokenizers", [])]
    added = [token["content"] for token in whole["added_tokens"]]
    known = (
        steps.get("normalizers") == PLAIN_NORMALIZER and found == [split, as_bytes]
        and model["type"] == "BPE" and not model.get("dropout")
        and whole["truncation"] is None and whole["padding"] is None
        and not any(PLAIN_LETTERS.fullmatch(token) for token in added)
    )
    return PlainWords(tokenizer, encode, added) if known else None


class WordEncoder:
    """Token ids of texts for tokenizers that drop white space between words.

    Spaces and line ends never take part in a token there, so a text may be cut at
    them; each distinct word is encoded once and remembered (see ``PlainWords``). For
    other tokenizers, new words go through the tokenizer together, with MARK between them
    to tell their ids apart.
    """

    MARK = "\0"

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.remembered = REMEMBERED_WORDS if remembered is None else remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.mark_id = self._ids(self.MARK)[0] if len(self._ids(self.MARK)) == 1 else None
        self.plain = plain_words(self.tokenizer, self._ids)
        if self.plain is not None:
            self.known = self.plain

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if self.MARK not in w] if self.mark_id is not None else []
        for low in range(0, len(plain), WORDS_AT_ONCE):
            part = plain[low : low + WORDS_AT_ONCE]
            ids = self._ids(f" {self.MARK} ".join([*part, ""]))
            ends = np.flatnonzero(ids == self.mark_id)
            starts = np.concatenate([[0], ends[:-1] + 1])
            data = ids.tobytes()
            for word, start, end in zip(part, (starts * 4).tolist(), (ends * 4).tolist(), strict=True):
                self.known[word] = data[start:end]
        for word in new:
            if word not in self.known:
                self.known[word] = self._ids(word).tobytes()

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        if self.plain is None:
            self._learn(list(set().union(*cut).difference(self.known)))
        look = self.known.__getitem__
        return (b"".join(map(look, words)) for words in cut)

    def __call__(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Words of about CHARS_AT_ONCE characters are held at one time, of a long text too."""
        held, size = [], 0
        for text in texts:
            if size + len(text) > CHARS_AT_ONCE and held:
                for data in self._encoded(held):
                    yield np.frombuffer(data, dtype="<u4")
                held, size = [], 0
            if len(text) > CHARS_AT_ONCE:
                parts = [data for part in parts_of(text, CHARS_AT_ONCE) for data in self._encoded([part])]
                yield np.frombuffer(b"".join(parts), dtype="<u4")
            else:
                held.append(text)
                size += len(text)
        for data in self._encoded(held):
            yield np.frombuffer(data, dtype="<u4")


def parts_of(text: str, size: int) -> Iterator[str]:
    """A text cut behind spaces or line ends into parts of about ``size`` characters; one word is never cut."""
    low = 0
    while low < len(text):
        high = low + size
        if high < len(text):
            ends = [place for place in (text.find(" ", high), text.find("\n", high)) if place >= 0]
            high = min(ends) + 1 if ends else len(text)
        yield text[low:high]
        low = high


def cut(doc_id, ids: np.ndarray, sequence: int) -> Iterator[tuple]:
    for start in range(0, len(ids), sequence):
        piece = ids[start : start + sequence]
        yield doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """Pieces of at most ``sequence`` ids of every document's ids with ``end_id`` at the end."""
    bounded_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(tokenizer, remembered)
        names = [part.split()[0] for part in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, own in zip(batch["id"], encode(text or "" for text in batch["text"]), strict=True):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                rows.extend(cut(None if pd.isna(doc_id) else int(doc_id), ids, sequence))
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            frame["id"] = frame["id"].astype("Int64")
            yield frame

    return pick(docs, id_col, text_col).toDF("id", "text").mapInPandas(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of equal length are placed in their given order.

    The tree holds the largest free capacity below each node. Going down to the
    left wherever the left child has room finds the first bin that fits.
    """
    count = len(lengths)
    leaves = 1 << max(0, int(count - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack_group(group: pd.DataFrame, sequence: int) -> pd.DataFrame:
    """Pack the pieces of one group; sequences get ids that no other group has."""
    group = group.sort_values(["order", "id", "start"], kind="stable").reset_index(drop=True)
    bins, offsets = first_fit_decreasing(group["length"].to_numpy(), sequence)
    used = np.bincount(bins, weights=group["length"]).astype(np.int64)
    padded = np.where((used & (used - 1)) == 0, used, sequence)
    out = group.drop(columns=["part", "order"])
    out["sequence_id"] = (int(group["part"].iloc[0]) << 32) + bins
    out["offset"] = offsets
    out["padded"] = padded[bins]
    return out


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID,
                   group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text",
                   remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded.

    A document's ids are those of its whole text and ``end_id``; a null text is empty
    and has ``end_id`` alone. A document longer than a sequence is cut every
    ``sequence`` ids; its last piece shares a sequence with other documents. Offsets
    run without gaps from 0. ``padded`` is the length of the sequence as written: its
    own if that is a power of two, else ``sequence``. Null ids and repeated rows are
    documents of their own and are packed like others. An empty table gives an
    empty result; other columns are ignored.

    Pieces (a few numbers each, no ids) are stored and counted, then dealt into
    groups of about ``group_pieces`` by a hash of their number, so no group grows with
    the input, whatever rows repeat. A worker remembers the ids of ``remembered`` words, about.
    """
    pieces = materialise(token_pieces(docs, tokenizer, sequence, end_id, id_col, text_col, remembered), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # Drawn for each stored row, so that equal rows do not meet in one group.
    shuffled = F.xxhash64(F.monotonically_increasing_id())
    dealt = pieces.withColumn("order", shuffled).withColumn("part", F.pmod("order", F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group["id"] = group["id"].astype("Int64")
        return pack_group(group, sequence)

    return dealt.groupBy("part").applyInPandas(run, PACKED).withColumnRenamed("id", id_col)
