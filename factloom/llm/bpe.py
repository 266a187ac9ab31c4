"""Byte-level BPE by a global shuffle of distinct words.

A word is one match of the pre-token pattern. Documents are read once: those of an Arrow
batch, a chunk, become sequences of word numbers, by position, and the chunk's distinct
words are dealt into buckets by hash. A bucket gathers its words of all chunks, encodes
each distinct one once, and sends its ids back to the chunks that asked, which put them
together by position. Decoding looks ids up in the token-byte table.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, objects, pick
from factloom.session import materialise_bucketed

# Bytes of text for which there is one bucket of words.
BUCKET_BYTES = 32 << 20
# Bytes of text of a chunk: the larger, the fewer words are named by several chunks.
CHUNK_BYTES = 16 << 20
# Numbers of words that are put together at one time.
WORDS_AT_ONCE = 1 << 20
# Bucket of the row that holds a chunk's documents.
DOCUMENTS = -1

# Unicode white space, as the pre-token pattern's \s has it (fixed values).
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RARE_WHITE = re.compile(f"[{WHITE.replace(' ', '').replace(chr(92) + 'n', '')}]")
STRETCHES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
ANY_STRETCHES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def stretches(text: str) -> list[str]:
    """White space and the run of other characters after it, one by one; together they are the text.

    No pre-token reaches across such a cut: one that holds other characters holds
    no white space after them, and how white space itself is split depends only on
    what is in the same stretch. So the pattern may run on distinct stretches alone.
    """
    return (ANY_STRETCHES if RARE_WHITE.search(text) else STRETCHES).findall(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_table(path: str) -> list[bytes]:
    """Bytes of every id; ids without a token are None."""
    ranks = load_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table for ``put_together``: where the bytes of every id start, how many they are, and all bytes."""
    table = [token or b"" for token in token_table(path)]
    sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(table), dtype=np.uint8)


def squeeze_rising(numbers: np.ndarray) -> bytes:
    """Numbers in rising order, as their steps."""
    return squeeze(np.diff(numbers, prepend=0))


def expand_rising(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data).astype(np.int64))


def squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed by planes of bytes."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def squeeze_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths and bytes of words, compressed."""
    lengths = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return squeeze(lengths), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def expand_words(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(expand(lengths).astype(np.int64)).tolist()
    whole = zstandard.ZstdDecompressor().decompress(data)
    return [whole[start:end] for start, end in zip([0, *ends], ends, strict=False)]


def chunk_of(texts: list[str | None], split) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, frequent ones first; how many words each text has; and their numbers by position."""
    numbers: dict[str, int] = {}
    known: dict[str, bytes] = {}
    found, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        size = 0
        for stretch in stretches(text):
            own = known.get(stretch)
            if own is None:
                own = np.array([numbers.setdefault(word, len(numbers)) for word in split(stretch)], dtype="<u4").tobytes()
                known[stretch] = own
            found.append(own)
            size += len(own)
        counts[i] = size // 4
    sequence = np.frombuffer(b"".join(found), dtype="<u4")
    order = np.argsort(-np.bincount(sequence, minlength=len(numbers)), kind="stable")
    place = np.empty(len(order), dtype="<u4")
    place[order] = np.arange(len(order), dtype="<u4")
    words = list(numbers)
    return [words[i].encode("utf-8", "surrogatepass") for i in order.tolist()], counts, place[sequence]


def chunks(docs: DataFrame, pattern: str, buckets: int, kind: str) -> DataFrame:
    """Rows of every chunk: its documents (ids, counts of words and numbers by position), and its words per bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = regex.compile(pattern).findall
        names = ["chunk", "bucket", "ids", "lengths", "data", "numbers"]
        for number, batch in enumerate(batches):
            if not len(batch):
                continue
            chunk = (TaskContext.get().partitionId() << 32) + number
            words, counts, sequence = chunk_of(batch["text"].tolist(), split)
            ids = [None if pd.isna(key) else key for key in batch["id"].tolist()]
            rows = [(chunk, DOCUMENTS, ids, squeeze(counts), squeeze(sequence), b"")]
            place = np.fromiter((zlib.crc32(word) % buckets for word in words), dtype=np.int64, count=len(words))
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            for own in np.split(order, cuts) if len(words) else []:
                lengths, data = squeeze_words([words[i] for i in own.tolist()])
                rows.append((chunk, int(place[own[0]]), None, lengths, data, squeeze_rising(own)))
            yield pd.DataFrame(rows, columns=names)

    schema = f"chunk long, bucket int, ids array<{kind}>, lengths binary, data binary, numbers binary"
    return docs.mapInPandas(run, schema)


def encoded_words(words: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """chunk, numbers, lengths, data (ids): the words of all chunks, every distinct word of a bucket encoded once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        coder = encoding(ranks, pattern)
        known: dict[bytes, bytes] = {}
        out = []
        for chunk, lengths, data, numbers in zip(group["chunk"], group["lengths"], group["data"], group["numbers"], strict=True):
            ids = []
            for word in expand_words(lengths, data):
                own = known.get(word)
                if own is None:
                    text = word.decode("utf-8", "surrogatepass")
                    own = known[word] = np.array(coder.encode_ordinary(text), dtype="<u4").tobytes()
                ids.append(own)
            sizes = np.fromiter((len(own) // 4 for own in ids), dtype="<u4", count=len(ids))
            out.append((chunk, numbers, squeeze(sizes), squeeze(np.frombuffer(b"".join(ids), dtype="<u4"))))
        return pd.DataFrame(out, columns=["chunk", "numbers", "lengths", "data"])

    return words.groupBy("bucket").applyInPandas(run, "chunk long, numbers binary, lengths binary, data binary")


def put_together(sequence: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """The ids of words given by their numbers (or the bytes of ids), one after the other."""
    out = []
    for low in range(0, len(sequence), WORDS_AT_ONCE):
        part = sequence[low : low + WORDS_AT_ONCE]
        size = sizes[part]
        ends = np.cumsum(size)
        shift = np.repeat(starts[part] - (ends - size), size)
        out.append(flat[shift + np.arange(len(shift))].tobytes())
    return b"".join(out)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """id, ids (binary, little-endian 32-bit) and decoded (the bytes that these ids stand for) of every whole text.

    A null text is empty and has no ids. Null ids and repeated rows are encoded
    like others. An empty table gives an empty result; other columns are ignored.
    The result does not depend on ``bucket_bytes``, nor on how rows are dealt.

    A chunk is one Arrow batch, so it ends at its bytes; a text has to fit a row. A chunk
    names a word once, so a bucket holds its share of words and no word makes it larger.
    What is stored are compressed word numbers (about a third of the texts) and each
    chunk's distinct words; only these and their ids are shuffled.
    """
    bounded_batches(docs.sparkSession, CHUNK_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()
    source = pick(docs, id_col, text_col).toDF("id", "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    stored = materialise_bucketed(chunks(source, pattern, buckets, kind), "chunks", "chunk", buckets)
    words = stored.where(F.col("bucket") != DOCUMENTS).select("bucket", "chunk", "lengths", "data", "numbers")
    rows = stored.where(F.col("bucket") == DOCUMENTS).select("chunk", "ids", "lengths", "data")

    def reassemble(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        numbers = [expand_rising(own) for own in words["numbers"]]
        lengths = [expand(own).astype(np.int64) for own in words["lengths"]]
        flat = np.concatenate([expand(own) for own in words["data"]] or [np.zeros(0, dtype="<u4")])
        place = np.concatenate(numbers or [np.zeros(0, dtype=np.int64)])
        sizes, starts = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        if len(place):
            in_order = np.concatenate(lengths)
            sizes[place], starts[place] = in_order, np.cumsum(in_order) - in_order
        keys, out, back = [], [], []
        table = token_bytes(ranks)
        for ids, counts, data in zip(rows["ids"], rows["lengths"], rows["data"], strict=True):
            sequence = expand(data)
            ends = np.cumsum(expand(counts).astype(np.int64)).tolist()
            keys += list(ids)
            for low, high in zip([0, *ends], ends, strict=False):
                out.append(put_together(sequence[low:high], starts, sizes, flat))
                back.append(put_together(np.frombuffer(out[-1], dtype="<u4"), *table))
        return pd.DataFrame({"id": objects(keys), "ids": objects(out), "decoded": objects(back)})

    both = rows.groupBy("chunk").cogroup(encoded_words(words, ranks, pattern).groupBy("chunk"))
    found = both.applyInPandas(reassemble, f"id {kind}, ids binary, decoded binary")
    return found.select(F.col("id").alias(id_col), "ids", "decoded")


def decoded(ids: Column, ranks: str) -> Column:
    """Bytes of a column of ids, looked up in the token-byte table (as large as the vocabulary file, never larger).

    Null gives null. An id that the table lacks fails the job: the ids are not of this vocabulary.
    """

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = token_bytes(ranks)
        for batch in batches:
            if any(data and np.frombuffer(data, dtype="<u4").max() >= len(table[0]) for data in batch):
                raise IndexError("token index out of range of the vocabulary")
            yield objects([None if data is None else put_together(np.frombuffer(data, dtype="<u4"), *table) for data in batch])

    return decode(ids)
