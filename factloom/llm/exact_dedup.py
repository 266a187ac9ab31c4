"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text is cut into byte chunks whose polynomial hashes are computed side by side
(one matrix product for all chunks of a batch). The hash of a text follows from
them by length-shifted sums, H(ab) = H(a) * BASE^len(b) + H(b), so a huge text costs
one pass in fixed memory. Texts with equal fingerprint and length are then compared
chunk by chunk: within each chunk place the smallest and the largest chunk of the
group are taken (combined before the shuffle, so a group of any size moves a few
rows per task), and the texts are equal when the two agree everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, lean, pick, text_bytes
from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise

# Two primes below 2^31 and a base for each. A sum of 1024 products of a byte
# (1 to 256) and a residue stays below 2^53, so float64 products are exact.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
HASH_CHUNK = 1024
# Chunks hashed by one product, a few MB.
CHUNKS_AT_ONCE = 512
# Bytes of the chunks that are compared.
COMPARE_CHUNK = 1 << 16


def _powers(base: int, prime: int, count: int) -> np.ndarray:
    out = np.empty(count, dtype=np.int64)
    value = 1
    for i in range(count):
        out[i] = value
        value = value * base % prime
    return out


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    """Hash of a concatenation from the hashes of its parts."""
    return (left * pow(base, right_length, prime) + right) % prime


def chunk_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bases, primes) -> np.ndarray:
    """Polynomial hashes (byte + 1 as digits) of the chunks under every base and prime; short chunks are padded in front."""
    weights = np.stack([_powers(b, p, HASH_CHUNK)[::-1] for b, p in zip(bases, primes, strict=True)], axis=1).astype(np.float64)
    out = np.empty((len(starts), len(primes)), dtype=np.int64)
    column = np.arange(HASH_CHUNK, dtype=np.int32) - HASH_CHUNK
    for low in range(0, len(starts), CHUNKS_AT_ONCE):
        at, size = starts[low : low + CHUNKS_AT_ONCE], lengths[low : low + CHUNKS_AT_ONCE]
        inside = column >= -size[:, None]
        digits = np.where(inside, data[np.where(inside, (at + size)[:, None] + column, 0)] + 1.0, 0.0)
        out[low : low + CHUNKS_AT_ONCE] = (digits @ weights).astype(np.int64) % np.array(primes)
    return out


def fingerprint_texts(texts: list[bytes], primes=PRIMES, bases=BASES) -> np.ndarray:
    """One 62-bit fingerprint per text. The first chunk of a text is the short one."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-sizes // HASH_CHUNK)
    result = np.zeros(len(texts), dtype=np.int64)
    if not counts.sum():
        return result
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    number = np.arange(len(owner)) - first[owner]
    following = counts[owner] - 1 - number
    begin = np.cumsum(sizes) - sizes
    ends = begin[owner] + sizes[owner] - following * HASH_CHUNK
    starts = np.maximum(begin[owner], ends - HASH_CHUNK)
    filled = np.flatnonzero(counts)
    found = chunk_hashes(data, starts, ends - starts, bases, primes)
    for hashes, prime, base in zip(found.T, primes, bases, strict=True):
        shift = _powers(pow(base, HASH_CHUNK, prime), prime, int(following.max()) + 1)
        shifted = hashes * shift[following] % prime
        total = np.zeros(len(texts), dtype=np.int64)
        total[filled] = np.add.reduceat(shifted, first[filled]) % prime
        result = result << 31 | total
    return result


def fingerprints(docs: DataFrame, id_col: str, text_col: str, primes=PRIMES, bases=BASES) -> DataFrame:
    """id, text, fp, n_bytes for every row; null texts are empty."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("struct<fp: long, n_bytes: long>")
    @lean
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            raw = text_bytes(texts)
            yield pd.DataFrame({"fp": fingerprint_texts(raw, primes, bases), "n_bytes": [len(t) for t in raw]})

    return (
        pick(docs, id_col, text_col)
        .toDF("id", "text")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("print", fingerprint("text"))
        .select("id", "text", "print.fp", "print.n_bytes")
    )


def differing_groups(suspects: DataFrame, chunk: int = COMPARE_CHUNK) -> DataFrame:
    """(fp, n_bytes) whose texts are not all equal, found by comparing chunk by chunk.

    Takes fp, n_bytes and text. A chunk place of a group moves at most two chunks
    per task, whatever the number of its rows.
    """
    data = F.col("text").cast("binary")
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / chunk).cast("int")))
    chunks = suspects.select(
        "fp", "n_bytes", F.transform(places, lambda i: F.substring(data, i * chunk + 1, F.lit(chunk))).alias("chunks")
    ).select("fp", "n_bytes", F.posexplode("chunks").alias("place", "chunk"))
    compared = chunks.groupBy("fp", "n_bytes", "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return compared.where(F.col("low") != F.col("high")).select("fp", "n_bytes").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES,
                     bases=BASES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text is empty, and empty texts
    equal each other. Of a group, the row with the largest id stays (null ids are
    below all others). Rows that repeat both id and text are members of their
    group like any other: they count, and exactly one row of a group is kept.
    Rows with one id and different texts are different documents. An empty table
    gives an empty result; other columns are ignored.

    Texts that merely share a fingerprint are told apart by their SHA-256 once
    the comparison has found that the group differs.
    """
    prints = fingerprints(docs, id_col, text_col, primes, bases)
    rows = materialise(
        prints.select("id", "fp", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "fingerprints"
    )
    shared = rows.groupBy("fp", "n_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = materialise(shared, "shared-fingerprints")
    suspects = prints.join(broadcast_if_small(shared), ["fp", "n_bytes"], "left_semi")
    differing = differing_groups(suspects).withColumn("differs", F.lit(True))

    classed = (
        rows.groupBy("id", "fp", "n_bytes", "sha")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(broadcast_if_small(materialise(differing, "differing")), ["fp", "n_bytes"], "left")
        .withColumn("apart", F.when(F.col("differs"), F.col("sha")).otherwise(F.lit("")))
        .drop("differs")
    )
    key = ["fp", "n_bytes", "apart"]
    # Most texts have one id: only groups of more meet their rows again, and a hot one is split.
    groups = classed.groupBy(*key).agg(F.max("id").alias("largest"), F.sum("copies").alias("size"), F.count(F.lit(1)).alias("ids"))
    groups = materialise(groups.where("ids > 1").drop("ids"), "groups-of-copies")
    return (
        key_lookup(classed, groups, key, "left", "id")
        .select(
            "id", "sha", "copies", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("largest")).alias("keep_id"),
            F.coalesce("size", "copies").alias("group_size"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
