"""Near-duplicates by one-permutation MinHash with optimal densification.

One hash splits a document's shingles into BINS bins and keeps the smallest of
each; an empty bin borrows from a bin found by its own fixed probe order, the
same in all documents. Bands of bins give buckets. A bucket proposes star-shaped
pairs only: its most connected member against the others. Pairs are confirmed on
full shingle sets. What a star leaves open (members of one bucket that are not yet
known to belong together) goes into a further round with more centres per bucket,
without those that were centres before, until nothing is open; so every pair that
shares a bucket is compared, or known to be connected, or cannot be linked. Two
members cannot be linked if what sets them apart from the first centre is too much:
with A what a member adds to the centre's set and R what it lacks, they differ by
|A1| + |A2| + ||R1| - |R2|| shingles at least, unless they add a shingle in common.
Copies of one text with edits of their own are told apart by this without being
compared. Nor can they be linked if too many parts of the hash range hold an odd number of
shingles of one and an even number of the other: each needs a shingle of one set alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, lean, objects, pick, text_bytes
from factloom.llm.graph import components
from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise

SHINGLE = 5
SIMILAR = 80
BINS = 256
# Bins of a band, and bands. A pair of similarity 0.8 (0.85) misses all of them once in 3e5 (4e8) times.
BAND, BANDS = 6, 42
# Parts of the hash range that shingles are counted in.
PARTS = 1024
# Centres of a bucket in a round: so many times those of the round before.
CENTRE_GROWTH = 16
# Words a task remembers the hashes of before it starts anew.
REMEMBERED_WORDS = 200_000

_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _odd(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray, add: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x + np.uint64(add)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(raw: bytes, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; lower-cases A-Z, words end at ASCII white space."""
    parts = raw.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    taken = min(size, len(parts))
    weights = _WEIGHTS[:taken] if size <= len(_WEIGHTS) else _odd(size, 11)[:taken]
    total = np.full(len(parts) - taken + 1, taken, dtype=np.uint64)
    for i, weight in enumerate(weights):
        total += hashes[i : len(parts) - taken + 1 + i] * weight
    return np.unique(_mixed(total))


_WEIGHTS = _odd(16, 11)
_PROBES = np.array([np.random.default_rng((13, i)).permutation(BINS) for i in range(BINS)])
_STARTS = np.arange(BINS, dtype=np.uint64) << _BIN_SHIFT
_BAND_WEIGHTS = _odd(BAND * BANDS, 17).reshape(-1, BAND)
_BAND_SALT = _odd(BANDS, 19)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin. Hashes are sorted, so it is the first at or after the bin's start."""
    place = np.minimum(np.searchsorted(shingles, _STARTS), len(shingles) - 1)
    values = shingles[place]
    filled = (values >> _BIN_SHIFT) == np.arange(BINS, dtype=np.uint64)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        donors = _PROBES[empty]
        values[empty] = values[donors[np.arange(len(empty)), filled[donors].argmax(axis=1)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = (values[: BAND * BANDS].reshape(-1, BAND) * _BAND_WEIGHTS).sum(axis=1, dtype=np.uint64)
    return _mixed(keys + _BAND_SALT).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each part of the hash range is odd, 64 parts to a number."""
    counts = np.bincount((shingles >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def differing(left: Column, right: Column) -> Column:
    """By how many shingles two sets differ at least: each that only one of them has changes the parity of one part."""
    total = F.lit(0)
    for i in range(PARTS // 64):
        total = total + F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i))))
    return total


def set_print(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        first, second = _mixed(shingles, 1).sum(dtype=np.uint64), _mixed(shingles, 2).sum(dtype=np.uint64)
    return int(first).to_bytes(8, "little") + int(second).to_bytes(8, "little")


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, sha, n (set size), print, and bands (null for an empty set) of every document."""
    bounded_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            sizes, prints, bands, shas = [], [], [], []
            for raw in text_bytes(batch["text"]):
                found = shingle_set(raw, words, shingle)
                sizes.append(len(found))
                prints.append(set_print(found))
                bands.append(band_keys(signature(found)) if len(found) else None)
                shas.append(hashlib.sha256(raw).hexdigest())
            yield pd.DataFrame(
                {
                    "id": batch["id"], "sha": objects(shas), "n": sizes, "print": objects(prints),
                    "bands": objects(bands),
                }
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    source = pick(docs, id_col, text_col).toDF("id", "text")
    return source.mapInPandas(run, f"id {id_type}, sha string, n long, print binary, bands array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, n, shingles (binary, sorted) and parity from node, print, text; rows whose set has another print (hex) are left out."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            rows = []
            for node, expected, raw in zip(batch["node"], batch["print"], text_bytes(batch["text"]), strict=True):
                found = shingle_set(raw, words, shingle)
                if set_print(found).hex().upper() == expected:
                    rows.append((node, len(found), found.tobytes(), parities(found)))
            yield pd.DataFrame(rows, columns=["node", "n", "shingles", "parity"], dtype=object)

    schema = "node long, n long, shingles binary, parity array<long>"
    return texts.select("node", "print", "text").mapInPandas(run, schema)


def _compared(similar: int):
    """Size of the intersection of two sorted sets, and so many of the shingles that only the first one has
    that two linked sets with any such shingle in common have one of these in common (the prefix filter)."""

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        common, added = [], []
        for a, b in zip(left, right, strict=True):
            a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            place = np.searchsorted(b, a)
            place[place == len(b)] = 0
            inside = b[place] == a
            own = a[~inside]
            most = (100 - similar) * (len(a) + len(a) * 100 // similar + 1) // (100 + similar)
            common.append(int(inside.sum()))
            added.append(own[: most + 1].view(np.int64))
        return pd.DataFrame({"common": common, "added": objects(added)})

    return F.pandas_udf(run, "struct<common: long, added: array<long>>")


def differences(n: Column, m: Column, similar: int) -> Column:
    """The most shingles by which linked sets of n and m shingles differ."""
    return F.floor((100 - similar) * (n + m) / (100 + similar))


def compare(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """a, b, linked, adds (size of what a adds to b), lacks, added: the pairs compared on their full sets.

    ``linked`` is 100 * intersection >= similar * union. Sets of ``a`` travel to ``b``, of
    which many pairs share one; AQE splits a hot one.
    """
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("right"))
    met = left.join(broadcast_if_small(pairs), "a").join(right, "b")
    counted = met.select("a", "b", "n_a", "n_b", _compared(similar)("left", "right").alias("c"))
    common = F.col("c.common")
    return counted.select(
        "a", "b", (100 * common >= similar * (F.col("n_a") + F.col("n_b") - common)).alias("linked"),
        (F.col("n_a") - common).alias("adds"), (F.col("n_b") - common).alias("lacks"), "c.added",
    )


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, shingle: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, text_sha256.

    Two documents are linked when 100 * |intersection| >= ``similar`` * |union| of
    their sets of distinct ``shingle``-word shingles. A text with fewer words is one
    shingle, its whole word sequence. A null text is empty; a document without words
    has an empty set and is linked with nothing, not even another such document.
    ``component_id`` is the smallest id reachable over links; ids that are null count
    only if there is no other. ``kept`` says whether it is the document's own id. Equal
    sets are one node from the start, so copies cost nothing; repeated rows, and rows
    that share an id, are members like others. An empty table gives an empty result;
    other columns are ignored. Shingles are compared by 64-bit hashes.
    """
    return _components(docs, similar, shingle, id_col, text_col).drop("first_of_component").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def first_of_components(docs: DataFrame, similar: int = SIMILAR, shingle: int = SHINGLE, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """One row per document: id, text_sha256, kept. Of each component, ``kept`` marks one pair of id and text.

    That is the smallest id, null only if there is no other, and the smallest hash among the texts under this id.
    """
    return _components(docs, similar, shingle, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("sha").alias("text_sha256"), F.col("first_of_component").alias("kept")
    )


def _components(docs: DataFrame, similar: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, sha, n, component_id and first_of_component of every document, as the functions above give them."""
    rows = materialise(signatures(docs, shingle, id_col, text_col), "signatures")
    # Ids alone do not name a text: they may be null or shared.
    first_row = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "sha"))
    nodes = materialise(
        rows.where("n > 0").groupBy("print").agg(first_row.alias("first"), F.count(F.lit(1)).alias("members"),
             F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(members.join(sizes, "bucket"), "shared")
    degree = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    known = materialise(degree.join(nodes.select("node", "n", "print", "first", "members"), "node"), "candidates")

    as_key = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")
    wanted = known.select("node", F.hex("print").alias("print"), "first.id", "first.sha").select("node", "print", as_key, "sha")
    texts = pick(docs, id_col, text_col).toDF("id", "text")
    texts = texts.select(as_key, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"), "text")
    sets = materialise(shingle_sets(key_lookup(texts, wanted, ["key", "sha"], "inner", "text"), shingle), "sets")
    # Rows that are equal in id and text give the set of their node several times.
    several = known.where("members > 1").select("node")
    if several.take(1):
        once = sets.join(broadcast_if_small(several), "node", "left_semi").dropDuplicates(["node"])
        others = sets.join(broadcast_if_small(several), "node", "left_anti")
        sets = others.unionByName(materialise(once, "sets-of-copies"))

    labels = _link(shared, known.select("node", "n", "degree"), sets, similar)
    first = nodes.select("node", "print", "first")
    if labels is None:
        classes = first.select("print", "first")
    else:
        placed = first.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = placed.groupBy("label").agg(F.min("first").alias("first"))
        classes = placed.drop("first").join(smallest, "label").select("print", "first")
    full = rows.where("n > 0").select("id", "sha", "n", "print").join(classes, "print")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sha") == F.col("first.sha"))
    full = full.select("id", "sha", "n", F.col("first.id").alias("component_id"), is_first.alias("first_of_component"))
    empty = rows.where("n = 0").select("id", "sha", "n", F.col("id").alias("component_id"), F.lit(True).alias("first_of_component"))
    return full.unionByName(empty)


def _link(shared: DataFrame, known: DataFrame, sets: DataFrame, similar: int) -> DataFrame | None:
    """Labels (node, label) of all nodes with links; None without any. Rounds of stars as described above."""
    # The first round compares every star; parities are carried only by what it leaves open.
    open_rows = shared.select("bucket", "node").join(known, "node")
    links, compared, labels, centres_of_round = None, None, None, 1
    while True:
        by_rank = Window.partitionBy("bucket").orderBy(F.desc("degree"), "node")
        centres = open_rows.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= centres_of_round)
        centre = centres.select(
            "bucket", F.col("node").alias("centre"), F.col("n").alias("n_centre"), "place", *_named(centres)
        )
        ranked = open_rows.join(centres.select("bucket", "node", F.col("place").alias("own")), ["bucket", "node"], "left")
        near_size = F.least("n", "n_centre") * 100 >= F.greatest("n", "n_centre") * similar
        pairs = ranked.join(centre, "bucket").where(
            (F.col("node") != F.col("centre")) & (F.col("own").isNull() | (F.col("own") > F.col("place"))) & near_size
        )
        if "label" in open_rows.columns:
            most = differences(F.col("n"), F.col("n_centre"), similar)
            alike = differing(F.col("parity"), F.col("centre_parity")) <= most
            apart = F.col("adds") + F.col("centre_adds") + F.abs(F.col("lacks") - F.col("centre_lacks"))
            near = F.coalesce((apart <= most) | F.arrays_overlap("added", "centre_added"), F.lit(True))
            pairs = pairs.where((F.col("label") != F.col("centre_label")) & alike & near)
        pairs = pairs.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
        if compared is not None:
            turned = compared.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = pairs.join(compared.unionByName(turned), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        sizes = materialise(compare(pairs, sets, similar), "compared")
        new = sizes.where("linked").select("a", "b")
        if new.take(1):
            links = new if links is None else links.unionByName(new)
            labels = components(links)
        rest = open_rows.join(centres.select("bucket", "node"), ["bucket", "node"], "left_anti")
        if centres_of_round == 1:
            # How the members differ from the first centre goes on with them.
            first = centre.select("bucket", F.col("centre").alias("b"))
            seen = sizes.select(F.col("a").alias("node"), "b", "adds", "lacks", "added")
            rest = rest.select("bucket", "node").join(first, "bucket").join(seen, ["node", "b"], "left").drop("b")
        rest = rest.select("bucket", "node", "adds", "lacks", "added").join(known, "node").join(sets.select("node", "parity"), "node")
        if labels is not None:
            rest = rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        else:
            rest = rest.withColumn("label", F.col("node"))
            labels = known.select("node", F.col("node").alias("label"))
        undecided = rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        open_rows = materialise(rest.join(undecided.select("bucket"), "bucket", "left_semi"), "open")
        if not open_rows.take(1):
            return labels if links is not None else None
        centres_of_round *= CENTRE_GROWTH


def _named(centres: DataFrame) -> list:
    later = ("label", "parity", "adds", "lacks", "added")
    return [F.col(name).alias(f"centre_{name}") for name in later if name in centres.columns]
