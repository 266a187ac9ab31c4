"""Near-duplicate collapse by word overlap.

Rule: walking the rows of a group in order, a row is dropped if its word set
has a Jaccard overlap above 3/4 with a row kept before it. Rows without words
are always kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import IGNORED_WORDS, word_set
from factloom.operators.skew import BROADCAST_ROWS, ROWS_PER_SPLIT, broadcast_if_small, salted_lookup
from factloom.session import materialise

# Overlap must exceed NUM / DEN; kept as integers so that equality is exact.
NUM, DEN = 3, 4
# Smaller sets exceed it with no set but their equals (3 of 4 words is exactly 3/4).
SMALLEST_PARTNER = 4
# Centres that a bucket of likely copies shows one after the other before the tiles.
FIRST_FRONT = 8
# Most 64-bit parts of the parities of a set; a power of two. Up to 65,536 words, a set has as many places as words.
MAX_PARITY_PARTS = 1024
# Keys of a set (least hashes, two to a key) by which likely copies meet.
KEYS = 6
# Words that have a place of their own in the common order, the most frequent ones.
MAX_ORDERED = 1 << 19
# Buckets of groups, steps of sizes (a factor of 1.15), and sets and words of a bucket and step that one task takes.
GROUP_BUCKETS, SIZE_STEP, ROWS_PER_TILE, WORDS_PER_TILE = 256, 0.14, 1 << 16, 1 << 25
# Ids that are broadcast after they were counted.
BROADCAST_IDS = 1 << 21
# Words, pairs of equal words, and parts of parities of pairs that a task looks at at one time.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 20


def _exceeds(shared: Column, total: Column) -> Column:
    """Jaccard above NUM/DEN, from the overlap and the sum of both set sizes.

    shared / (total - shared) > NUM / DEN, written so that the overlap, which is
    costly to find, is evaluated once.
    """
    return (DEN + NUM) * shared > NUM * total


def collapse_ranked(
    rows: DataFrame, order: str = "place", groups: tuple[str, ...] = ("query_id", "repo"), text: str = "summary"
) -> DataFrame:
    """Collapse of a ranked result, independently per query and repository.

    Meant for top-k results, whose groups hold at most as many rows as the
    search limit; whole tables go through ``collapse_table``.
    """
    schema = T.StructType([T.StructField("__place", T.LongType()), T.StructField("__keep", T.BooleanType())])

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        flags = []
        part = part.sort_values("__place")
        for words in map(set, part["__words"]):
            twin = any(DEN * len(words & k) > NUM * len(words | k) for k in kept)
            if words and not twin:
                kept.append(words)
            flags.append(not words or not twin)
        return pd.DataFrame({"__place": part["__place"], "__keep": flags})

    keyed = rows.withColumn("__place", F.col(order).cast("long"))
    slim = keyed.select(*groups, "__place", word_set(F.col(text)).alias("__words"))
    schema = T.StructType([slim.schema[name] for name in groups] + schema.fields)

    def per_group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = walk(part)
        for i, name in enumerate(groups):
            out.insert(i, name, key[i])
        return out

    kept = slim.groupBy(*groups).applyInPandas(per_group, schema).where("__keep").drop("__keep")
    return keyed.join(kept, [*groups, "__place"], "left_semi").drop("__place")


@dataclass(frozen=True)
class Collapse:
    """Result of a whole-table collapse, by row id."""

    rows: DataFrame  # (group, id, words): the input
    sets: DataFrame  # (group, id, words, size, parities, keys): distinct word sets at their first row
    kept: DataFrame  # (group, id): surviving rows with words
    shown: DataFrame  # (id, size, bucket, step, prefix, parities, keys): sets of SMALLEST_PARTNER words or more
    edges: DataFrame  # (a, b, shared, total): similar pairs, all those of a kept row and a later one among them
    has_empty: bool
    order: tuple[np.ndarray, np.ndarray]  # the order of words that all prefixes follow

    def survivors(self) -> DataFrame:
        """Kept rows, and all rows without words."""
        if not self.has_empty:
            return self.kept
        return self.kept.unionByName(self.rows.where(F.size("words") == 0).select("group", "id"))


def _hashes() -> Column:
    """A set's words as numbers that differ between groups."""
    group = F.col("group")
    return F.transform("words", lambda word: F.xxhash64(group, word))


def _word_order(sets: DataFrame, most: int = MAX_ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words as sorted hashes, and the rank of each by frequency.

    They are counted over all sets. Words left out are rarer than all of these; at most ``most`` are listed.
    """
    blocks = sets.select(F.explode(_hashes()).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(blocks.where("n > 1"), "counts")
    level = F.floor(8 * F.log2("n")).cast("int")
    least = None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        most -= row["count"]
        if most < 0:
            break
        least = row["level"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    listed = counts.where(level >= least).toPandas()
    block, n = listed["block"].to_numpy(np.int64), listed["n"].to_numpy(np.int64)
    rank = np.empty(len(n), np.int32)
    rank[np.lexsort((block, n))] = np.arange(len(n), dtype=np.int32)
    by_hash = np.argsort(block)
    return block[by_hash], rank[by_hash]


def _pieces() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that cuts batches where their sets have about ``WORDS_AT_ONCE`` words."""
    at_once = WORDS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy().astype(np.int64))])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(before, before[low] + at_once, side="right")) - 1)
                yield batch.slice(low, high - low)
                low = high

    return run


def _shown(sets: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The sets with their prefixes: the rarest words, enough that any two similar sets share one.

    A set of size s overlaps a similar one in more than 3s/4 words, so it must share one
    of its first s - floor(3s/4) words in any order common to all; rare words first keeps
    the pairs few. A word is its rank or, if it has none, a negative number by hash: two
    words with one number only add candidates, which are verified anyway.
    """
    known = sets.sparkSession.sparkContext.broadcast(order)
    num, den, pieces = NUM, DEN, _pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ranks = known.value
        for batch in pieces(batches):
            hashes = batch.column("hashes").flatten().to_numpy()
            sizes = batch.column("size").to_numpy().astype(np.int64)
            number = (hashes & 0x7FFFFFFF) - (1 << 31)
            if len(blocks):
                place = np.minimum(np.searchsorted(blocks, hashes), len(blocks) - 1)
                number = np.where(blocks[place] == hashes, ranks[place], number)
            row = np.repeat(np.arange(len(sizes)), sizes)
            number = np.sort((row << 32) + number + (1 << 31)) - (row << 32) - (1 << 31)
            lengths = sizes - sizes * num // den
            place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = number[place < np.repeat(lengths, sizes)].astype(np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            out = {name: batch.column(name) for name in names}
            out["prefix"] = pa.ListArray.from_arrays(ends, pa.array(first))
            yield pa.RecordBatch.from_pydict(out)

    names = ["id", "size", "bucket", "step", "parities", "keys"]
    large = sets.where((F.col("size") >= SMALLEST_PARTNER) & F.col("id").isNotNull()).select(
        "id", "size", F.pmod(F.xxhash64("group"), F.lit(GROUP_BUCKETS)).cast("int").alias("bucket"),
        F.floor(F.log("size") / SIZE_STEP).cast("int").alias("step"), "parities", "keys", _hashes().alias("hashes"),
    )
    kinds = ", ".join(f"{name} {large.schema[name].dataType.simpleString()}" for name in names)
    return materialise(large.mapInArrow(run, f"{kinds}, prefix array<int>"), "prefix")


def _signed(sets: DataFrame) -> DataFrame:
    """With ``parities`` and ``keys`` of each set.

    Parities say whether the words of a set fall an odd number of times on each of 64, 128, ...
    places by hash, 64 places to a number; there are at least as many places as words, up to a
    bound. A key is made of the least of the words' hashes in two mixings.
    """
    parts, keys, pieces = MAX_PARITY_PARTS, KEYS, _pieces()
    names = [*sets.columns, "parities", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes = batch.column("hashes").flatten().to_numpy()
            sizes = batch.column("size").to_numpy().astype(np.int64)
            width = np.ones(len(sizes), np.int64)
            while (more := (sizes > 64 * width) & (width < parts)).any():
                width[more] *= 2
            ends = np.concatenate([[0], np.cumsum(width)])
            at = np.repeat(64 * ends[:-1], sizes) + (hashes & np.repeat(64 * width - 1, sizes))
            odd = (np.bincount(at, minlength=64 * int(ends[-1])) & 1).astype(np.uint8)
            parities = np.packbits(odd, bitorder="little").view(np.int64)
            least = np.zeros((len(sizes), 2 * keys), np.uint64)
            some = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[some]
            for i in range(2 * keys if len(starts) else 0):
                # Odd multipliers, so each mixing keeps words apart; its high bits depend on all.
                mixed = (hashes.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) * np.uint64(
                    0xD6E8FEB86659FD93 + 2 * i
                )
                least[some, i] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
            both = (least[:, ::2] * np.uint64(0xFF51AFD7ED558CCD) + least[:, 1::2]).view(np.int64)
            out = {name: batch.column(name) for name in names[:-2]}
            out["parities"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(parities))
            key_ends = np.arange(0, keys * len(sizes) + 1, keys, dtype=np.int32)
            out["keys"] = pa.ListArray.from_arrays(pa.array(key_ends), pa.array(both.ravel()))
            yield pa.RecordBatch.from_pydict(out)

    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in sets.schema)
    return sets.withColumn("hashes", _hashes()).mapInArrow(run, f"{kinds}, parities array<long>, keys array<long>")


def _parity_rows() -> Callable[[pa.Array, int], np.ndarray]:
    """A function that makes one row per set of its parities, at most ``most`` numbers each: halves are put together."""

    def run(lists: pa.Array, most: int) -> np.ndarray:
        ends, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
        width = np.diff(ends)
        out = np.zeros((len(width), most), np.uint64)
        for i in range(int(width.max(initial=0))):
            has = width > i
            out[has, i % most] ^= values[ends[:-1][has] + i]
        return out

    return run


def _differing() -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function that counts the differing parities of pairs, some at a time."""
    at_once = PAIRS_AT_ONCE

    def run(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        step = max(1, at_once // bits.shape[1])
        for i in range(0, len(a), step):
            out[i : i + step] = np.bitwise_count(bits[a[i : i + step]] ^ bits[b[i : i + step]]).sum(axis=1)
        return out

    return run


def _leaders(shown: DataFrame, centres: int, rows_per_tile: int) -> DataFrame:
    """(id): sets that are worth meeting all later ones, which leaves out likely copies of an earlier set.

    Sets of about the same size meet by key: the first ones of a key meet the later ones, whose
    parities tell which are near. A wrong guess costs time only, see ``_decided``.
    """
    num, den, parity_rows, differing = NUM, DEN, _parity_rows(), _differing()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").combine_chunks()
        size = table.column("size").to_numpy().astype(np.int64)
        lists = table.column("parities").combine_chunks()
        bits = parity_rows(lists, int(np.diff(lists.offsets.to_numpy()).min()))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(size), -1)
        rank = np.unique(table.column("id").to_numpy(), return_inverse=True)[1]
        open_ = np.ones(len(size), bool)
        for turn in range(centres):
            met = False
            for i in range(keys.shape[1]):
                rows = np.flatnonzero(open_)
                rows = rows[np.lexsort((rank[rows], keys[rows, i]))]
                key = keys[rows, i]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                run_ = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
                centre = starts[run_] + turn
                later = np.arange(len(rows)) > centre
                a, b = rows[centre[later]], rows[later]
                met |= len(a) > 0
                odd = differing(bits, a, b) / (32 * bits.shape[1])
                # So many words apart make so many parities differ on average.
                apart = -32 * bits.shape[1] * np.log(np.maximum(1 - odd, 1e-9))
                near = (den + num) * apart < (den - num) * (size[a] + size[b])
                near &= (den * np.minimum(size[a], size[b]) > num * np.maximum(size[a], size[b])) & (rank[a] < rank[b])
                open_[b[near]] = False
            if not met:
                break
        return pa.table({"id": ids.filter(pa.array(open_))})

    kind = shown.schema["id"].dataType.simpleString()
    cells = shown.groupBy("bucket", "step").agg(_parts(rows_per_tile))
    dealt = shown.select("id", "size", "bucket", "step", "parities", "keys").join(F.broadcast(cells), ["bucket", "step"])
    dealt = dealt.withColumn("part", F.pmod(F.element_at("keys", 1), F.col("parts")))
    return dealt.groupBy("bucket", "step", "part").applyInArrow(run, f"id {kind}")


def _parts(rows_per_tile: int) -> Column:
    """Into how many parts a cell is cut."""
    rows, words = F.count(F.lit(1)) / rows_per_tile, F.sum("size") / WORDS_PER_TILE
    return F.ceil(F.greatest(rows, words)).cast("int").alias("parts")


def _near_ids(shown: DataFrame, rows_per_tile: int) -> DataFrame:
    """(a, b): an earlier set that leads and a later one that is sought, which share a word of their prefixes and are near by their parities.

    Sets of a bucket of groups and of about the same size are a cell, cut into parts by id; a
    task meets two parts that similar sets can lie in. It goes over the words that both
    sides have, so pairs are never shuffled or stored. The sizes on the other side bound the
    overlap from below, which makes prefixes shorter.
    """
    spark, num, den, at_once, parity_rows = shown.sparkSession, NUM, DEN, PAIRS_AT_ONCE, _parity_rows()
    differing = _differing()
    tiles, members = _tiles(shown, rows_per_tile)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("id").combine_chunks()
        rank = np.unique(table.column("id").to_numpy(), return_inverse=True)[1].astype(np.int64)
        size = table.column("size").to_numpy().astype(np.int64)
        side, leads, sought = (table.column(name).to_numpy() for name in ("side", "leads", "sought"))
        lists = table.column("parities").combine_chunks()
        bits = parity_rows(lists, int(np.diff(lists.offsets.to_numpy()).min()))
        words = table.column("prefix").combine_chunks()
        ends, number = words.offsets.to_numpy().astype(np.int64), words.values.to_numpy().astype(np.int64)
        number = number[ends[0] : ends[-1]]
        length = np.diff(ends)
        owner = np.repeat(np.arange(len(size)), length)
        left = size[owner] - (np.arange(len(number)) - np.repeat(np.cumsum(length) - length, length))
        # By word, then by id, so that the earlier sets of a word are its first ones.
        key = (number << 32) + rank[owner]

        def met(first: np.ndarray, second: np.ndarray) -> Iterator[np.ndarray]:
            first, second = np.flatnonzero(first[owner]), np.flatnonzero(second[owner])
            first = first[np.argsort(key[first])]
            low = np.searchsorted(key[first], number[second] << 32)
            n = np.searchsorted(key[first], key[second]) - low
            second, low, n = second[n > 0], low[n > 0], n[n > 0]
            total, at = np.concatenate([[0], np.cumsum(n)]), 0
            while at < len(second):
                to = max(at + 1, int(np.searchsorted(total, total[at] + at_once, side="right")) - 1)
                # A word that very many sets have is taken in pieces too.
                for start in range(0, int(n[at]) if to == at + 1 else 1, at_once):
                    count = n[at:to] if to > at + 1 else np.minimum(n[at:to] - start, at_once)
                    shift = np.repeat(low[at:to] + start - (np.cumsum(count) - count), count)
                    x, y = first[shift + np.arange(len(shift))], np.repeat(second[at:to], count)
                    a, b = owner[x], owner[y]
                    fits = (den + num) * np.minimum(left[x], left[y]) > num * (size[a] + size[b])
                    a, b = a[fits], b[fits]
                    near = (den + num) * differing(bits, a, b) < (den - num) * (size[a] + size[b])
                    yield np.unique(a[near] * len(size) + b[near])
                at = to

        found = [np.empty(0, np.int64)]
        if (side == 2).all():
            found += met(leads, sought)
        else:
            found += met(leads & (side == 0), sought & (side == 1))
            found += met(leads & (side == 1), sought & (side == 0))
        pairs = np.unique(np.concatenate(found))
        return pa.table({"a": ids.take(pa.array(pairs // len(size))), "b": ids.take(pa.array(pairs % len(size)))})

    kind = shown.schema["id"].dataType.simpleString()
    listed = spark.createDataFrame(members, "bucket int, step int, parts int, part int, tiles array<struct<tile: int, side: int, least: int>>")
    hit = F.pmod(F.xxhash64("id"), F.col("parts")) == F.col("part")
    dealt = shown.join(F.broadcast(listed), ["bucket", "step"]).where(hit).select(
        "id", "size", "leads", "sought", "parities", "prefix", F.explode("tiles").alias("t")
    )
    smallest = F.greatest(F.col("t.least"), F.floor(F.col("size") * NUM / DEN) + 1)
    length = (F.col("size") - F.floor(NUM * (F.col("size") + smallest) / (DEN + NUM))).cast("int")
    dealt = dealt.where(length > 0).select(
        "t.tile", "t.side", "id", "size", "leads", "sought", "parities", F.slice("prefix", F.lit(1), length).alias("prefix")
    )
    tasks = max(1, min(tiles, max(4 * spark.sparkContext.defaultParallelism, sum(len(m[4]) for m in members) // 8)))
    return dealt.repartition(tasks, "tile").groupBy("tile").applyInArrow(run, f"a {kind}, b {kind}")


def _tiles(shown: DataFrame, rows_per_tile: int) -> tuple[int, list[tuple]]:
    """How many tiles there are, and for each part of a cell the tiles it lies in, on which side, and the least size it meets there.

    A cell is a bucket and a size step; there are some thousands at most.
    """
    sizes = [_parts(rows_per_tile), F.min("size").alias("low"), F.max("size").alias("high")]
    cells = {(r.bucket, r.step): r for r in shown.groupBy("bucket", "step").agg(*sizes).collect()}
    parts = {cell: r.parts for cell, r in cells.items()}
    lies: dict[tuple, list[tuple]] = {(cell, i): [] for cell, n in parts.items() for i in range(n)}
    tile = 0
    for cell, r in sorted(cells.items()):
        for other in [(cell[0], cell[1] + i) for i in range(int(math.log(DEN / NUM) / SIZE_STEP) + 2)]:
            if other not in cells or NUM * cells[other].low >= DEN * r.high:
                continue
            for i in range(parts[cell]):
                for j in range(i if other == cell else 0, parts[other]):
                    same = (cell, i) == (other, j)
                    lies[cell, i].append((tile, 2 if same else 0, cells[other].low))
                    if not same:
                        lies[other, j].append((tile, 1, r.low))
                    tile += 1
    return tile, [(*cell, parts[cell], i, tiles) for (cell, i), tiles in lies.items()]


def _halved(parities: Column) -> Column:
    """The parities of half as many places."""
    half = (F.size(parities) / 2).cast("int")
    return F.zip_with(F.slice(parities, F.lit(1), half), F.slice(parities, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _signs(sets: DataFrame, name: str) -> DataFrame:
    return sets.select(F.col("id").alias(name), F.col("size").alias(f"size_{name}"), F.col("parities").alias(f"p{name}"))


def _few_apart(met: DataFrame) -> DataFrame:
    """Pairs with the sizes and parities of both without those that cannot be similar.

    Every differing parity takes a word that one set has alone, and similar sets have fewer
    than (DEN - NUM) / (DEN + NUM) of the sum of their sizes of these. Sizes of similar sets
    are less than a factor of two apart, so their parities are too.
    """
    longer = F.size("pa") - F.size("pb")
    of_a = F.when(longer > 0, _halved(F.col("pa"))).otherwise(F.col("pa"))
    of_b = F.when(longer < 0, _halved(F.col("pb"))).otherwise(F.col("pb"))
    apart = F.aggregate(
        F.zip_with(of_a, of_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda n, x: n + x
    )
    near = DEN * F.least("size_a", "size_b") > NUM * F.greatest("size_a", "size_b")
    few = (DEN + NUM) * apart < (DEN - NUM) * (F.col("size_a") + F.col("size_b"))
    return met.where(near & few).select("a", "b")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return _few_apart(pairs.join(_signs(sets, "a"), "a").join(_signs(sets, "b"), "b"))


def _near_few(few: DataFrame, others: DataFrame) -> DataFrame:
    """The pairs of ``_near_ids`` for a few leaders, which are brought to all others, so that these stay where they are.

    Sizes bound the overlap, and so does the place of the first shared word:
    nothing before it is shared, so at most the shorter remainder is.
    """
    blocks = few.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.posexplode("prefix").alias("place_a", "block"))
    others = others.select(
        F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("parities").alias("pb"),
        F.posexplode("prefix").alias("place_b", "block"),
    )
    remainder = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    fits = _exceeds(remainder, F.col("size_a") + F.col("size_b"))
    met = others.join(F.broadcast(blocks), "block").where((F.col("a") < F.col("b")) & fits).drop("size_a")
    return _few_apart(met.join(F.broadcast(_signs(few, "a")), "a")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full word sets really overlap enough, with both counts.

    The candidates are stored first, and the word sets that they name, so that the others are not shuffled.
    """
    pairs = materialise(pairs, "near-pairs")
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    named = broadcast_if_small(materialise(named, "named"), max_rows=BROADCAST_IDS)
    words = materialise(sets.select("id", "group", "words").join(named, "id", "left_semi"), "named-sets")
    left = words.select(F.col("id").alias("a"), F.col("group").alias("ga"), F.col("words").alias("wa"))
    right = words.select(F.col("id").alias("b"), F.col("group").alias("gb"), F.col("words").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    total = F.size("wa") + F.size("wb")
    return (
        pairs.join(left, "a").join(right, "b").where(F.col("ga").eqNullSafe(F.col("gb")))
        .select("a", "b", shared.alias("shared"), total.alias("total"))
        .where(_exceeds(F.col("shared"), F.col("total")))
    )


def _similar(shown: DataFrame, leaders: DataFrame, sets: DataFrame, rows_per_tile: int) -> DataFrame:
    """Verified pairs of a leader and a later set that is ``sought``."""
    few = shown.join(leaders, "id", "left_semi")
    longs = F.sum(F.size("prefix") + F.size("parities"))
    if few.agg(F.coalesce(longs, F.lit(0))).first()[0] <= BROADCAST_ROWS:
        near = _near_few(materialise(few, "few"), shown.where("sought"))
    else:
        marked = leaders.distinct().withColumn("leads", F.lit(True))
        near = shown.join(marked, "id", "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
        near = _near_ids(near, rows_per_tile).distinct()
    return materialise(_verified(near, sets), "edges")


def _settled(edges: DataFrame) -> DataFrame | None:
    """Ids that a walk in id order drops: those with an edge from an earlier id that is not dropped."""
    dropped, left = None, edges.select("a", "b")
    while not left.isEmpty():
        sure = left.select("a").join(left.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        fresh = materialise(left.join(sure, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        dropped = fresh if dropped is None else dropped.unionByName(fresh)
        left = left.join(fresh.select(F.col("id").alias("b")), "b", "left_anti")
        left = materialise(left.join(fresh.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b"), "open-edges")
    return dropped


def _decided(
    shown: DataFrame, leaders: DataFrame, sets: DataFrame, rows_per_tile: int
) -> tuple[DataFrame, DataFrame | None]:
    """All edges that were met, and the ids of the sought sets that are dropped.

    Leaders meet all later sets. A walk over their edges alone then drops sets. A set that is not
    dropped and does not lead might drop others itself: such sets lead as well, and the
    walk is repeated. When none is left, all kept sets have met all later ones, so the walk is that of the rule.
    """
    edges, led = None, leaders
    while True:
        new = _similar(shown, leaders, sets, rows_per_tile)
        edges = new if edges is None else edges.unionByName(new)
        dropped = _settled(edges)
        rest = shown.select("id").join(led, "id", "left_anti")
        leaders = materialise(rest if dropped is None else rest.join(dropped, "id", "left_anti"), "leaders")
        if leaders.isEmpty():
            return edges, dropped
        led = led.unionByName(leaders)


def collapse_table(
    rows: DataFrame,
    group: str = "repo",
    row_id: str = "fact_id",
    text: str = "summary",
    ignored: tuple[str, ...] = IGNORED_WORDS,
    rows_per_split: int = ROWS_PER_TILE,
    first_front: int = FIRST_FRONT,
) -> Collapse:
    """Exact collapse of a whole table, rows of a group taken in ``row_id`` order.

    1. Equal word sets are reduced to their first row. This loses nothing: a
       later copy is always dropped, by its first row or by the row that
       dropped that one.
    2. Likely copies are set aside: the first ``first_front`` sets of a key meet the
       others of the key. All other sets lead.
    3. Leaders meet all later sets, in tiles of at most ``rows_per_split`` sets a side, and
       near ones are verified on their words.
    4. A walk over these pairs keeps and drops. Sets that were set aside but are not
       dropped lead as well, until there are none.

    A group of near copies costs a few comparisons per row, never one per pair. Pairs that
    share a rare word without being near are looked at inside the task that holds both
    and are never stored.
    """
    worded, stored = _word_sets(rows, group, row_id, text, ignored)
    has_empty = not stored.where("size = 0").isEmpty()
    sets = stored.where("size > 0")
    order = _word_order(sets.where(F.col("size") >= SMALLEST_PARTNER))
    shown = _shown(sets, order)
    leaders = materialise(_leaders(shown, first_front, rows_per_split), "leaders")
    edges, dropped = _decided(shown.withColumn("sought", F.lit(True)), leaders, sets, rows_per_split)
    return Collapse(worded, sets, _kept_sets(sets, dropped), shown, edges, has_empty, order)


def extend_collapse(
    result: Collapse,
    rows: DataFrame,
    group: str = "repo",
    row_id: str = "fact_id",
    text: str = "summary",
    ignored: tuple[str, ...] = IGNORED_WORDS,
    rows_per_split: int = ROWS_PER_TILE,
    first_front: int = FIRST_FRONT,
) -> Collapse:
    """The collapse after further rows, whose ids lie above all earlier ones.

    What was decided stays: no row depends on later ones. New word sets that are known
    already are copies. The others are sought by kept rows and by each other. Earlier rows
    never meet each other again, and the order of words, on which prefixes rest, stays
    that of the first rows.
    """
    worded, stored = _word_sets(rows, group, row_id, text, ignored)
    has_empty = result.has_empty or not stored.where("size = 0").isEmpty()
    new = stored.where("size > 0").withColumn("digest", _digest())
    known = result.sets.select("group", _digest().alias("digest"))
    fresh = materialise(new.join(known, ["group", "digest"], "left_anti").drop("digest"), "new-sets")
    shown = _shown(fresh, result.order)
    earlier = result.shown.join(result.kept.select("id"), "id", "left_semi")
    leaders = materialise(_leaders(shown, first_front, rows_per_split).unionByName(earlier.select("id")), "leaders")
    both = earlier.withColumn("sought", F.lit(False)).unionByName(shown.withColumn("sought", F.lit(True)))
    sets = result.sets.unionByName(fresh)
    edges, dropped = _decided(both, leaders, sets, rows_per_split)
    return Collapse(
        result.rows.unionByName(worded), sets, result.kept.unionByName(_kept_sets(fresh, dropped)),
        result.shown.unionByName(shown), result.edges.unionByName(edges), has_empty, result.order,
    )


def _digest() -> Column:
    return F.sha2(F.concat_ws(" ", "words"), 256)


def _word_sets(rows: DataFrame, group: str, row_id: str, text: str, ignored: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """All rows with their words, and the distinct word sets at their first row."""
    worded = rows.select(
        F.col(group).alias("group"), F.col(row_id).alias("id"), word_set(F.col(text), ignored).alias("words")
    )
    first = worded.groupBy("group", "words").agg(F.min("id").alias("id")).withColumn("size", F.size("words"))
    return worded, materialise(_signed(first), "sets")


def _kept_sets(sets: DataFrame, dropped: DataFrame | None) -> DataFrame:
    """(group, id) of the sets that stay: small ones, and those that nothing drops."""
    small = sets.where(F.col("size") < SMALLEST_PARTNER).select("group", "id")
    large = sets.where((F.col("size") >= SMALLEST_PARTNER) & F.col("id").isNotNull()).select("group", "id")
    return small.unionByName(large if dropped is None else large.join(dropped, "id", "left_anti"))


def first_matches(result: Collapse, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """For every dropped row, the first kept row it repeats and their overlap.

    One row per dropped row: the pairs grow with the table, not with its square.
    """
    overlap = F.col("shared") / (F.col("total") - F.col("shared"))
    best = (
        result.edges.join(result.kept.select(F.col("id").alias("a")), "a", "left_semi")
        .groupBy(F.col("b").alias("first_id"))
        .agg(F.min_by(F.struct(F.col("a").alias("kept_id"), overlap.alias("jaccard")), "a").alias("m"))
        .select("first_id", "m.*")
    )
    own = result.kept.select(F.col("id").alias("first_id"), F.col("id").alias("kept_id"), F.lit(1.0).alias("jaccard"))
    # Every row finds the first row of its word set; a set may have very many rows. The words are found once.
    copies = salted_lookup(
        materialise(result.rows.select("group", "id", _digest().alias("digest")), "digests"),
        result.sets.select("group", F.col("id").alias("first_id"), _digest().alias("digest")),
        ["digest", "group"], "inner", "id", rows_per_split,
    )
    matched = copies.join(best.unionByName(own), "first_id")
    return matched.where("id <> kept_id").select("group", "id", "kept_id", "jaccard")
