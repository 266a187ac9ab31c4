"""Removal of repeated byte strings by a sparse, distributed suffix sort.

1. Anchors. Of the start places of a string of LENGTH bytes, one is its anchor: where
   the hash of K bytes is smallest. Equal strings have equal anchors, so a string can
   repeat only where its anchor's K bytes do. Anchors that occur once in the corpus
   (counted by hash) are out.
2. Runs. Each task sorts the suffixes at its remaining anchors, with the bytes to the
   left of the anchor as a second key, and finds the repeats inside its run by the
   lengths of common prefixes. What repeats inside a run is passed on once.
3. Exchange. Sorted runs are front-coded (only the bytes that differ from the entry
   before), cut at sampled splitters, and dealt by range.
4. Merge. A loser tree that keeps the common prefix length of each loser with the
   winner merges the runs of a range; only bytes beyond known prefixes are compared.
   Strings that repeat across runs follow from the common prefixes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, lean, objects, pick, text_bytes
from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise

LENGTH = 200
K = 72
# Start places that compete for one anchor: strings of LENGTH bytes hold so many K-byte pieces.
WINDOW = LENGTH - K + 1
# Bytes hashed at once; the place within takes the low bits of a key.
SEGMENT = 1 << 16
PLACE_BITS = 17
# An anchor that occurs more often is dealt by longer strings, STEP start places at a time.
HOT_ANCHOR = 50_000
STEP = 16
# Entries of a sorted run, of a stored block and of a merged range (about), and sampled strings at most.
RUN_ENTRIES = 60_000
BLOCK_ENTRIES = 4096
RANGE_ENTRIES = 40_000
SAMPLES = 100_000

_LEFT = WINDOW - 1
_WIDTH = LENGTH + _LEFT


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_POWERS = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 16, 32, 64)}


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte pieces, from hashes of 1, 2, 4 ... bytes: H(ab) = H(a) * BASE^len(b) + H(b)."""
    by_size = {1: _BYTE[data]}
    size = 1
    while size * 2 <= K:
        own = by_size[size]
        by_size[2 * size] = own[:-size] * _POWERS[size] + own[size:]
        size *= 2
    total, covered = by_size[size], size
    while covered < K:
        size = 1 << ((K - covered).bit_length() - 1)
        total = total[: len(data) - covered - size + 1] * _POWERS[size] + by_size[size][covered:]
        covered += size
    return _mixed(total)


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, their hashes, and the first and last start place of the strings each stands for.

    Ties of the hash go to the leftmost place of the string, so the choice depends on
    the string's own bytes alone.
    """
    places, hashes, firsts, lasts = [], [], [], []
    for low in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[low : low + SEGMENT + LENGTH - 1]
        own = piece_hashes(part)
        count = len(part) - LENGTH + 1
        keys = (own >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(own), dtype=np.uint64)
        rows = -(-len(keys) // WINDOW)
        padded = np.full(rows * WINDOW, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(keys)] = keys
        table = padded.reshape(rows, WINDOW)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(behind[:count], ahead[WINDOW - 1 : WINDOW - 1 + count])
        winner = (best & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.diff(winner)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge - 1, [count - 1]])
        places.append(winner[first] + low)
        hashes.append(own[winner[first]])
        firsts.append(first + low)
        lasts.append(last + low)
    if not places:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing.astype(np.uint64), nothing, nothing
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _twice_at_most(hashes: np.ndarray) -> np.ndarray:
    """Each hash once, or twice if it occurs more often."""
    own, counts = np.unique(hashes, return_counts=True)
    return np.repeat(own, np.minimum(counts, 2))


class Entries:
    """Suffixes as rows of fixed width.

    A row holds LENGTH bytes from place ``q`` on and, reversed, the bytes before it; start
    places ``q - high`` to ``q - low`` are what it stands for. Bytes that none of these
    needs are zero. ``core`` is how many bytes from ``q`` on all of them share.
    """

    FIELDS = ("node", "q", "low", "high", "core")

    def __init__(self, rows: np.ndarray, node, q, low, high, core):
        self.rows, self.node, self.q, self.low, self.high, self.core = rows, node, q, low, high, core

    def __len__(self) -> int:
        return len(self.rows)

    def take(self, at: np.ndarray) -> Entries:
        return Entries(self.rows[at], *(getattr(self, name)[at] for name in self.FIELDS))

    def sorted(self) -> Entries:
        return self.take(_row_order(self.rows))

    @staticmethod
    def join(parts: list[Entries]) -> Entries:
        return Entries(
            np.vstack([p.rows for p in parts]),
            *(np.concatenate([getattr(p, name) for p in parts]) for name in Entries.FIELDS),
        )


def _row_order(rows: np.ndarray) -> np.ndarray:
    """Places of byte rows in sorted order; trailing zeros are padding and decide nothing."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def entries_of(node: int, raw: bytes, wanted: np.ndarray, hot: np.ndarray) -> Entries | None:
    """Entries of a text's anchors whose hash is ``wanted`` (sorted); ``hot`` ones are cut into steps."""
    data = np.frombuffer(raw, dtype=np.uint8)
    place, own, first, last = anchors_of(data)
    keep = _among(own, wanted)
    place, own, first, last = place[keep], own[keep], first[keep], last[keep]
    if not len(place):
        return None
    step = np.where(_among(own, hot), STEP, WINDOW)
    low, high = place - last, place - first
    pieces = high // step - low // step + 1
    row = np.repeat(np.arange(len(place)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (low // step)[row]
    shift = number * step[row]
    q = place[row] - shift
    low = np.maximum(low[row] - shift, 0)
    high = np.minimum(high[row] - shift, step[row] - 1)
    core = LENGTH - step[row] + 1
    rows = np.zeros((len(q), _WIDTH), dtype=np.uint8)
    column = np.arange(LENGTH)
    right = q[:, None] + column
    rows[:, :LENGTH] = np.where(column < (LENGTH - low)[:, None], data[np.minimum(right, len(data) - 1)], 0)
    column = np.arange(_LEFT)
    left = q[:, None] - 1 - column
    rows[:, LENGTH:] = np.where(column < high[:, None], data[np.maximum(left, 0)], 0)
    return Entries(rows, np.full(len(q), node, dtype=np.int64), q, low, high, core)


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; 0 for the first."""
    out = np.zeros(len(rows), dtype=np.int64)
    for low in range(1, len(rows), 8192):
        differs = rows[low : low + 8192] != rows[low - 1 : low - 1 + len(rows[low : low + 8192])]
        out[low : low + len(differs)] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def repeats(entries: Entries, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which start places repeat, and which of those are the first of their kind: entry x offset tables.

    ``entries`` are sorted, ``prefixes`` are their common prefixes. The string that starts
    ``i`` bytes before ``q`` is made of ``i`` bytes to the left and LENGTH - i to the
    right. Neighbours in suffix order that share LENGTH - i bytes form one class to
    the right, neighbours in the order of their left sides that share i bytes form one
    to the left, and strings are equal when both classes are.
    """
    count = len(entries)
    again = np.zeros((count, WINDOW), dtype=bool)
    leader = np.zeros((count, WINDOW), dtype=bool)
    mates = np.zeros(count, dtype=bool)
    close = prefixes[1:] >= np.minimum(entries.core[1:], entries.core[:-1])
    mates[1:] |= close
    mates[:-1] |= close
    chosen = np.flatnonzero(mates)
    if not len(chosen):
        return again, leader
    # Common prefixes of the chosen rows with the chosen ones before: the least one in between.
    right = np.minimum.reduceat(prefixes[: chosen[-1] + 1], np.concatenate([[chosen[0]], chosen[:-1] + 1]))
    right = np.minimum(right, LENGTH)
    left_rows = entries.rows[chosen, LENGTH:]
    order = _row_order(left_rows)
    left = common_prefixes(left_rows[order])
    low, high = entries.low[chosen], entries.high[chosen]
    for i in range(int(low.min()), int(high.max()) + 1):
        here = np.flatnonzero((low <= i) & (i <= high))
        if len(here) < 2:
            continue
        right_class = np.cumsum(right < LENGTH - i)
        left_class = np.empty(len(chosen), dtype=np.int64)
        left_class[order] = np.cumsum(left < i)
        both = right_class[here] * (len(chosen) + 1) + left_class[here]
        by_class = np.argsort(both, kind="stable")
        ranked = both[by_class]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            continue
        member = np.zeros(len(here), dtype=bool)
        member[1:] |= same
        member[:-1] |= same
        lead = np.zeros(len(here), dtype=bool)
        lead[:-1] = same
        lead[1:] &= ~same
        again[chosen[here[by_class[member]]], i] = True
        leader[chosen[here[by_class[lead]]], i] = True
    return again, leader


def covered(entries: Entries, again: np.ndarray) -> pd.DataFrame:
    """Byte ranges of the repeated strings by node: overlapping ranges of a node are united."""
    row, offset = np.nonzero(again)
    start = entries.q[row] - offset
    node = entries.node[row]
    order = np.lexsort((start, node))
    node, start = node[order], start[order]
    if not len(node):
        return pd.DataFrame({"node": node, "start": start, "end": start})
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (start[1:] > start[:-1] + LENGTH)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(node) - 1]])
    return pd.DataFrame({"node": node[first], "start": start[first], "end": start[last] + LENGTH})


def front_coded(entries: Entries, prefixes: np.ndarray) -> bytes:
    """Sorted entries as one block: of each row only the bytes after its common prefix with the row before."""
    used = _used(entries)
    new = (np.arange(_WIDTH) >= np.concatenate([[0], prefixes[1:]])[:, None]) & used
    shared = np.concatenate([[0], prefixes[1:]]).astype("<u2")
    numbers = [entries.node.astype("<i8"), entries.q.astype("<i8"), entries.low.astype("u1"), entries.high.astype("u1"),
               entries.core.astype("u1"), shared]
    body = struct.pack("<I", len(entries)) + b"".join(x.tobytes() for x in numbers) + entries.rows[new].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def _used(entries: Entries) -> np.ndarray:
    column = np.arange(_WIDTH)
    right = column < (LENGTH - entries.low)[:, None]
    left = (column >= LENGTH) & (column < (LENGTH + entries.high)[:, None])
    return (right & (column < LENGTH)) | left


def decoded(block: bytes) -> tuple[Entries, np.ndarray]:
    """Entries and common prefixes of a front-coded block."""
    body = zstandard.ZstdDecompressor().decompress(block)
    (count,) = struct.unpack_from("<I", body)
    at, fields = 4, []
    for kind in ("<i8", "<i8", "u1", "u1", "u1", "<u2"):
        fields.append(np.frombuffer(body, dtype=kind, count=count, offset=at))
        at += fields[-1].nbytes
    node, q, low, high, core = (x.astype(np.int64) for x in fields[:5])
    shared = fields[5].astype(np.int64)
    entries = Entries(np.zeros((count, _WIDTH), dtype=np.uint8), node, q, low, high, core)
    new = (np.arange(_WIDTH) >= shared[:, None]) & _used(entries)
    entries.rows[new] = np.frombuffer(body, dtype=np.uint8, offset=at)
    rows = entries.rows
    for i in np.flatnonzero(shared).tolist():
        rows[i, : shared[i]] = rows[i - 1, : shared[i]]
    return entries, shared


class LoserTree:
    """Merge of sorted streams of byte strings with known common prefixes.

    Every loser keeps the length of its common prefix with the string that beat it. A
    new string of the winner's stream knows its common prefix with the string just
    given out, so two of these lengths decide a match unless they are equal, and
    then bytes are compared from that length on.
    """

    def __init__(self, streams: list[tuple[list[bytes], list[int]]]):
        self.streams = streams
        self.size = 1 << max(0, (len(streams) - 1).bit_length())
        self.at = [0] * len(streams)
        self.loser = [-1] * self.size
        self.shared = [0] * self.size

    def _head(self, stream: int) -> bytes | None:
        if 0 <= stream < len(self.streams) and self.at[stream] < len(self.streams[stream][0]):
            return self.streams[stream][0][self.at[stream]]
        return None

    def _play(self, a: int, a_shared: int, b: int, b_shared: int) -> tuple[int, int, int, int]:
        """Winner and its shared length, loser and its shared length with the winner."""
        left, right = self._head(a), self._head(b)
        if left is None:
            return b, b_shared, a, 0
        if right is None:
            return a, a_shared, b, 0
        if a_shared != b_shared:
            # The one that agrees longer with the last string given out is the smaller one.
            return (a, a_shared, b, b_shared) if a_shared > b_shared else (b, b_shared, a, a_shared)
        same = _mismatch(left, right, a_shared)
        if same == len(left) or left[same] < right[same] or (left == right and a < b):
            return a, a_shared, b, same
        return b, b_shared, a, same

    def _first(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return node - self.size, 0
        a, a_shared = self._first(2 * node)
        b, b_shared = self._first(2 * node + 1)
        winner, shared, self.loser[node], self.shared[node] = self._play(a, a_shared, b, b_shared)
        return winner, shared

    def merged(self) -> Iterator[tuple[int, int, int]]:
        """(stream, place in the stream, common prefix with the string given out before)."""
        winner, shared = self._first(1)
        while self._head(winner) is not None:
            yield winner, self.at[winner], shared
            self.at[winner] += 1
            following = self.streams[winner][1]
            shared = following[self.at[winner]] if self.at[winner] < len(following) else 0
            node = (winner + self.size) // 2
            while node:
                winner, shared, self.loser[node], self.shared[node] = self._play(
                    winner, shared, self.loser[node], self.shared[node]
                )
                node //= 2


def _mismatch(a: bytes, b: bytes, start: int) -> int:
    """First place from ``start`` on where two strings of one length differ; their length if they are equal."""
    step = 16
    while start < len(a):
        if a[start : start + step] != b[start : start + step]:
            if step == 1:
                return start
            step //= 2 if step <= 16 else step // 8
        else:
            start += step
            step = min(step * 2, 128) if step >= 16 else step
    return len(a)


def merge_blocks(blocks: list[list[bytes]]) -> tuple[Entries, np.ndarray]:
    """Sorted entries of several runs (each a list of blocks in order) and their common prefixes."""
    runs, streams = [], []
    for run in blocks:
        parts = [decoded(block) for block in run]
        entries = Entries.join([p[0] for p in parts])
        shared = np.concatenate([p[1] for p in parts])
        edges = np.cumsum([len(p[0]) for p in parts])[:-1]
        for edge in edges:
            shared[edge] = common_prefixes(entries.rows[edge - 1 : edge + 1])[1]
        runs.append(entries)
        streams.append(([row.tobytes() for row in entries.rows], shared.tolist()))
    begin = np.cumsum([0] + [len(r) for r in runs])
    together = Entries.join(runs)
    del runs, parts, entries
    order = np.empty(len(together), dtype=np.int64)
    prefixes = np.empty(len(together), dtype=np.int64)
    for i, (stream, place, shared) in enumerate(LoserTree(streams).merged()):
        order[i] = begin[stream] + place
        prefixes[i] = shared
    return together.take(order), prefixes


def trimmed(entries: Entries, again: np.ndarray, leader: np.ndarray) -> Entries:
    """What a run passes on: start places that do not repeat in it, and one of each kind that does."""
    offset = np.arange(WINDOW)
    inside = (offset >= entries.low[:, None]) & (offset <= entries.high[:, None])
    needed = inside & (~again | leader)
    some = np.flatnonzero(needed.any(axis=1))
    out = entries.take(some)
    out.low = needed[some].argmax(axis=1)
    out.high = WINDOW - 1 - needed[some][:, ::-1].argmax(axis=1)
    for low in range(0, len(out), BLOCK_ENTRIES):
        at = np.arange(low, min(low + BLOCK_ENTRIES, len(out)))
        out.rows[at] = np.where(_used(out.take(at)), out.rows[at], 0)
    return out.sorted()


SCANNED = "sha string, n_bytes long, anchors array<long>"
RUNS = "node long, start long, end long, run long, seq int, n int, samples array<binary>, block binary"
SPANS = "node long, start long, end long"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sha, n_bytes and the hashes of the anchors (each twice at most) of every text."""
    bounded_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, sizes = [], []
            for raw in text_bytes(batch["text"]):
                own = anchors_of(np.frombuffer(raw, dtype=np.uint8))[1] if len(raw) >= LENGTH else np.zeros(0, np.uint64)
                found.append(_twice_at_most(own).view(np.int64))
                sizes.append(len(raw))
            yield pd.DataFrame({"id": batch["id"], "sha": batch["sha"], "n_bytes": sizes, "anchors": objects(found)})

    id_type = docs.schema[id_col].dataType.simpleString()
    return with_sha(docs, id_col, text_col).mapInPandas(run, f"id {id_type}, {SCANNED}")


def with_sha(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pick(docs, id_col, text_col).toDF("id", "text").select(
        "id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha")
    )


def sorted_runs(texts: DataFrame) -> DataFrame:
    """Spans found inside runs, and the blocks of what the runs pass on; from node, text, wanted, hot."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        names = [part.split()[0] for part in RUNS.split(", ")]

        def finish() -> Iterator[pd.DataFrame]:
            nonlocal number, held, size
            if not held:
                return
            entries = Entries.join(held)
            # What is not needed any more is let go at once: a run takes several times its bytes.
            held = []
            entries = entries.sorted()
            again, leader = repeats(entries, common_prefixes(entries.rows))
            spans = covered(entries, again)
            if len(spans):
                yield spans.assign(run=None, seq=None, n=None, samples=None, block=None)[names]
            rest = trimmed(entries, again, leader)
            del entries, again, leader
            prefixes = common_prefixes(rest.rows)
            for seq, low in enumerate(range(0, len(rest), BLOCK_ENTRIES)):
                part = rest.take(np.arange(low, min(low + BLOCK_ENTRIES, len(rest))))
                own = prefixes[low : low + BLOCK_ENTRIES].copy()
                own[0] = 0
                sampled = [_cores(part.take(np.array([i])))[0] for i in range(0, len(part), BLOCK_ENTRIES // 8)]
                yield pd.DataFrame(
                    [(None, None, None, number, seq, len(part), sampled, front_coded(part, own))], columns=names
                )
            number, size = number + 1, 0

        for batch in batches:
            raws = text_bytes(batch["text"])
            for node, raw, wanted, hot in zip(batch["node"], raws, batch["wanted"], batch["hot"], strict=True):
                listed = [np.sort(np.asarray(x, dtype=np.int64).view(np.uint64)) for x in (wanted, hot)]
                own = entries_of(node, raw, *listed)
                if own is not None:
                    held.append(own)
                    size += len(own)
                    if size >= RUN_ENTRIES:
                        yield from finish()
        yield from finish()

    return texts.select("node", "text", "wanted", "hot").mapInPandas(run, RUNS)


def _cores(entries: Entries) -> np.ndarray:
    """The bytes that all strings of an entry share, as zero-padded byte strings: what decides the range."""
    column = np.arange(LENGTH)
    rows = np.where(column < entries.core[:, None], entries.rows[:, :LENGTH], 0).astype(np.uint8)
    return np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()


def merged_spans(runs: DataFrame) -> DataFrame:
    """Spans that show only across runs: blocks are cut at splitters, dealt by range, and merged there."""
    spark = runs.sparkSession
    blocks = runs.where(F.col("block").isNotNull())
    total, stored = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(1, -(-total // RANGE_ENTRIES))
    # A hash of its place decides whether a block is sampled, so that the sample is bounded.
    share = min(1.0, SAMPLES / 8 / max(1, stored))
    taken = F.pmod(F.xxhash64("run", "seq"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = [bytes(r[0]) for r in blocks.where(taken).select(F.explode("samples")).collect()]
    sample = np.sort(np.array(sample, dtype=f"S{LENGTH}"))
    at = (np.arange(1, ranges) * len(sample)) // ranges
    splitters = spark.sparkContext.broadcast(np.unique(sample[at]) if len(sample) else sample)

    @lean
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["range", "run", "seq", "part"]
        for batch in batches:
            for number, seq, block in zip(batch["run"], batch["seq"], batch["block"], strict=True):
                entries, _ = decoded(block)
                target = np.searchsorted(splitters.value, _cores(entries), side="right")
                rows = []
                for one in np.unique(target):
                    part = entries.take(np.flatnonzero(target == one))
                    rows.append((int(one), number, seq, front_coded(part, common_prefixes(part.rows))))
                yield pd.DataFrame(rows, columns=names, dtype=object)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["run", "seq"])
        if group["run"].nunique() < 2:
            return pd.DataFrame({name: np.zeros(0, dtype=np.int64) for name in ("node", "start", "end")})
        entries, prefixes = merge_blocks([own["part"].tolist() for _, own in group.groupby("run", sort=False)])
        return covered(entries, repeats(entries, prefixes)[0])

    dealt = blocks.select("run", "seq", "block").mapInPandas(cut, "range int, run long, seq int, part binary")
    return dealt.repartition(ranges, "range").groupBy("range").applyInPandas(merge, SPANS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """sha and spans (``start-end`` of bytes, by commas) of every distinct text with repeated strings."""
    bounded_batches(docs.sparkSession)
    scanned = materialise(scan(docs, id_col, text_col), "anchors")
    nodes = materialise(
        scanned.groupBy("sha").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"))
        .withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    # Of equal texts one is searched. All strings of the others repeat in it.
    first = scanned.join(nodes.select("sha", "node", "first_id"), "sha").where(F.col("id").eqNullSafe(F.col("first_id")))
    anchors = first.select("node", F.explode("anchors").alias("anchor"))
    often = materialise(
        anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("anchor", (F.col("n") > hot_anchor).alias("is_hot")),
        "repeated-anchors",
    )
    hits = anchors.distinct().join(often, "anchor").groupBy("node").agg(
        F.collect_list("anchor").alias("wanted"),
        F.collect_list(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot"),
    )
    candidates = materialise(hits.join(nodes.select("node", "sha", "first_id"), "node"), "candidates")
    texts = with_sha(docs, id_col, text_col)
    near = texts.join(broadcast_if_small(candidates.select("sha")), "sha", "left_semi")
    searched = near.join(candidates, "sha").where(F.col("id").eqNullSafe(F.col("first_id")))
    runs = materialise(sorted_runs(searched), "sorted-runs")
    local = runs.where(F.col("block").isNull()).select("node", "start", "end")
    spans = local.unionByName(merged_spans(runs)).groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    @F.pandas_udf("string")
    def united(spans: pd.Series) -> pd.Series:
        return objects([",".join(f"{a}-{b}" for a, b in unite((s["start"], s["end"]) for s in own)) for own in spans])

    found = spans.select("node", united("spans").alias("spans")).join(nodes, "node", "right")
    whole = F.concat(F.lit("0-"), F.col("n_bytes").cast("string"))
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    marks = found.select("sha", F.when(copied, whole).otherwise(F.col("spans")).alias("spans"))
    return marks.where(F.col("spans").isNotNull())


def unite(spans) -> list[tuple[int, int]]:
    """Maximal ranges covered by ranges that may overlap or touch."""
    out: list[list[int]] = []
    for start, end in sorted((int(a), int(b)) for a, b in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def parse_spans(text: str | None) -> list[tuple[int, int]]:
    return [tuple(map(int, part.split("-"))) for part in text.split(",")] if text else []


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, end in spans:
        parts.append(raw[at:start])
        at = end
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters: one that is covered in part stays."""
    out = []
    for start, end in spans:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def kept_bytes(text: Column, spans: Column) -> Column:
    """UTF-8 bytes of a text without its spans."""

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return objects([without(raw, parse_spans(own)) for raw, own in zip(text_bytes(texts), spans, strict=True)])

    return F.when(spans.isNull(), F.coalesce(text, F.lit("")).cast("binary")).otherwise(cut(text, spans))


def kept_text(text: Column, spans: Column) -> Column:
    """The text without its spans; characters that are covered in part stay, so the rest is valid text."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        rows = zip(text_bytes(texts), spans, strict=True)
        return objects([without(raw, whole_characters(raw, parse_spans(own))).decode("utf-8", "replace") for raw, own in rows])

    return F.when(spans.isNull(), text).otherwise(cut(text, spans))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """One row per document: id, n_bytes, spans (null if none), n_removed, n_spans, kept (bytes).

    Removed is every byte of a LENGTH-byte string that also starts anywhere else, in
    the same document or another; strings never cross documents and are judged on the
    input. A null text is empty. Of equal texts of at least LENGTH bytes nothing
    stays, repeated rows included; shorter texts stay whole. Null ids are documents
    like others. An empty table gives an empty result; other columns are ignored.
    """
    marks = repeated_spans(docs, id_col, text_col, hot_anchor)
    marked = key_lookup(with_sha(docs, id_col, text_col), materialise(marks, "spans"), ["sha"], "left", "id")
    ranges = F.transform(F.split("spans", ","), lambda x: F.split(x, "-"))
    removed = F.aggregate(ranges, F.lit(0).cast("long"), lambda sum_, r: sum_ + r[1].cast("long") - r[0].cast("long"))
    return marked.select(
        F.col("id").alias(id_col),
        F.octet_length("text").cast("long").alias("n_bytes"),
        "spans",
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(ranges), F.lit(0)).cast("long").alias("n_spans"),
        kept_bytes(F.col("text"), F.col("spans")).alias("kept"),
    )
