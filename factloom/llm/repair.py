"""Repair of conversation structure by least-cost edits, with checkpoints instead of a full table.

A repaired conversation's role initials read ``(s?(ua)+)?``. This pattern has four
states: nothing yet, after s, after u, after a. What any run of rows costs between two
states is a 4 x 4 table, and such tables combine by (min, +). So rows are put in one
global order and cut into blocks of bounded size, wherever conversations begin or end:

1. every block gives one table per conversation in it;
2. walking the tables of a conversation backwards gives the state costs at its block
   ends, which are the only ones that are stored;
3. every block starts from those, keeps state costs at about sqrt(rows) checkpoints,
   and walks forward, recomputing the costs between two checkpoints, along the edits
   that are tight (their cost and the cost of what is left add up to the least one),
   always the ASCII-least of them. A block inside a conversation does so for each state
   it may begin in;
4. walking forward over blocks picks the state that each block really begins in.

No conversation is ever gathered, however many rows it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, pick
from factloom.session import materialise

# Edits, in ASCII order, and what they cost; an undeleted truncated row costs CUT more.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
CUT = 1
# Kinds of roles by initial, and states: nothing yet, after s, after u, after a.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
NEVER = 1 << 60
# The state that the next user or assistant row leads to, and the name of its role.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE = ("user", "user", "assistant", "user")
# Where keeping a row of some kind leads to from each state, if it may be kept.
KEPT = {
    SYSTEM: {START: AFTER_S},
    USER: {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
    ASSISTANT: {AFTER_U: AFTER_A},
    OTHER: {},
}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
# Codes of a row: its kind, and whether it is fine, truncated, or has to be deleted.
FINE, TRUNCATED, DOOMED = range(3)
WHITE = " \t\n\x0b\x0c\r"
# Bytes of text in an Arrow batch that a task gives out, about.
OUT_BYTES = 4 << 20

Costs = tuple[int, ...]


def edits_of(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """The edits that use up a row, ASCII-least first: letter, cost, next state."""
    kind, fault = divmod(code, 3)
    yield DELETE, COST[DELETE], state
    if fault != DOOMED:
        if state in KEPT[kind]:
            yield KEEP, COST[KEEP] + CUT * (fault == TRUNCATED), KEPT[kind][state]
        yield REROLE, COST[REROLE] + CUT * (fault == TRUNCATED), NEXT[state]


def with_inserts(costs: list[int]) -> Costs:
    """State costs when rows may be inserted first: two are enough to reach any state that a row may need."""
    one = [min(costs[s], COST[INSERT] + costs[NEXT[s]]) for s in STATES]
    return tuple(min(one[s], COST[INSERT] + one[NEXT[s]]) for s in STATES)


_EDITS = [[list(edits_of(code, state)) for state in STATES] for code in range(12)]
# What is left to do behind the last row of a conversation: it may end before its first row or after an a.
AT_END = with_inserts([0, NEVER, NEVER, 0])


def before(code: int, after: Costs) -> Costs:
    """State costs in front of a row from those behind it."""
    return with_inserts([min(cost + after[to] for _, cost, to in _EDITS[code][s]) for s in STATES])


def transfer(codes: bytes) -> list[int]:
    """The 4 x 4 costs of a run of rows, from each state in front of it (inserts included) to each state behind it."""
    columns = []
    for to in STATES:
        costs: Costs = tuple(0 if s == to else NEVER for s in STATES)
        for code in reversed(codes):
            costs = before(code, costs)
        columns.append(costs)
    return [columns[to][s] for s in STATES for to in STATES]


def through(table: list[int], after: Costs) -> Costs:
    return tuple(min(table[4 * s + to] + after[to] for to in STATES) for s in STATES)


def tight_edits(codes: bytes, after: Costs, starts: list[int], last: bool) -> dict[int, tuple[int, str]]:
    """For each start state the state behind the rows and the ASCII-least cheapest edits.

    Only about sqrt(rows) state costs are stored on the way back; those between two of
    them are computed again on the way forward.
    """
    count = len(codes)
    step = isqrt(count) + 1
    saved = {count: after}
    costs = after
    for i in range(count - 1, -1, -1):
        costs = before(codes[i], costs)
        if i % step == 0:
            saved[i] = costs
    states = {start: start for start in starts}
    letters: dict[int, list[str]] = {start: [] for start in starts}
    for low in range(0, count, step):
        high = min(low + step, count)
        block = [saved[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(before(codes[i], block[-1]))
        block.reverse()
        for start in starts:
            state, out = states[start], letters[start]
            for i in range(low, high):
                state = _step(codes[i], state, block[i - low], block[i - low + 1], out)
            states[start] = state
    if last:
        for start in starts:
            while after[states[start]]:
                letters[start].append(INSERT)
                states[start] = NEXT[states[start]]
    return {start: (states[start], "".join(letters[start])) for start in starts}


def _step(code: int, state: int, here: Costs, after: Costs, out: list[str]) -> int:
    """Take tight edits until the row is used up: a deletion before an insertion, this before others."""
    while True:
        options = _EDITS[code][state]
        if COST[DELETE] + after[state] == here[state]:
            out.append(DELETE)
            return state
        if COST[INSERT] + here[NEXT[state]] == here[state]:
            out.append(INSERT)
            state = NEXT[state]
            continue
        for letter, cost, to in options[1:]:
            if cost + after[to] == here[state]:
                out.append(letter)
                return to
        raise AssertionError("no tight edit")


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable[[tuple], int] = lambda row: 256) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about OUT_BYTES."""

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(column), field.type) for column, field in zip(columns, schema, strict=True)], schema=schema
        )

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


LONGS = pa.list_(pa.int64())
TABLES = pa.schema([("cid", pa.string()), ("block", pa.int64()), ("table", LONGS), ("first", pa.int64()),
                    ("last", pa.int64()), ("illegal", pa.int64())])
ENDS = pa.schema([("cid", pa.string()), ("block", pa.int64()), ("after", LONGS), ("is_first", pa.bool_()),
                  ("is_last", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])
CHOICES = pa.schema([("cid", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                     ("edits", pa.string())])
REPAIRED = pa.schema([("cid", pa.string()), ("at", pa.int64()), ("sub", pa.int64()), ("edit", pa.string()),
                      ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_DDL = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", LONGS: "array<long>"}


def _mapped(df: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, **weigh) -> DataFrame:
    """A streaming pass over sorted partitions; it holds the rows of one batch and what ``run`` keeps."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(run(rows_in(batches)), schema, **weigh)

    return df.mapInArrow(each, ", ".join(f"{field.name} {_DDL[field.type]}" for field in schema))


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("block").sortWithinPartitions("block", "cid", "at")


def block_tables(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(block, cid, at, code) in order -> one row per block and conversation."""
    for (block, cid), own in groupby(rows, key=lambda row: row[:2]):
        codes = bytes(row[3] for row in own)
        kinds = [code // 3 for code in codes]
        illegal = sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False))
        yield cid, block, transfer(codes), kinds[0], kinds[-1], illegal


def block_ends(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks of each conversation from the last to the first -> the state costs behind each.

    The row of a first block also has the costs and the illegal pairs of the whole conversation.
    """
    for cid, own in groupby(rows, key=lambda row: row[0]):
        after, illegal, following, held = AT_END, 0, None, None
        for _, block, table, first, last, inside in own:
            if held:
                yield (*held[:3], False, held[3], None, None)
            illegal += inside + (following is not None and (last, following) not in LEGAL)
            held = (cid, block, list(after), following is None)
            after, following = through(table, after), first
        yield (*held[:3], True, held[3], after[START], illegal)


def block_choices(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(block, cid, at, code, after, is_first, is_last), headed by the row of costs -> edits per possible start state."""
    for (block, cid), own in groupby(rows, key=lambda row: row[:2]):
        _, _, _, _, after, is_first, is_last = next(own)
        codes = bytes(row[3] for row in own)
        starts = [START] if is_first else list(STATES)
        # A state that cannot lead to an end is never begun in; all four can, by inserts.
        for start, (stop, edits) in tight_edits(codes, tuple(after), starts, is_last).items():
            yield cid, block, start, stop, edits


def taken_choices(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Choices of each conversation in order -> those whose start state is where the block before ended."""
    for _, own in groupby(rows, key=lambda row: row[0]):
        state = START
        for _, block in groupby(own, key=lambda row: row[1]):
            taken = next(row for row in [*block] if row[2] == state)
            state = taken[3]
            yield taken


def repaired_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(block, cid, at, turn, role, text, start, edits), headed by the row of edits -> the rows of the repaired table."""
    for (_, cid), own in groupby(rows, key=lambda row: row[:2]):
        head, current = next(own), next(own)
        # An insertion stands behind the row before it, or right before the first row.
        state, at, sub = head[6], current[2] - 1, 0
        for edit in head[7]:
            if edit == INSERT:
                sub += 1
                yield cid, at, sub, edit, None, ROLE[state], ""
                state = NEXT[state]
                continue
            _, _, at, turn, role, text, _, _ = current
            sub = 0
            if edit == REROLE:
                role, state = ROLE[state], NEXT[state]
            elif edit == KEEP:
                state = KEPT["sua".index(role[0])][state]
            yield cid, at, sub, edit, turn, role, text
            current = next(own, None)


class Repair(NamedTuple):
    """``rows``: every row and insertion with its edit; ``talks``: one row of counts, cost and audit per conversation."""

    rows: DataFrame
    talks: DataFrame


def _key(column: Column) -> Column:
    """Ids as text, so that Python passes need not know their type; null is the empty text."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), column.cast("string")))


def _restored(df: DataFrame, name: str, kind: str) -> DataFrame:
    value = F.when(F.col("cid") == "", F.lit(None)).otherwise(F.expr("substr(cid, 2)")).cast(kind).alias(name)
    return df.select(value, *[column for column in df.columns if column != "cid"])


def repair_conversations(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> Repair:
    """Cheapest edits that make every conversation's role initials read ``(s?(ua)+)?``.

    Rows are taken by turn (null turns first; equal turns by role, then by a hash of the
    text). A null role or text is one space; a null id is a conversation like others;
    repeated rows are rows of their own, of which all but the first are duplicates. A
    row's first fault counts: blank, duplicate (role and text stand earlier in the
    conversation), truncated (its last visible character is none of ``.!?``). Blank and
    duplicate rows have to be deleted. Of equally cheap edits the ASCII-least audit is
    taken. An empty table gives empty results; other columns are ignored.

    ``rows``: id, at and sub (their order is the order of the rows), edit (D, I, K, R),
    turn (null for an insertion), role (after the edit) and text. A text, and the audit
    (a letter per edit) of a conversation, have to fit a row; nothing else is gathered.
    """
    spark = talks.sparkSession
    bounded_batches(spark)
    kind = talks.schema[id_col].dataType.simpleString()
    visible = F.rtrim(F.col("text"), F.lit(WHITE))
    blank, cut = visible == "", ~F.substring(visible, -1, 1).isin(".", "!", "?")
    source = (
        pick(talks, id_col, turn_col, role_col, text_col).toDF("id", "turn", "role", "text")
        .select(
            _key(F.col("id")).alias("cid"), F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        )
        .select(
            "*", F.sha2("text", 256).alias("sha"), blank.alias("blank"), (~blank & cut).alias("cut"),
            # Keeps very many equal rows apart in the global order; written before it is sorted by.
            F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        )
    )
    order = ["cid", "turn", "role", "sha", "salt"]
    ordered = materialise(
        materialise(source, "turns").repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()).drop("salt"),
        "ordered-turns",
    )
    firsts = ordered.groupBy("cid", "role", "sha").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    kinds = reduce(lambda c, k: c.when(F.col("initial") == "sua"[k], k), (SYSTEM, USER, ASSISTANT), F.when(F.lit(False), 0))
    duplicate = ~F.col("blank") & F.col("first").isNull()
    fault = F.when(F.col("blank") | F.col("duplicate"), DOOMED).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    block = F.shiftright("at", 33)
    marked = materialise(
        ordered.select("cid", "at", "turn", "blank", "cut", F.substring("role", 1, 1).alias("initial"))
        .join(firsts, "at", "left")
        .withColumn("duplicate", duplicate)
        .select(
            block.alias("block"), "cid", "at", "turn", "blank", "duplicate",
            (F.col("cut") & ~F.col("duplicate")).alias("truncated"),
            (kinds.otherwise(OTHER) * 3 + fault).cast("long").alias("code"),
        ),
        "turn-codes",
    )

    codes = marked.select("block", "cid", "at", "code")
    tables = _mapped(_by_block(codes), block_tables, TABLES)
    backward = tables.repartition("cid").sortWithinPartitions("cid", F.desc("block"))
    ends = materialise(_mapped(backward, block_ends, ENDS), "block-ends")
    heads = ends.select("block", "cid", F.lit(-1).cast("long").alias("at"), "after", "is_first", "is_last")
    headed = _by_block(codes.unionByName(heads, allowMissingColumns=True))
    choices = _mapped(headed, block_choices, CHOICES, weigh=lambda row: 64 + len(row[4]))
    forward = choices.repartition("cid").sortWithinPartitions("cid", "block")
    taken = materialise(_mapped(forward, taken_choices, CHOICES, weigh=lambda row: 64 + len(row[4])), "edits")

    texts = ordered.select(block.alias("block"), "cid", "at", "turn", "role", "text")
    heads = taken.select("block", "cid", F.lit(-1).cast("long").alias("at"), "start", "edits")
    rows = _mapped(
        _by_block(texts.unionByName(heads, allowMissingColumns=True)), repaired_rows, REPAIRED,
        weigh=lambda row: 64 + len(row[6]),
    )

    gaps = F.expr("try_cast(max(turn) as decimal(38, 0)) - min(turn) + 1 - count(distinct turn)")
    counts = marked.groupBy("cid").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        *[F.sum(F.col(name).cast("long")).alias(name) for name in ("blank", "duplicate", "truncated")],
    ).withColumn("gaps", F.expr("try_cast(gaps as bigint)"))
    whole = ends.where("is_first").select("cid", "illegal", "cost")
    audits = taken.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("block", "edits"))).alias("parts"))
    audits = audits.select("cid", F.array_join("parts.edits", "").alias("audit"))
    summary = counts.join(whole, "cid").join(audits, "cid")
    return Repair(_restored(rows, id_col, kind), _restored(summary, id_col, kind))


DIGESTS = pa.schema([("cid", pa.string()), ("repaired_sha256", pa.string())])


def conversation_digests(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, repaired_sha256: hash of the repaired ``role:text`` of a conversation, joined by new lines.

    A hash runs over its input in order, so one task streams all rows of a conversation, one
    batch at a time. A conversation without rows left has the hash of an empty text.
    """

    def run(lines: Iterator[tuple]) -> Iterator[tuple]:
        for cid, own in groupby(lines, key=lambda row: row[0]):
            sha, joined = hashlib.sha256(), False
            for _, edit, role, text in own:
                if edit != DELETE:
                    sha.update(f"{'\n' if joined else ''}{role}:{text}".encode())
                    joined = True
            yield cid, sha.hexdigest()

    kind = rows.schema[id_col].dataType.simpleString()
    lines = pick(rows, id_col, "at", "sub", "edit", "role", "text").toDF("id", "at", "sub", "edit", "role", "text")
    lines = lines.withColumn("cid", _key(F.col("id"))).repartition("cid").sortWithinPartitions("cid", "at", "sub")
    return _restored(_mapped(lines.select("cid", "edit", "role", "text"), run, DIGESTS), id_col, kind)


def damaged(talks: DataFrame) -> DataFrame:
    """Conversations with known faults: rows dropped, emptied, cut, repeated or given to the user, by a checksum of their key."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = pick(talks, "conv_id", "turn", "role", "text").withColumn("damage", F.crc32(key.cast("binary")) % 20)
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.where("damage <> 0").select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
