from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from helpers import clashing
from pyspark.sql import functions as F

from factloom.llm import queries, repair
from factloom.llm.repair import conversation_digests, repair_conversations

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault) by trying all edits, forward, least cost and audit first."""
    best = {"0": (0, "", ())}

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                to, role = ("u", "user") if state != "u" else ("a", "assistant")
                new = (cost + 2, audit + "I", (*out, f"{role}:"))
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    for role, text, fault in rows:
        after = {}

        def offer(state, value):
            if state not in after or value[:2] < after[state][:2]:
                after[state] = value

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (fault == "truncated")
            initial = role[:1]
            if initial and state + initial in ("0s", "0u", "su", "au", "ua"):
                offer(initial, (more, audit + "K", (*out, f"{role}:{text}")))
            to, name = ("u", "user") if state != "u" else ("a", "assistant")
            offer(to, (more + 2, audit + "R", (*out, f"{name}:{text}")))
        best = after
    return min(value for state, value in inserted(best).items() if state in "0a")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows):
    """All columns of op12 for damaged rows (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [turn for turn, _, _ in own if turn is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        marked = faults([row[1:] for row in own])
        count = [sum(row[2] == name for row in marked) for name in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, repaired = cheapest(marked)
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def found(spark, talks):
    done = repair_conversations(talks)
    sha = {row["conv_id"]: row["repaired_sha256"] for row in conversation_digests(done.rows).collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {row["conv_id"]: (*[row[n] for n in names], sha[row["conv_id"]]) for row in done.talks.collect()}


def random_rows(draw, conversations, most):
    texts = ["Yes.", "No", "Why?", "", " \t", "Well!", None, "End. ", " ", "Über..."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    return [
        (conv, draw.choice([turn, turn, turn, None, 3]), draw.choice(roles), draw.choice([*texts, f"t{turn}."]))
        for conv in [*range(conversations), None] for turn in range(draw.randint(1, most))
    ]


def test_equals_brute_force(spark):
    rows = random_rows(random.Random(5), 150, 14)
    assert found(spark, spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_one_conversation_over_many_blocks(spark):
    """A third and more of all rows are one conversation: its blocks are repaired apart, with the same edits."""
    draw = random.Random(8)
    rows = [row for row in random_rows(draw, 20, 6) if row[0] is not None]
    rows += [(77, i, draw.choice(["user", "assistant", "system"]), draw.choice([f"t{i}.", f"t{i}", "", "Yes."])) for i in range(900)]
    rows += [(78, 1, "user", "Again.")] * 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(4))
        blocks = done.rows.where("conv_id = 77").select(F.shiftright("at", 33)).distinct().count()
        assert blocks > 2
        assert done.rows.where("conv_id = 78").select(F.shiftright("at", 33)).distinct().count() > 1
        assert found(spark, spark.createDataFrame(rows, SCHEMA).repartition(4)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(3))
def test_blocks_agree_with_one_block(seed):
    draw = random.Random(seed)
    codes = bytes(draw.randrange(12) for _ in range(400))
    whole = repair.tight_edits(codes, repair.AT_END, [repair.START], True)[repair.START][1]
    cuts = sorted(draw.sample(range(1, 400), 5))
    parts = [codes[a:b] for a, b in itertools.pairwise([0, *cuts, 400])]
    after = repair.AT_END
    ends = []
    for part in reversed(parts):
        ends.insert(0, after)
        after = repair.through(repair.transfer(part), after)
    state, edits = repair.START, ""
    for i, (part, end) in enumerate(zip(parts, ends, strict=True)):
        state, own = repair.tight_edits(part, end, list(repair.STATES), i == len(parts) - 1)[state]
        edits += own
    assert edits == whole


def test_checkpoints_are_few(monkeypatch):
    """State costs that are held at one time: about twice the root of the rows."""
    calls = []
    plain = repair.before
    monkeypatch.setattr(repair, "before", lambda code, after: calls.append(1) or plain(code, after))
    repair.tight_edits(bytes(10_000), repair.AT_END, [repair.START], True)
    assert len(calls) <= 2 * 10_000


def test_rows_of_a_repair(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Cut"), (1, 2, "user", "Cut"), (1, 3, "tool", "So!")]
    done = repair_conversations(clashing(spark.createDataFrame(rows, SCHEMA)))
    lines = [(r["edit"], r["turn"], r["role"], r["text"]) for r in done.rows.orderBy("at", "sub").collect()]
    assert lines == [("I", None, "user", ""), ("K", 0, "assistant", "Hi."), ("K", 1, "user", "Cut"),
                     ("D", 2, "user", "Cut"), ("R", 3, "assistant", "So!")]
    assert done.talks.collect()[0]["cost"] == 2 + 0 + 1 + 3 + 2


def test_long_text_and_text_ids(spark):
    long = "wort " * 4_000_000 + "."
    talks = spark.createDataFrame([("a", 0, "user", long), ("a", 1, "assistant", "Ok."), (None, 0, "user", "")],
                                  "conv_id string, turn long, role string, text string")
    done = repair_conversations(talks)
    assert {row["conv_id"]: row["audit"] for row in done.talks.collect()} == {"a": "KK", None: "D"}
    sha = {row["conv_id"]: row["repaired_sha256"] for row in conversation_digests(done.rows).collect()}
    assert sha["a"] == hashlib.sha256(f"user:{long}\nassistant:Ok.".encode()).hexdigest()
    assert sha[None] == hashlib.sha256(b"").hexdigest()


def test_empty(spark):
    done = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert done.rows.count() == 0 and done.talks.count() == 0 and conversation_digests(done.rows).count() == 0


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rows = random_rows(random.Random(11), 200, 5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    result = {row["conv_id"]: row for row in queries.QUERIES["op12_repair"](spark, str(tmp_path)).collect()}
    left = expected(damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {conv: tuple(row[n] for n in names) for conv, row in result.items()} == {
        conv: left.get(conv, empty) for conv, *_ in rows
    }
