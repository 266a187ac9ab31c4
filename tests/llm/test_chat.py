from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from helpers import clashing

from factloom.llm import chat as op

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "<", "[", "<\\s>", "ok"]
ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "hi"), (1, 2, "assistant", "[INST] hello </s>"),
    (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]"),
    (3, 1, "assistant", "late"), (3, 0, None, None), (3, None, "tool[/ROLE]", "[\\INST]"), (4, 0, "user", "same"),
    (4, 0, "user", "same"), (5, 0, "user", "x" * 300_000), (None, 0, "user", "no conversation"), (6, 0, "", ""),
    (7, 1, "user", "tie b"), (7, 1, "user", "tie a"), (8, 0, "assistant", ""),
]


def expected(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        state = "start"
        for role, _ in turns:
            state = op.TEMPLATE.order.get((state, role), "out of order")
        learnt = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt),
            hashlib.sha256(learnt.encode()).hexdigest(), state != "out of order",
        )
    return out


def check(spark, rows):
    formatted = op.format_conversations(clashing(spark.createDataFrame(rows, SCHEMA)))
    found = op.turn_digests(formatted).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.in_order) for r in found}
    assert got == expected(rows) and len(found) == len(got)
    lengths = {r.conv_id: len(r.formatted) for r in formatted.collect()}
    assert {r.conv_id: r.formatted_chars for r in found} == lengths


def test_read_back(spark):
    check(spark, ROWS)


def test_any_mix_of_control_strings(spark):
    draw = random.Random(5)

    def text():
        return "".join(draw.choice(CONTROL) for _ in range(draw.randint(0, 8)))

    roles = ["user", "assistant", "system", "tool", "<s>", "[/ROLE]", "\\"]
    check(spark, [(c, t, draw.choice(roles), text()) for c in range(300) for t in range(draw.randint(1, 5))])


def test_segments(spark):
    """Only assistant texts are learnt, and marks never are."""
    row = op.format_conversations(spark.createDataFrame(ROWS[:3], SCHEMA)).first()
    assert row.formatted == "<<SYS>>Be brief.<</SYS>>[INST]hi[/INST]<s>[\\INST] hello <\\/s></s>"
    assert [s.text for s in row.segments if s.loss] == ["[\\INST] hello <\\/s>"]
    assert "".join(s.text for s in row.segments) == row.formatted


def test_empty_table_and_plan(spark):
    talks = spark.createDataFrame(ROWS[:3], SCHEMA)
    assert op.turn_digests(op.format_conversations(talks.where("false"))).count() == 0
    plan = op.turn_digests(op.format_conversations(talks))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
