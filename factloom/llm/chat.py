"""Chat formatting by a declarative template, with role order and loss flags.

A conversation becomes text segments with a loss flag each. Control strings in
texts and role names are escaped by one more backslash after their first
character (``[INST]`` becomes ``[\\INST]``, that becomes ``[\\\\INST]``), so a control
string in the output is always one of the template and the output can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import pick


@dataclass(frozen=True)
class Turn:
    """How a role is written: what stands before and after its text, and whether the text is learnt."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of any other role, and the order of roles.

    Marks start with ``<`` or ``[``. ``order`` maps (state, role) to the next state;
    the state is the last role, or ``start``. What it does not name is out of order.
    """

    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<s>", "</s>", loss=True),
        }
    )
    other_before: str = "[ROLE]"
    other_between: str = "[/ROLE]"
    other_after: str = "[/TURN]"
    order: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def marks(self) -> list[str]:
        own = [mark for turn in self.roles.values() for mark in (turn.before, turn.after)]
        return [*own, self.other_before, self.other_between, self.other_after]

    def control(self) -> str:
        """First character, escapes, and the rest of a control string."""
        return r"([<\[])(\\*)(" + "|".join(re.escape(mark[1:]) for mark in self.marks()) + ")"


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, template.control(), r"$1$2\\$3")


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    escaped = template.control().replace(r"(\\*)", r"(\\*)\\")
    return F.regexp_replace(text, escaped, "$1$2$3")


def _by_role(role: Column, values: dict, other: Column | None = None) -> Column:
    chain = None
    for name, value in values.items():
        chain = F.when(role == name, value) if chain is None else chain.when(role == name, value)
    return chain.otherwise(other)


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, in_order, segments, formatted.

    ``conversations`` has conv_id, turn, role and text, one row per turn. Turns are
    ordered by turn, then role and text, nulls first; repeated rows are turns of
    their own. A null role or text is empty; a role the template does not know
    is written with its name. Rows with a null conv_id form one conversation. Every
    conversation is written; ``in_order`` says whether its roles follow the
    template's order from the first turn to the last. ``segments`` holds text
    (escaped) and loss flag; ``formatted`` is their concatenation. An empty table gives
    an empty result; other columns are ignored.

    A conversation is one output row, so its turns meet in one task; the
    conversations are spread by their id.
    """
    turns = pick(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("turn"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    steps = F.create_map(
        *[F.lit(x) for (state, role), after in template.order.items() for x in (f"{state}|{role}", after)]
    )
    last_state = F.aggregate(
        "turns",
        F.lit("start"),
        lambda state, turn: F.coalesce(
            F.try_element_at(steps, F.concat(state, F.lit("|"), turn["role"])), F.lit("out of order")
        ),
    )

    def written(turn: Column) -> Column:
        role = turn["role"]
        named = F.concat(F.lit(template.other_before), escape(role, template), F.lit(template.other_between))
        before = _by_role(role, {name: F.lit(t.before) for name, t in template.roles.items()}, named)
        after = _by_role(role, {name: F.lit(t.after) for name, t in template.roles.items()}, F.lit(template.other_after))
        loss = _by_role(role, {name: F.lit(t.loss) for name, t in template.roles.items()}, F.lit(False))
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"], template).alias("text"), loss.alias("loss")),
            F.struct(after.alias("text"), F.lit(False).alias("loss")),
        )

    segments = grouped.select(
        "conv_id",
        (last_state != "out of order").alias("in_order"),
        F.flatten(F.transform("turns", written)).alias("segments"),
    )
    return segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    opening = [turn.before for turn in template.roles.values()] + [template.other_before]
    pieces = F.split(formatted, "(?=" + "|".join(re.escape(mark) for mark in opening) + ")", -1)

    def parsed(piece: Column) -> Column:
        result = None
        for name, turn in template.roles.items():
            length = F.length(piece) - len(turn.before) - len(turn.after)
            body = unescape(piece.substr(F.lit(len(turn.before) + 1), length), template)
            value = F.struct(F.lit(name).alias("role"), body.alias("text"))
            started = piece.startswith(turn.before)
            result = F.when(started, value) if result is None else result.when(started, value)
        between = F.locate(template.other_between, piece)
        start = F.lit(len(template.other_before) + 1)
        role = piece.substr(start, between - start)
        text_at = between + len(template.other_between)
        text = piece.substr(text_at, F.length(piece) + 1 - len(template.other_after) - text_at)
        other = F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))
        return result.otherwise(other)

    return F.transform(pieces, parsed)


def turn_digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Counts and digests of what stands in the output, read back from it."""
    back = formatted.withColumn("turns", read_turns(F.col("formatted"), template))
    learnt = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), ""
    )
    whole = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "in_order",
    )
