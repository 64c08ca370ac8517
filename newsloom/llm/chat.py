"""Chat formatting: a declarative template, a state machine over roles, text segments with loss flags. Native."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Mark:
    """How turns of a role look: what stands before and after the text, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of turns whose role has none (the role is written between the first two), turn order.

    Every mark starts with one of ``openers`` and continues with something other than the escape character.
    """

    marks: dict[str, Mark] = field(
        default_factory=lambda: {
            "system": Mark("<<SYS>>", "<</SYS>>"),
            "user": Mark("[INST]", "[/INST]"),
            "assistant": Mark("<s>", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    start: str = "start"
    final: tuple[str, ...] = ("answered",)

    def control(self) -> list[str]:
        return [s for m in self.marks.values() for s in (m.before, m.after)] + list(self.other)

    def openers(self) -> str:
        return "".join(sorted({s[0] for s in self.control()}))


def escape(text: Column, template: Template) -> Column:
    """The escape character goes after every character that opens a mark and after itself, so no mark can appear."""
    return F.regexp_replace(text, f"([{re.escape(template.openers() + ESCAPE)}])", r"$1\\")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"([{re.escape(template.openers() + ESCAPE)}])\\", "$1")


def _segment(text: Column, loss: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _turn_segments(turn: Column, t: Template) -> Column:
    """The segments of one turn; marks never count for the loss."""
    first, middle, last = t.other
    body = escape(turn["text"], t)
    out = F.array(
        _segment(F.lit(first), False), _segment(escape(turn["role"], t), False), _segment(F.lit(middle), False),
        _segment(body, False), _segment(F.lit(last), False),
    )
    for role, mark in t.marks.items():
        own = F.array(_segment(F.lit(mark.before), False), _segment(body, mark.loss), _segment(F.lit(mark.after), False))
        out = F.when(turn["role"] == role, own).otherwise(out)
    return out


def _order_error(turns: Column, t: Template) -> Column:
    """Run the state machine: the state it ends in and the place of the first turn that it has no step for."""
    steps = F.create_map(
        *[F.lit(x) for state, to in t.order.items() for role, then in to.items() for x in (f"{state}>{role}", then)]
    )

    def step(acc, turn):
        to = F.try_element_at(steps, F.concat_ws(">", acc["state"], turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"),
        )

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, begin, step)


def format_chats(
    turns: DataFrame, template: Template = Template(), conversation: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv_id, segments array<struct<text, loss>>, formatted, invalid_turn, complete``: one row a conversation.

    Turns are ordered by number (null first), then role and text. The state machine reports the place of the first turn
    out of order (``invalid_turn``, null if there is none) and whether the conversation ends in a final state; every
    conversation is formatted, so that callers decide what to leave out. Null texts and roles are empty; a role without
    marks is written out between the marks of ``other``; repeated rows are turns of their own; turns without a
    conversation id form one conversation whose id is null. Only built-in functions are used, and one shuffle by
    conversation.
    """
    grouped = (
        turns.select(
            F.col(f"`{conversation}`").alias("conv_id"),
            F.struct(
                F.col(f"`{turn}`").alias("turn"),
                F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
            ).alias("_turn"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    )
    checked = grouped.select(
        "conv_id",
        F.flatten(F.transform("_turns", lambda x: _turn_segments(x, template))).alias("segments"),
        _order_error(F.col("_turns"), template).alias("_end"),
    )
    return checked.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("_end.bad").alias("invalid_turn"),
        (F.col("_end.bad").isNull() & F.col("_end.state").isin(*template.final)).alias("complete"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Read formatted text back: ``array<struct<role, text, loss>>``, unescaped.

    Texts hold no marks, so the first closing mark after an opening one ends the turn.
    """
    t = template
    first, middle, last = t.other
    q = re.escape
    shapes = [f"{q(m.before)}.*?{q(m.after)}" for m in t.marks.values()] + [f"{q(first)}.*?{q(middle)}.*?{q(last)}"]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(shapes)), F.lit(0))

    def read(turn):
        rest = F.substring_index(turn, middle, -1)
        role = F.substring_index(F.substr(turn, F.lit(len(first) + 1)), middle, 1)
        out = F.struct(
            unescape(role, t).alias("role"),
            unescape(F.substr(rest, F.lit(1), F.char_length(rest) - len(last)), t).alias("text"),
            F.lit(False).alias("loss"),
        )
        for name, m in t.marks.items():
            inner = F.substr(
                turn, F.lit(len(m.before) + 1), F.char_length(turn) - (len(m.before) + len(m.after))
            )
            own = F.struct(F.lit(name).alias("role"), unescape(inner, t).alias("text"), F.lit(m.loss).alias("loss"))
            out = F.when(F.startswith(turn, F.lit(m.before)), own).otherwise(out)
        return out

    return F.transform(found, read)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"], template)), "")
