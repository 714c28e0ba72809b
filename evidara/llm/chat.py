"""Chat formatting: a role machine, a declarative template, and text segments with loss flags.

Everything is a Column expression.  ``segments`` works turn by turn and needs no grouping
except a ``lag`` for the role machine; ``conversations`` puts the segments of a conversation
together, which makes one row of a whole conversation (Spark's limit of 2 GB a row holds).

Defined results: a null role or text is the empty string, a null ``conv_id`` is a conversation
of its own, rows that tie on ``turn`` are taken by role and text, repeated rows stay, columns
other than the four named are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    """How the turns of one role are opened and closed, and whether they are trained on."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, a pair of marks for any other role, and the role machine.

    ``moves`` maps a state (the last role, or "" at the start) to the roles that may follow.
    """

    marks: tuple[tuple[str, Mark], ...] = (
        ("system", Mark("<<SYS>>", "<</SYS>>")),
        ("user", Mark("[INST]", "[/INST]")),
        ("assistant", Mark("[OUT]", "</s>", True)),
    )
    other: Mark = Mark("[TURN]", "[/TURN]")
    moves: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )
    final: tuple[str, ...] = ("assistant",)

    def escapes(self) -> list[tuple[str, str]]:
        """First characters of the marks, each with its code; no escaped text holds one of them."""
        every = [m for _, m in self.marks] + [self.other]
        first = sorted({s[0] for m in every for s in (m.open, m.close)})
        return [("\\", "\\e"), *[(c, "\\" + "abcd"[i]) for i, c in enumerate(first)]]


DEFAULT = Template()
# Between role and text of a turn whose role has no mark; no escaped text holds it.
PART = "\\s"
BROKEN = "!"


def escape(text: Column, template: Template = DEFAULT) -> Column:
    for plain, code in template.escapes():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    for plain, code in reversed(template.escapes()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _by_role(role: Column, template: Template, value, other) -> Column:
    out = None
    for name, mark in template.marks:
        out = (F if out is None else out).when(role == name, F.lit(value(mark)))
    return out.otherwise(F.lit(other))


def turn_segments(role: Column, text: Column, template: Template = DEFAULT) -> Column:
    """Opening mark, text and closing mark of one turn as ``struct(text, loss)``."""
    known = role.isin([name for name, _ in template.marks])
    body = F.when(known, escape(text, template)).otherwise(
        F.concat(escape(role, template), F.lit(PART), escape(text, template))
    )
    off = F.lit(False).alias("loss")
    return F.array(
        F.struct(_by_role(role, template, lambda m: m.open, template.other.open).alias("text"), off),
        F.struct(body.alias("text"), _by_role(role, template, lambda m: m.loss, template.other.loss).alias("loss")),
        F.struct(_by_role(role, template, lambda m: m.close, template.other.close).alias("text"), off),
    )


def _plain(turns: DataFrame) -> DataFrame:
    return turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _move(state: Column, role: Column, template: Template) -> Column:
    allowed = F.lit(False)
    for before, after in template.moves:
        allowed = allowed | ((state == before) & role.isin(list(after)))
    return F.when(allowed, role).otherwise(F.lit(BROKEN))


def segments(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per turn: its segments, and whether the role machine allows the turn here."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _plain(turns).withColumn("_before", F.coalesce(F.lag("role").over(order), F.lit("")))
    return rows.select(
        "conv_id",
        "turn",
        "role",
        (_move(F.col("_before"), F.col("role"), template) != BROKEN).alias("allowed"),
        turn_segments(F.col("role"), F.col("text"), template).alias("segments"),
    )


def conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: segments in order, the formatted text, the machine's verdict."""
    rows = _plain(turns).select("conv_id", F.struct("turn", "role", "text").alias("row"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    state = F.aggregate(F.col("rows"), F.lit(""), lambda s, r: _move(s, r["role"], template))
    made = F.flatten(F.transform(F.col("rows"), lambda r: turn_segments(r["role"], r["text"], template)))
    return ordered.select(
        "conv_id",
        state.isin(list(template.final)).alias("valid"),
        made.alias("segments"),
    ).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted text as ``array<struct(role, text)>``."""
    every = [m for _, m in template.marks] + [template.other]
    first = re.escape("".join(sorted({s[0] for m in every for s in (m.open, m.close)})))
    pattern = "(" + "|".join(re.escape(m.open) for m in every) + f")([^{first}]*+)"
    opens = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))

    def turn(mark: Column, body: Column) -> Column:
        role = None
        for name, m in template.marks:
            role = (F if role is None else role).when(mark == m.open, F.lit(name))
        named = F.substring_index(body, PART, 1)
        free = mark == template.other.open
        text = F.when(free, F.substring(body, F.length(named) + len(PART) + 1, F.length(body))).otherwise(body)
        return F.struct(
            unescape(role.otherwise(named), template).alias("role"), unescape(text, template).alias("text")
        )

    return F.zip_with(opens, bodies, turn)


def digests(made: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Counts and hashes read back from the output of ``conversations``."""
    turns = read_back(F.col("formatted"), template)
    spoken = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), ""
    )
    read = made.select("conv_id", "valid", "formatted", turns.alias("turns"), spoken.alias("spoken"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("spoken").cast("long").alias("loss_chars"),
        F.sha2(F.col("spoken"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
