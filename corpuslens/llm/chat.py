"""Chat formatting: a machine over roles checks the order of turns and emits marked segments.

A declarative ``Template`` names, for each role, the strings that open and close a turn, whether
its text counts for the loss, and which roles may follow. Formatting is a fold over the sorted
turns of a conversation; the result is an array of segments ``(text, loss)`` whose concatenation
is the formatted conversation. All of it is DataFrame functions.

Texts cannot forge marks: in a text, every backslash and the first character of every control
string gets a backslash after it. ``unescaped`` takes that back, so that ``read_turns`` and
``read_loss`` restore roles and texts exactly.

Defined cases: a null text or role counts as empty; rows of one conversation go by turn (null
first), then role, then text, and repeated rows all stay; a null ``conv_id`` is a conversation of
its own; a role that the template does not know is written with the template's spare marks and
makes the conversation invalid, as does a turn that may not follow the one before. Invalid
conversations are formatted too and keep their segments; ``valid`` and ``bad_turn`` (the position
of the first bad turn) tell. Other columns are left out. No rows give no rows.

A conversation must fit into one row, as its digest and its text are values of one row; turns
are shuffled once, by ``conv_id``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.text import bind

START = "start"


@dataclass(frozen=True)
class Role:
    name: str
    opens: str
    closes: str
    loss: bool
    follows: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """Marks of the known roles, and spare marks: ``[ROLE]name[TEXT]text[/ROLE]``."""

    roles: tuple[Role, ...]
    spare: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    more_controls: tuple[str, ...] = ("<s>",)

    def controls(self) -> list[str]:
        marks = [m for r in self.roles for m in (r.opens, r.closes)]
        found = list(dict.fromkeys([*marks, *self.spare, *self.more_controls]))
        if any(len(m) < 2 or "\\" in m for m in found):
            raise ValueError("a mark has two characters or more, and no backslash")
        opens = [r.opens for r in self.roles] + [self.spare[0]]
        closes = [r.closes for r in self.roles] + [self.spare[2]]
        if len(set(opens)) < len(opens) or set(opens) & set(closes):
            raise ValueError("each role opens with a mark of its own")
        # A mark may not begin inside another mark or across its end, so that marks are read
        # back where they were written.
        for mark in found:
            if any(other != mark and other in mark for other in found) or any(
                    mark[i:] == other[:len(mark) - i]
                    for other in found for i in range(1, len(mark))):
                raise ValueError(f"the mark {mark} overlaps another")
        return found


DEFAULT = Template((
    Role("system", "[SYS]", "[/SYS]", False, (START,)),
    Role("user", "[INST]", "[/INST]", False, (START, "system", "assistant")),
    Role("assistant", "[OUT]", "</s>", True, ("user",)),
))


def escaped(text: Column, template: Template) -> Column:
    heads = [re.escape(m[0]) + f"(?={re.escape(m[1:])})" for m in template.controls()]
    return F.regexp_replace(text, "|".join([r"\\", *heads]), "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, values: dict[str, Column], spare: Column) -> Column:
    found = spare
    for name, value in values.items():
        found = F.when(role == name, value).otherwise(found)
    return found


def _segments(turn: Column, template: Template) -> Column:
    """Opening mark, text and closing mark of one turn; only the text may carry the loss flag."""
    role, text = turn["role"], escaped(turn["text"], template)
    opens, between, closes = template.spare
    opening = _by_role(role, {r.name: F.lit(r.opens) for r in template.roles},
                       F.concat(F.lit(opens), escaped(role, template), F.lit(between)))
    closing = _by_role(role, {r.name: F.lit(r.closes) for r in template.roles}, F.lit(closes))
    loss = role.isin([r.name for r in template.roles if r.loss])
    return F.array(
        F.struct(opening.alias("text"), F.lit(False).alias("loss")),
        F.struct(text.alias("text"), loss.alias("loss")),
        F.struct(closing.alias("text"), F.lit(False).alias("loss")),
    )


def _run(turns: Column, template: Template) -> Column:
    """Fold the roles through the machine: the state, and the first position that is not allowed."""
    def step(state: Column, turn: Column) -> Column:
        allowed = _by_role(turn["role"], {
            r.name: state["role"].isin(list(r.follows)) for r in template.roles}, F.lit(False))
        bad = F.when(state["bad"] >= 0, state["bad"]).when(~allowed, state["n"]).otherwise(-1)
        return F.struct(turn["role"].alias("role"), (state["n"] + 1).alias("n"), bad.alias("bad"))

    start = F.struct(F.lit(START).alias("role"), F.lit(0).alias("n"), F.lit(-1).alias("bad"))
    return F.aggregate(turns, start, step)


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``conv_id, n_turns, valid, bad_turn, segments, formatted`` for each conversation."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    turns = (rows.select("conv_id", F.struct("turn", filled("role"), filled("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    machine = turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _run(F.col("turns"), template)
        .alias("end"), F.flatten(F.transform("turns", lambda t: _segments(t, template)))
        .alias("segments"))
    bad = F.col("end.bad")
    return machine.select(
        "conv_id", "n_turns", (bad < 0).alias("valid"),
        F.when(bad >= 0, bad.cast("long")).alias("bad_turn"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """Roles and texts, restored from the formatted string alone."""
    closing = "|".join(re.escape(r.closes) for r in template.roles)
    closing = f"{closing}|{re.escape(template.spare[2])}"
    pieces = F.split(formatted, closing)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # each turn ends with a closing mark
    opens, between, _ = template.spare

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, between, -1)
        role = F.regexp_replace(F.substring_index(piece, between, 1), f"^{re.escape(opens)}", "")
        found = F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))
        for r in template.roles:
            text = F.substr(piece, F.lit(len(r.opens) + 1))
            found = F.when(F.startswith(piece, F.lit(r.opens)), F.struct(
                F.lit(r.name).alias("role"), unescaped(text).alias("text"))).otherwise(found)
        return found

    return F.transform(pieces, turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss flags, without its escapes, nothing between."""
    marked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(marked, lambda s: unescaped(s["text"])), "")


def digests(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Lengths and digests of formatted conversations, read back from what was written."""
    line = bind(read_turns(F.col("formatted"), template), lambda turns: F.struct(
        F.size(turns).cast("long").alias("n"), F.array_join(F.transform(
            turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        .alias("said")))
    loss = bind(read_loss(F.col("segments")), lambda text: F.struct(
        F.char_length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("digest")))
    return (conversations.withColumn("read", line).withColumn("under", loss).select(
        "conv_id", F.col("read.n").alias("n_turns"),
        F.sha2(F.col("read.said"), 256).alias("turns_sha256"),
        F.col("under.chars").alias("loss_chars"), F.col("under.digest").alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn"))
