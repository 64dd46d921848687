"""Chat formatting: a finite-state machine over roles and a declarative template, with DataFrame functions alone.

The machine reads a conversation's roles in order. Every role moves it to a state, and the state says what is written
around the turn and whether its text is learned; a role that the state before doesn't allow makes the order invalid.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``moves``: the state that each allowed role leads to, for every state, the first being ``start``. ``astray``: the
    state that a role leads to where it isn't allowed; roles without one lead to ``lost``. ``learned``: states whose
    turns' texts are under the loss mask. ``open``, ``close``, ``end``: what stands around a turn's role and text."""

    open: str = "<|"
    close: str = "|>\n"
    end: str = "<|end|>\n"
    start: str = "start"
    lost: str = "lost"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    astray: dict[str, str] = field(default_factory=lambda: {"system": "told", "user": "asked", "assistant": "answered"})
    learned: tuple[str, ...] = ("answered",)

    def states(self) -> list[str]:
        every = [self.start, *self.moves, *[to for m in self.moves.values() for to in m.values()], *self.astray.values(), *self.learned, self.lost]
        return list(dict.fromkeys(every))


#: A text's characters that could begin a control string, and what stands for each. The ampersand is escaped first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("|", "&bar;"), ("[", "&lsq;"), (">", "&gt;"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def lookup(pairs: dict[str, int | str], key: Column, otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), otherwise) if pairs else otherwise


def run_machine(roles: Column, template: Template) -> Column:
    """struct<state, path, valid> after the last of the roles.

    A state is written as one character, and ``path`` is the states that the machine was in, one after the other: a
    string, so that a step appends one byte to it where an array would be built anew.
    """
    code = {s: chr(97 + i) for i, s in enumerate(template.states())}
    allowed = {f"{code[s]}{role}": code[to] for s, moves in template.moves.items() for role, to in moves.items()}
    begin = F.struct(F.lit(code[template.start]).alias("state"), F.lit("").alias("path"), F.lit(True).alias("valid"))

    def step(m: Column, role: Column) -> Column:
        move = lookup(allowed, F.concat(m["state"], role), F.lit(None).cast("string"))
        to = F.coalesce(move, lookup({r: code[s] for r, s in template.astray.items()}, role, F.lit(code[template.lost])))
        return F.struct(to.alias("state"), F.concat(m["path"], to).alias("path"), (m["valid"] & move.isNotNull()).alias("valid"))

    return F.aggregate(roles, begin, step)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, ``segments array<struct<text, loss>>`` in order, and ``valid``, from ``turns(conv_id, turn, role, text)``.

    Every conversation is formatted, in the order of its turns (ties by role, then text; null turns first). What is
    emitted for a turn, and whether its text is learned, follows from the state that its role moves the machine to;
    ``valid`` says whether the machine allowed every move. Null texts and roles count as empty; a null conv_id is a
    conversation of its own; repeated rows are turns of their own; an empty table gives no rows; other columns are
    ignored. A conversation becomes one row, since its output is one text.
    """
    code = {s: chr(97 + i) for i, s in enumerate(template.states())}
    said = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    ran = chats.withColumn("machine", run_machine(F.transform("turns", lambda t: t["role"]), template))

    def segments(t: Column, state: Column) -> Column:
        head = F.concat(F.lit(template.open), escape(t["role"]), F.lit(template.close))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), state.isin(*[code[s] for s in template.learned]).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    return ran.select("conv_id", F.flatten(F.zip_with("turns", F.split("machine.path", ""), segments)).alias("segments"), "machine.valid")


def formatted(segments: Column, loss_only: bool = False) -> Column:
    """The text of the segments, or of those under the loss mask."""
    kept = F.filter(segments, lambda s: s["loss"]) if loss_only else segments
    return F.array_join(F.transform(kept, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = Template()) -> Column:
    """``array<struct<role, text>>`` of a formatted text: the control strings can't stand inside a role or text."""
    quoted = lambda s: "\\Q" + s + "\\E"
    turns = F.filter(F.split(text, quoted(template.end)), lambda x: x != "")
    part = lambda x, k: unescape(F.regexp_extract(x, f"(?s)^{quoted(template.open)}(.*?){quoted(template.close)}(.*)$", k))
    return F.transform(turns, lambda x: F.struct(part(x, 1).alias("role"), part(x, 2).alias("text")))
