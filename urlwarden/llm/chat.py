"""Chat formatting: turns of conversations become text segments with loss flags, and back.

A template is declared, not programmed: the marks that open and close turns, the roles whose
texts carry loss, and a finite-state machine over roles. All work is built-in expressions; one
shuffle brings the turns of a conversation together.

Escaping keeps marks out of texts and names of roles: each backslash is doubled, then a backslash
goes behind the first character of each mark. Marks hold no backslash, begin with a character
that they have nowhere else, and no part of a mark ends like the beginning of another, so no mark
arises anew and the way back is exact: a single backslash stands only within a broken mark.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<text:string,loss:boolean>>"


class Template(NamedTuple):
    """opens: role -> mark before its text; other roles have their name between the marks `other`.
    close: mark behind every text. loss: roles whose texts are learnt. moves: (state, role) -> next
    state of the machine that begins in `begin`; ends: states in which a conversation may end."""

    opens: tuple[tuple[str, str], ...] = (("system", "[SYS]"), ("user", "[INST]"), ("assistant", "[/INST]"))
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    close: str = "</s>"
    loss: tuple[str, ...] = ("assistant",)
    begin: str = "begin"
    moves: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "told"), ("begin", "user", "asked"), ("told", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"))
    ends: tuple[str, ...] = ("asked", "answered")

    @property
    def marks(self) -> list[str]:
        return [*(mark for _, mark in self.opens), *self.other, self.close]


def check_template(t: Template) -> None:
    """Refuse marks for which escaping would not be exact."""
    for mark in t.marks:
        if len(mark) < 2 or "\\" in mark or any(m[0] in mark[1:] for m in t.marks):
            raise ValueError(f"mark {mark!r}: two characters or more, no backslash, no first character of a mark inside")
    if len(set(t.marks)) < len(t.marks) or any(a != b and a.startswith(b) for a in t.marks for b in t.marks):
        raise ValueError("no mark may begin with another")
    if len({(state, role) for state, role, _ in t.moves}) < len(t.moves):
        raise ValueError("a state and a role have one move at most")


def _broken(mark: str) -> str:
    return f"{mark[0]}\\{mark[1:]}"


def escape(text: Column, t: Template = Template()) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in t.marks:
        out = F.replace(out, F.lit(mark), F.lit(_broken(mark)))
    return out


def unescape(text: Column, t: Template = Template()) -> Column:
    out = text
    for mark in t.marks:
        out = F.replace(out, F.lit(_broken(mark)), F.lit(mark))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _run_machine(turns: Column, t: Template) -> Column:
    """Fold of the turns: the state and the number of the first turn without a move (null: none).

    A turn without a move leaves the state as it is, so one fault does not end the check.
    """
    moves = F.create_map(*[F.lit(x) for state, role, to in t.moves for x in (f"{state}\n{role}", to)])
    start = F.struct(F.lit(t.begin).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"),
                        F.coalesce(acc["fault"], F.when(to.isNull(), acc["at"])).alias("fault"))

    return F.aggregate(turns, start, step)


def format_chats(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """Segments of each conversation: (conv_id, n_turns, valid, fault, segments).

    turns (conv_id, turn, role, text); other columns are not looked at. Turns are ordered by turn
    (null first), then role, then escaped text; null roles and texts count as empty, and repeated rows are
    turns of their own. Rows without conv_id are one conversation without id. The texts of the
    segments joined are the formatted text; `loss` tells which are learnt. Every conversation is
    formatted, whatever its order; `valid` says whether the machine takes all turns and ends well,
    `fault` the number of the first turn it does not take, from 0. An empty table gives an empty
    table. A conversation is one training text, so it becomes one row, as a document does.
    """
    check_template(t)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    open_mark = None
    for name, mark in t.opens:
        open_mark = (F.when(role == name, F.lit(mark)) if open_mark is None else open_mark.when(role == name, F.lit(mark)))
    open_mark = open_mark.otherwise(F.concat(F.lit(t.other[0]), escape(role, t), F.lit(t.other[1])))
    rows = turns.select("conv_id", F.struct(
        F.col("turn").alias("turn"), role.alias("role"), escape(text, t).alias("body"), open_mark.alias("open"),
        role.isin(*t.loss).alias("loss")).alias("row"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    chats = chats.withColumn("end", _run_machine(F.col("rows"), t))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    parts = F.flatten(F.transform("rows", lambda r: F.array(
        segment(r["open"], no), segment(r["body"], r["loss"]), segment(F.lit(t.close), no))))
    return chats.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"),
        (F.col("end.fault").isNull() & F.col("end.state").isin(*t.ends)).alias("valid"), F.col("end.fault").alias("fault"),
        parts.cast(SEGMENTS).alias("segments"))


def read_chats(chats: DataFrame, t: Template = Template()) -> DataFrame:
    """What formatted conversations say: their columns, formatted, turns and learnt.

    chats holds segments, as format_chats gives them. turns, an array of (role, text), is read from the formatted text
    alone by its marks; learnt holds the texts under the loss flags, in order, unescaped.
    """
    check_template(t)
    # Marks are taken literally; what follows the last closing mark is empty.
    pieces = F.split("formatted", "".join(f"\\x{{{ord(c):x}}}" for c in t.close))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = text = None
        for name, mark in t.opens:
            own, rest = F.startswith(piece, F.lit(mark)), F.substr(piece, F.lit(len(mark) + 1))
            role = F.when(own, F.lit(name)) if role is None else role.when(own, F.lit(name))
            text = F.when(own, rest) if text is None else text.when(own, rest)
        end = F.instr(piece, F.lit(t.other[1]))
        first = len(t.other[0]) + 1
        role = role.otherwise(unescape(F.substr(piece, F.lit(first), end - first), t))
        text = text.otherwise(F.substr(piece, end + len(t.other[1])))
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t))
    joined = chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return joined.withColumns({"turns": F.transform(pieces, turn), "learnt": learnt})
