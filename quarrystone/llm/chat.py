"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags.

Native DataFrame expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Declarative template.

    ``segments`` is what one turn emits; ``{role}`` and ``{text}`` are filled with escaped values.  ``loss_roles``
    are the roles whose ``{text}`` segment is under the loss.  ``controls`` are the strings that must not occur
    inside texts: their first character is replaced by ``escape`` plus a digit, and ``escape`` itself by
    ``escape`` + ``0``; reading back undoes that.  ``transitions`` are the allowed (state, role) moves; the state
    after a turn is its role, and ``start`` before the first.
    """

    segments: tuple[str, ...] = ("[INST]", "{role}", "[/INST]", "{text}", "</s>")
    controls: tuple[str, ...] = ("[INST]", "[/INST]", "<s>", "</s>")
    escape: str = "~"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: tuple[tuple[str, str], ...] = (
        ("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"),
    )
    marks: dict[str, str] = field(default_factory=lambda: {"[": "1", "<": "2"})

    def escaped(self, c: Column) -> Column:
        c = F.replace(c, F.lit(self.escape), F.lit(self.escape + "0"))
        for s in self.controls:
            c = F.replace(c, F.lit(s), F.lit(self.escape + self.marks[s[0]] + s[1:]))
        return c

    def unescaped(self, c: Column) -> Column:
        for first, digit in self.marks.items():
            c = F.replace(c, F.lit(self.escape + digit), F.lit(first))
        return F.replace(c, F.lit(self.escape + "0"), F.lit(self.escape))


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id") -> DataFrame:
    """One row per conversation: ``formatted``, ``segments`` (text, loss), ``n_turns``, ``n_bad_turns``, ``valid``.

    Turns are ordered by turn, role, text (nulls first), so ties and repeated rows give one defined order.  Null
    role or text counts as empty; a null conversation id is one conversation.  A role without an allowed move is
    counted in ``n_bad_turns`` and still emitted, never dropped.  Other input columns are ignored.  An empty
    table gives no rows.  A conversation's text is one output row, so one task holds it whole.
    """
    moves = F.array(*[F.lit(f"{a}>{b}") for a, b in template.transitions])
    packed = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = packed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    machine = F.aggregate(
        "turns",
        F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("bad")),
        lambda s, t: F.struct(
            t["role"].alias("state"),
            (s["bad"] + F.when(F.array_contains(moves, F.concat(s["state"], F.lit(">"), t["role"])), 0).otherwise(1)).alias("bad"),
        ),
        lambda s: s["bad"],
    )

    def emit(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        out = []
        for s in template.segments:
            value = {"{role}": template.escaped(t["role"]), "{text}": template.escaped(t["text"])}.get(s, F.lit(s))
            out.append(F.struct(value.alias("text"), (loss if s == "{text}" else F.lit(False)).alias("loss")))
        return F.array(*out)

    return (
        convs.withColumn("segments", F.flatten(F.transform("turns", emit)))
        .withColumn("n_bad_turns", machine)
        .withColumn("n_turns", F.size("turns").cast("long"))
        .drop("turns")
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("valid", F.col("n_bad_turns") == 0)
    )


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) that a formatted string holds: the inverse of ``format_chats``."""
    open_, _, mid, _, end = template.segments
    parts = F.split(formatted, "\\Q" + end + "\\E", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(s: Column) -> Column:
        both = F.split(F.substring(s, len(open_) + 1, 2147483647), "\\Q" + mid + "\\E", 2)
        return F.struct(template.unescaped(both[0]).alias("role"), template.unescaped(both[1]).alias("text"))

    return F.transform(turns, one)
