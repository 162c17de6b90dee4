"""Chat formatting: a finite-state machine checks the order of roles, a declarative template turns
each conversation into text segments with a loss flag each.

Columns and SQL functions only. One output row per conversation: a conversation is the record to
be trained on, so its turns meet in one row, as the words of a document do."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles are trained on, and which order of roles is valid.

    A turn is ``open + role + middle + text + close``. Inside roles and texts, the first character
    of every control string (marks and ``reserved``) is followed by ``\\.`` and every backslash is
    doubled: no control string survives, and removing the escapes gives the text back."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> next state; anything else is an error
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple[str, ...] = ("answered", "asked")

    def __post_init__(self) -> None:
        leads = {c[0] for c in self.controls if c}
        if not all(self.controls) or any(ESCAPE in c for c in self.controls):
            raise ValueError("control strings are not empty and have no backslash")
        if any(set(mark[1:]) & leads for mark in (self.open, self.middle, self.close)):
            raise ValueError("a mark must not contain the first character of a control string again")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.reserved)

    def escape(self, text: Column) -> Column:
        # each alternative looks ahead, so control strings that overlap are all broken up
        lead = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" if len(c) > 1 else re.escape(c) for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({lead})", r"$1\\.")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"\\(?:\.|(\\))", "$1")


def format_chats(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, segments, valid, error_turn, state): one row per conversation.

    ``segments`` is array<struct<text, loss>>; their concatenation is the formatted text. Turns are
    ordered by (turn, role, text), NULL first; equal rows are all kept. NULL role and text are empty.
    A conversation with turns out of order is formatted all the same, with ``valid`` false and the
    0-based position of the first turn the machine refuses. NULL conv is a conversation of its own.
    Other columns are ignored; no turns give no rows."""
    t = turns.select(F.col(conv).alias("_conv"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"))
    chats = t.groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))

    moves = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)])

    def step(acc: Column, x: Column) -> Column:
        to = F.element_at(moves, F.concat_ws("\n", acc["state"], x["role"]))
        return F.struct(F.coalesce(to, F.lit("error")).alias("state"),
                        F.when(acc["bad"].isNull() & to.isNull(), acc["i"]).otherwise(acc["bad"]).alias("bad"),
                        (acc["i"] + 1).alias("i"))

    run = F.aggregate("_turns", F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad"),
                                         F.lit(0).alias("i")), step)

    def segments(x: Column) -> Column:
        def part(s: Column, loss: Column) -> Column:
            return F.struct(s.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.open), template.escape(x["role"]), F.lit(template.middle))
        return F.array(part(head, F.lit(False)), part(template.escape(x["text"]), x["role"].isin(*template.trained)),
                       part(F.lit(template.close), F.lit(False)))

    return chats.select(F.col("_conv").alias(conv), F.size("_turns").cast("bigint").alias("n_turns"),
                        F.flatten(F.transform("_turns", segments)).alias("segments"), run.alias("_run")).select(
        conv, "n_turns", "segments", (F.col("_run.bad").isNull() & F.col("_run.state").isin(*template.final)).alias("valid"),
        F.col("_run.bad").alias("error_turn"), F.col("_run.state").alias("state"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def read_turns(text: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> parsed back from a formatted text."""
    chunks = F.split(text, re.escape(template.open))

    def parse(c: Column) -> Column:
        parts = F.split(c, re.escape(template.middle))
        return F.struct(template.unescape(F.get(parts, F.lit(0))).alias("role"),
                        template.unescape(F.substring_index(F.get(parts, F.lit(1)), template.close, 1)).alias("text"))

    return F.transform(F.slice(chunks, 2, F.size(chunks)), parse)
