"""Conversations as training text, with turn markers, a loss mask, and a way back.

Turns are collected as structs, sorted, and an aggregate over the array merges adjacent turns of one
role into a block with one header. The loss mask is a list of places in the formatted text. Control
strings start with "<|"; inside roles and texts a backslash is put before the bar of every "<|",
"<\\|", "<\\\\|" and so on, which can be undone and leaves no control string in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import cut, let, parts, running

START, END, NEXT = "<|im_start|>", "<|im_end|>\n", "<|im_next|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


CHUNK = 64
BLOCK = "array<struct<role:string,texts:array<string>>>"


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role; turns are taken in chunks, at whose seams a block may be cut."""

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        return F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["role"] == t["role"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(
            F.concat(acc, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))
        )

    starts = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / CHUNK).cast("int"))
    return F.flatten(F.transform(starts, lambda c: F.aggregate(F.slice(turns, c * CHUNK + 1, CHUNK), F.array().cast(BLOCK), step)))


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss) for each conv_id of turns (conv_id, turn, role, text).

    loss is the loss mask: (start, end) in code points of formatted for each text of loss_roles, in
    order; markers and all else are outside. Turns are ordered by turn, then role, then text; a null
    turn comes first. Null roles and texts count as empty. Rows with a null conv_id form one
    conversation. Repeated rows are turns of their own. Other columns are ignored; an empty table
    gives an empty result. A conversation is one value of the result and so has to fit in one task,
    as do the texts themselves.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        ).alias("t"),
    )
    blocks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv_id", _merged(F.col("ts")).alias("blocks"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("blocks", lambda b: b["role"]))
    zipped = F.arrays_zip(F.col("blocks").alias("b"), F.slice(before, F.lit(1), F.size("blocks")).alias("last"))
    opened = lambda z: F.when(z["last"].isNull(), F.lit(START)).otherwise(F.lit(END + START))
    # A block with the role of the one before it goes on with that one.
    header = lambda z: F.when(z["last"].eqNullSafe(z["b"]["role"]), F.lit(NEXT)).otherwise(F.concat(opened(z), _role_out(z["b"]["role"]), F.lit("\n")))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            zipped,
            lambda z: F.flatten(
                F.transform(
                    z["b"]["texts"],
                    lambda text, i: F.array(piece(F.when(i == 0, header(z)).otherwise(F.lit(NEXT)), F.lit(False)), piece(escape(text), z["b"]["role"].isin(*loss_roles))),
                )
            ),
        )
    )
    placed = let(
        F.col("pieces"), lambda ps: F.arrays_zip(ps.alias("p"), running(F.transform(ps, lambda p: F.length(p["text"]))).alias("at"))
    )
    loss = F.transform(F.filter(placed, lambda z: z["p"]["loss"]), lambda z: F.struct(z["at"].alias("start"), (z["at"] + F.length(z["p"]["text"])).alias("end")))
    return blocks.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: p["text"]), ""), F.lit(END)).alias("formatted"), loss.alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text, unmerged and unescaped."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|im_start\|>", -1)) - 1, F.lit(0)))
    role = lambda b: F.substring_index(b, "\n", 1)
    body = lambda b: F.substring(b, F.length(role(b)) + 2, F.length(b) - F.length(role(b)) - 1 - len(END))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(body(b), r"<\|im_next\|>", -1),
                lambda text: F.struct(_role_back(role(b)).alias("role"), unescape(text).alias("text")),
            ),
        )
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of turns and loss text, read back from the formatted output."""
    turns = F.col("turns")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # What the mask covers is cut from the formatted text.
    loss = let(parts(F.col("formatted")), lambda ps: F.array_join(F.transform("loss", lambda m: unescape(cut(ps, m["start"], m["end"]))), ""))
    return (
        formatted.select("conv_id", "formatted", "loss", read_turns(F.col("formatted")).alias("turns"))
        .select("conv_id", "formatted", F.size(turns).cast("long").alias("n_turns"), said.alias("said"), loss.alias("learned"))
        .select(
            "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
