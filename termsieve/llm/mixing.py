"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, the logarithm of a hash in (0, 1) divided by its quality
weight; in each source documents are taken in key order until the source's token budget is used.
Whole passes over a source come first, the fraction that is left is sampled. Keys are cut into
ranges, whose token counts are summed before any sorting: a source of any size is sorted range by
range. A weight moves the logarithm of a key and doesn't stretch it, so ranges of equal width in
the logarithm hold at most about 0.37 of the square root of the source's documents each, whatever
the weights are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termsieve.functions.columns import fresh

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
FEW_SOURCES = 10_000


@dataclass(frozen=True)
class MixOptions:
    """weights repeat over the sources in code-point order; share is of all tokens; passes bounds repeats."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    passes: int = 2
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight in 0.1..1: the share of distinct lines, less two times that of ASCII's signs and digits in the text; 1 for null.

    Commas and full stops don't count. The class of ASCII alone is what a regular expression looks through fastest.
    """
    n = F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, "\n", -1)
    odd = F.regexp_count(text, F.lit(r"[!-+/-@\[-`{-~-]")) / n
    weight = F.size(F.array_distinct(lines)) / F.size(lines) - 2 * odd
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), weight))


def targets(sources: DataFrame, o: MixOptions) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size).

    Budget goes by weight; no source gets more than passes times its size, and what it can't use
    goes to the others by weight until none is above. That is least(cap, level * weight) at the
    level where the targets add up; sources in the order of cap / weight, the level is the first at
    which the next source isn't capped.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    n = len(o.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in o.weights]), (turn % n + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * o.passes)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every) * o.share)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
        .withColumn("level", F.when(F.col("cap") / F.col("weight") > F.col("left") / F.col("open"), F.col("left") / F.col("open")))
    )
    # Later levels come out too low or equal: the first is the one that holds.
    first = F.min(F.when(F.col("level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    return ranked.withColumn("target", F.coalesce(F.least(F.col("cap"), first["level"] * F.col("weight")), F.col("cap"))).drop(
        "cap", "total", "left", "open", "level"
    )


def _key(o: MixOptions, id_col: str, text: Column) -> Column:
    known = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    u = (F.pmod(F.xxhash64(known, F.xxhash64(text), F.lit(o.seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality(text)


def key_range(key: Column, n: Column) -> Column:
    """The range of a key among n documents."""
    return F.floor(F.log(key) * F.sqrt(n)).cast("long")


def _ranked(docs: DataFrame, o: MixOptions, scratch: Scratch, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text.alias("text"), word_count(text).alias("size"))
    sized = scratch.keep(sized.select("doc_id", "source", "size", _key(o, "doc_id", F.col("text")).alias("key")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = scratch.keep(targets(sources, o), "sources")
    small = F.broadcast(sources) if sources.count() <= FEW_SOURCES else sources
    placed = sized.join(small.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("range", key_range(F.col("key"), F.col("n")))
    placed = placed.withColumn("src", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    sums = placed.groupBy("src", "range").agg(F.sum("size").alias("in_range"))
    ahead = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "range", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(sums, ["src", "range"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(o.passes))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    # A document at the end of the budget is taken if most of it fits.
    more = (F.col("size") > 0) & (F.col("whole") < o.passes) & (F.col("ahead") + F.col("size") / 2 <= rest)
    return ranked.withColumn("whole", whole).withColumn("more", more)


def mix(docs: DataFrame, options: MixOptions | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs.

    size counts the text's words; a null or empty text has none and is never taken. A null source
    is a source of its own, last in order. copies is how often the mix takes the document, taken
    the words that makes. Keys depend on the doc_id, the text's hash and the seed only, so reruns
    agree; a null doc_id counts as -1; rows that agree in all of this are interchangeable. Other
    columns are ignored; an empty table gives an empty result.
    """
    ranked = _ranked(docs, options or MixOptions(), Scratch(docs.sparkSession, "mix"), id_col, text_col, source_col)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more").cast("long")).otherwise(F.lit(0)).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, options: MixOptions | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies in mix().

    What is taken in part of a pass is a run of keys from the smallest, so each source's last key
    decides, and texts aren't dealt again. Rows that repeat the document at that key all count.
    """
    o = options or MixOptions()
    source, whole, cut, size, key, copy = (fresh(docs, c) for c in ("source", "whole", "cut", "size", "key", "copy"))
    scratch = Scratch(docs.sparkSession, "mixed")
    cuts = _ranked(docs, o, scratch, id_col, text_col, source_col).groupBy("source").agg(
        F.max("whole").alias(whole), F.max(F.when(F.col("more"), F.col("key"))).alias(cut)
    )
    cuts = scratch.keep(cuts.withColumnRenamed("source", source), "cuts")
    scratch.keep_only("cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= FEW_SOURCES else cuts
    keyed = docs.withColumns({size: word_count(F.col(text_col)), key: _key(o, id_col, F.col(text_col))})
    keyed = keyed.join(cuts, F.col(source_col).eqNullSafe(F.col(source)))
    copies = F.col(whole) + F.coalesce(F.col(key) <= F.col(cut), F.lit(False)).cast("long")
    taken = keyed.where((F.col(size) > 0) & (copies > 0)).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
