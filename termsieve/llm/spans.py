"""Spans of regular-expression matches in code points, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termsieve.functions.arrays import cut, let, parts, running

SPAN = "array<struct<start:int,end:int,hit:string>>"
__all__ = ["by_kind", "by_start", "cut", "empty", "found", "let", "normal_cdf", "outside", "parts", "running", "tagged"]


def outside(fixed: Column, more: Column) -> Column:
    """The spans of more, by start, that lie in none of the fixed ones; spans are (start, end, hit)."""
    both = F.array_sort(
        F.concat(
            F.transform(fixed, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("late"), s["end"].alias("end"), F.lit("").alias("hit"))),
            F.transform(more, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("late"), s["end"].alias("end"), s["hit"].alias("hit"))),
        )
    )
    # In order of their starts a span lies in an earlier fixed one if that reaches as far.
    reach = lambda spans: running(F.transform(spans, lambda s: F.when(s["late"] == 0, s["end"]).otherwise(0)), F.greatest)
    free = lambda spans: F.filter(F.arrays_zip(spans.alias("s"), reach(spans).alias("to")), lambda z: (z["s"]["late"] == 1) & (z["to"] < z["s"]["end"]))
    kept = let(both, lambda b: F.transform(free(b), lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["end"].alias("end"), z["s"]["hit"].alias("hit"))))
    return F.when(F.size(more) > 0, kept).otherwise(empty())


def empty() -> Column:
    return F.array().cast(SPAN)


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, end, hit); the pattern never matches nothing."""
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: _placed(text, pattern, hits))


def _placed(text: Column, pattern: str, hits: Column) -> Column:
    gaps = F.split(text, pattern, -1)
    # gap 0, hit 0, gap 1, hit 1, ...: a hit starts after all gaps up to its own and all hits before.
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    sizes = lambda ps: F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["hit"]))
    whole = let(
        pairs,
        lambda ps: F.transform(
            F.arrays_zip(ps.alias("p"), running(sizes(ps)).alias("at")),
            lambda z: F.struct(
                (z["at"] + F.length(z["p"]["gap"])).alias("start"),
                (z["at"] + F.length(z["p"]["gap"]) + F.length(z["p"]["hit"])).alias("end"),
                z["p"]["hit"].alias("hit"),
            ),
        ),
    )
    return F.when(F.size(hits) > 0, whole).otherwise(empty())


def tagged(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))


def by_start(spans: Column) -> Column:
    """kind:start:end by start, then rank."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["end"].alias("c"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["a"], s["c"])), ",")


def by_kind(spans: Column) -> Column:
    """kind:start:end by rank, then start."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"].alias("a"), s["start"].alias("b"), s["end"].alias("c"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["b"], s["c"])), ",")


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, within 0.0002."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * 1.5976 + z * z * z * 0.070566)))
