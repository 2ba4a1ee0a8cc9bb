"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_ROUNDS = 60
SALTS = 8


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS))


def _each_salt(low: DataFrame) -> DataFrame:
    """A row for each salt: the edges of one node, however many, are dealt over several tasks."""
    return low.select(F.col("u").alias("of"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Nodes without an edge to another node don't appear. Null ends and loops are ignored. Each
    round writes its edges to the scratch folder. A round needs minima by node, which Spark computes
    with partial aggregates, and joins with them, in which a hot node's edges are salted.
    """
    e = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u is not null and v is not null and u <> v").distinct()
    e = scratch.keep(e, f"{label}-0")
    before = None
    for r in range(1, MAX_ROUNDS):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        # Nodes without a smaller neighbour change nothing and aren't looked up.
        low = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
        up = both.where("v > u")
        large = (
            up.join(_each_salt(low), [up.u == F.col("of"), _salt("v") == F.col("salt")], "left")
            .select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
        )
        # Small star: smaller neighbours and the node itself are linked to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        small = (
            large.join(_each_salt(low2), [large.u == F.col("of"), _salt("v") == F.col("salt")])
            .select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("s"))
            .select("s.u", "s.v").where("u <> v").distinct()
        )
        e = scratch.keep(small, f"{label}-{r}")
        # A star forest is a fixed point: as many edges as nodes above a root, and equal sums.
        now = e.agg(F.count("*"), F.countDistinct("u"), F.sum(F.hash("u", "v").cast("long"))).first()
        roots_are_leaves = e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0
        scratch.drop(f"{label}-{r - 1}")
        if roots_are_leaves and now[0] == now[1] or now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
