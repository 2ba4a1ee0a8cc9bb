"""Near-duplicate embeddings from int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and rounded to int8 with a scale of their own; e is the exact
length of what rounding left. For unit vectors u, v with rounded forms u', v' the cosine differs
from u'.v' by at most e_v + e_u * (1 + e_v). Tiles of a label's vectors are multiplied in integers
(exact in float32 at these sizes); only pairs that may reach the threshold within the bound are
computed again in double precision. Equal vectors of a label are one vector with a count. A tile
pair goes through its products block by block, and returns for each vector its number of links and
the smallest vector it reaches inside the tile pair, never the pairs themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .joins import dealt_join, hot_keys
from .scratch import Scratch
from .vectors import usable


@dataclass(frozen=True)
class EmbeddingOptions:
    """Link vectors of one label with cosine >= threshold; tiles hold about `tile` vectors, at most 8 times that; block: products held at once."""

    threshold: float = 0.98
    tile: int = 512
    block: int = 1 << 19


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, their int8 forms, scales, and upper bounds of the rounding errors' lengths."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    left = unit - scale[:, None] * q
    return unit, q, scale, np.sqrt(np.einsum("ij,ij->i", left, left)) + 1e-12


def possible_pairs(a, b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two quantised tiles whose cosine may reach the threshold."""
    _, qa, sa, ea = a
    _, qb, sb, eb = b
    kind = np.float32 if qa.shape[1] <= 1000 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    near += eb[None, :] + ea[:, None] * (1 + eb[None, :]) + 1e-12
    return np.nonzero(near >= threshold)


def linked(ids: np.ndarray, count: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, diagonal: bool, o: EmbeddingOptions) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector, counting copies, and the place of the smallest id it reaches; ids ascend.

    left and right are the places of the two tiles' vectors. Besides the vectors, o.block products are in memory.
    """
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    every = quantise(x)
    part = lambda at: tuple(v[at] for v in every)
    links = np.zeros(len(ids), dtype=np.int64)
    root = np.arange(len(ids))
    b = part(right)
    step = max(1, o.block // len(right))
    for first in range(0, len(left), step):
        at = left[first : first + step]
        i, j = possible_pairs(part(at), b, o.threshold)
        i, j = at[i], right[j]
        if diagonal:
            i, j = i[i < j], j[i < j]
        cos = np.concatenate(
            [np.einsum("ij,ij->i", x[i[s : s + 16384]], x[j[s : s + 16384]]) for s in range(0, len(i), 16384)] or [np.zeros(0)]
        ) / (norms[i] * norms[j])
        ok = cos >= o.threshold
        i, j = i[ok], j[ok]
        links += np.bincount(i, weights=count[j], minlength=len(ids)).astype(np.int64) + np.bincount(j, weights=count[i], minlength=len(ids)).astype(np.int64)
        # Larger roots are hung below smaller ones until both ends of every link have one root.
        while len(i):
            ri, rj = root[i], root[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (root != root[root]).any():
                root = root[root]
    return links, root


def _tile(o: EmbeddingOptions):
    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("rep", kind="stable")
        ids, side = frame["rep"].to_numpy(), frame["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        diagonal = key[2] == key[3]
        if diagonal:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64"), "root": pd.Series([], dtype="int64")})
        x = np.stack([np.asarray(v, dtype=np.float64) for v in frame["embedding"]])
        links, root = linked(ids, frame["m"].to_numpy(), x, left, right, diagonal, o)
        has = links > 0
        return pd.DataFrame({"rep": ids[has], "links": links[has], "root": ids[root[has]]})

    return run


def embedding_duplicates(
    vectors: DataFrame, options: EmbeddingOptions | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows whose label
    or vec_id is null, link with nothing: n_links 0, component_id their vec_id, kept true. Vectors
    of different lengths don't link. Rows that agree in vec_id, vector and label count once and give
    equal results; different vectors under one vec_id count as vectors of their own, which are one
    node of the components. Other columns are ignored; an empty table gives an empty result.
    """
    o = options or EmbeddingOptions()
    scratch = Scratch(vectors.sparkSession, "embeddings")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    fine = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Equal vectors agree in both hashes, 128 bits together.
    keys = ["label", "dim", "fp_a", "fp_b"]
    named = base.select("vec_id", "embedding", "label", fine.alias("ok"), F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("fp_a"), F.xxhash64(F.lit(1), "embedding").alias("fp_b"))
    once = named.where("ok").dropDuplicates(["vec_id", *keys])
    classes = once.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.min_by("embedding", "vec_id").alias("embedding"), F.count("*").alias("m"))
    classes = scratch.keep(classes, "classes")
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(o.tile), F.least(F.lit(8 * o.tile), F.ceil(F.col("n") / 12))).cast("int")
    counts = counts.select("label", "dim", "n", F.ceil(F.col("n") / size).cast("int").alias("tiles"))
    total = classes.count()
    placed = dealt_join(classes, counts, ["label", "dim"], hot_keys(counts, ["label", "dim"], "n", total), ["rep"])
    placed = placed.withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # A vector of tile t goes to the pairs (t, j) for j >= t as the left side, (i, t) for i < t as the right.
    sides = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda k: F.struct(F.least(F.col("t"), k).alias("i"), F.greatest(F.col("t"), k).alias("j"), (F.col("t") > k).cast("int").alias("side")),
    )
    spread = placed.select("label", "dim", "rep", "m", "embedding", F.explode(sides).alias("p")).select("label", "dim", "p.i", "p.j", "p.side", "rep", "m", "embedding")
    found = spread.groupBy("label", "dim", "i", "j").applyInPandas(_tile(o), "rep long, links long, root long")
    found = scratch.keep(found, "links")
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch, "components")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    told = (
        classes.select(*keys, "rep", "m").join(totals, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*keys, (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    rows = named.drop("embedding")
    out = dealt_join(rows.where("ok"), told, keys, hot_keys(classes, keys, "m", total), ["vec_id"])
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return out.select("vec_id", "n_links", "component").unionAll(alone).select(
        "vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept")
    )
