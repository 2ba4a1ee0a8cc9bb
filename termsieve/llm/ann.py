"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to cells of width w along a few Gaussian directions. A query visits cells
in the order of the estimated chance that a neighbour at distance R lies in them, the product over
directions of the normal mass of the cell's interval around the query's projection, until the
visited cells hold a set share of the chance, and in the first table at least as many rows as are
asked for. Largest inner product is made nearest distance by one further component, which gives all
rows one length.

Rows are dealt by their cells: neighbouring cells share a bucket of bounded size, a cell of more
rows has several. A query goes to the buckets with a cell that it visits, and is compared there with
the rows of these cells in double precision. Each bucket returns the best few rows for each query;
those of all tables are merged.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .vectors import usable


@dataclass(frozen=True)
class AnnOptions:
    """tables of directions each; width and radius are relative to the rows' longest length.

    share is the part of the estimated chance that the visited cells of each table hold. A bucket has a
    twelfth of the rows within the bounds of bucket_rows; query_rows of the queries that visit it, and block
    products, are in memory at once.
    """

    k: int = 20
    tables: int = 3
    directions: int = 4
    width: float = 1.2
    radius: float = 1.12
    share: float = 0.82
    seed: int = 29
    bucket_rows: tuple[int, int] = (512, 8192)
    query_rows: int = 2048
    block: int = 1 << 20


def _mass(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Normal mass between two standard scores."""
    cdf = lambda z: 1.0 / (1.0 + np.exp(-np.clip(1.5976 * z + 0.070566 * z * z * z, -60, 60)))
    return cdf(high) - cdf(low)


SPAN = 4096


def _hash(dim: int, o: AnnOptions, table: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's directions for vectors of dim components and one more, and its shifts."""
    rng = np.random.default_rng(o.seed + table)
    return rng.standard_normal((dim + 1, o.directions)), rng.uniform(0, o.width, o.directions)


def extended(x: np.ndarray, longest: float) -> np.ndarray:
    x = x / longest
    return np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))]


def cells_of(ext: np.ndarray, o: AnnOptions, table: int) -> np.ndarray:
    """Each row's cell, its coordinates as the digits of one number."""
    directions, shift = _hash(ext.shape[1] - 1, o, table)
    at = np.clip(np.floor((ext @ directions + shift) / o.width), -SPAN // 2, SPAN // 2 - 1).astype(np.int64) + SPAN // 2
    return at @ SPAN ** np.arange(o.directions)[::-1]


def visited(ext_q: np.ndarray, cells: np.ndarray, rows: np.ndarray, o: AnnOptions, table: int) -> np.ndarray:
    """Which of a table's occupied cells, which hold so many rows, each query visits."""
    directions, shift = _hash(ext_q.shape[1] - 1, o, table)
    own = cells[:, None] // SPAN ** np.arange(o.directions)[::-1] % SPAN - SPAN // 2
    at = ext_q @ directions + shift
    chance = np.ones((len(ext_q), len(cells)))
    for d in range(o.directions):
        # Few intervals of a direction are taken; each one's mass is worked out once.
        taken, which = np.unique(own[:, d], return_inverse=True)
        low = taken[None, :] * o.width - at[:, d : d + 1]
        chance *= _mass(low / o.radius, (low + o.width) / o.radius)[:, which]
    order = np.argsort(-chance, axis=1, kind="stable")
    held = np.cumsum(np.take_along_axis(chance, order, axis=1), axis=1)
    # A cell is visited while the cells before it hold less than the share, or too few rows beside the query's own.
    wanted = np.c_[np.zeros(len(ext_q)), held[:, :-1]] < o.share * held[:, -1:]
    if table == 0:
        seen = np.cumsum(rows[order], axis=1)
        wanted |= np.c_[np.zeros(len(ext_q), dtype=np.int64), seen[:, :-1]] <= o.k
    out = np.zeros_like(wanted)
    np.put_along_axis(out, order, wanted, axis=1)
    return out


def buckets(cells: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell, in ascending order, its first bucket and how many buckets it has for itself."""
    first, splits = np.zeros(len(cells), dtype=np.int64), np.ones(len(cells), dtype=np.int64)
    at, filled = 0, 0
    for i, n in enumerate(rows):
        if filled and filled + n > most:
            at, filled = at + 1, 0
        first[i], splits[i] = at, max(1, math.ceil(n / most))
        filled += int(n)
        if splits[i] > 1:
            at, filled = at + int(splits[i]), 0
    return first, splits


def _vectors(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _hasher(o: AnnOptions, longest: dict[int, float]):
    def run(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                ext = extended(_vectors(part["embedding"]), longest[dim])
                cells = np.stack([cells_of(ext, o, t) for t in range(o.tables)], axis=1)
                yield part.assign(cells=list(cells))

    return run


def _prober(o: AnnOptions, tables: dict):
    """tables: for (dim, table) the cells in ascending order, their rows, first buckets and numbers of buckets."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if (dim, 0) not in tables:
                    continue
                q = _vectors(part["embedding"])
                ext = np.c_[q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None], np.zeros(len(q))]
                ids, own = part["vec_id"].to_numpy(), part["embedding"].to_numpy()
                for t in range(o.tables):
                    cells, rows, first, splits = tables[dim, t]
                    step = max(1, o.block // len(cells))
                    for s in range(0, len(q), step):
                        who, cell = np.nonzero(visited(ext[s : s + step], cells, rows, o, t))
                        # One row for each query and bucket, with the cells to look at.
                        times = splits[cell]
                        who, of = np.repeat(who, times), np.repeat(cell, times)
                        bucket = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                        order = np.lexsort((of, bucket, who))
                        who, of, bucket = who[order], of[order], bucket[order]
                        new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (bucket[1:] != bucket[:-1])])
                        lists = np.split(cells[of], new[1:])
                        picked = s + who[new]
                        yield pd.DataFrame(
                            {"q_dim": dim, "q_table": t, "q_bucket": bucket[new], "query_id": ids[picked], "query": own[picked], "look": lists}
                        )

    return run


def _search(o: AnnOptions):
    def run(key, queries, rows):
        import pandas as pd

        empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        if not len(queries) or not len(rows):
            return empty
        rows = rows.sort_values(["cell", "vec_id"], kind="stable")
        x, x_id, cell = _vectors(rows["embedding"]), rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
        step = max(1, o.block // len(x))
        found = [_best(queries.iloc[s : s + step], x, x_id, cell, o.k) for s in range(0, len(queries), step)]
        return pd.concat([f for f in found if len(f)] or [empty], ignore_index=True)

    return run


def _best(queries, x: np.ndarray, x_id: np.ndarray, cell: np.ndarray, k: int):
    """The k best rows of the cells that each query looks at."""
    import pandas as pd

    q, q_id = _vectors(queries["query"]), queries["query_id"].to_numpy()
    score = np.full((len(q), len(x)), -np.inf)
    sizes = [len(v) for v in queries["look"]]
    who, look = np.repeat(np.arange(len(q)), sizes), np.concatenate([np.asarray(v, dtype=np.int64) for v in queries["look"]])
    order = np.argsort(look, kind="stable")
    who, look = who[order], look[order]
    for c in np.unique(cell):
        at = slice(*np.searchsorted(cell, [c, c + 1]))
        asking = who[slice(*np.searchsorted(look, [c, c + 1]))]
        if len(asking):
            score[asking, at] = q[asking] @ x[at].T
    score[q_id[:, None] == x_id[None, :]] = -np.inf
    keep = min(k, len(x))
    bound = np.partition(score, len(x) - keep, axis=1)[:, len(x) - keep]
    # Products of matrices may round otherwise than one pair's sum: near ties go on.
    least = np.where(np.isfinite(bound), bound - 1e-9 * (1 + np.abs(bound)), -np.inf)
    i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    exact = (x[j] * q[i]).sum(axis=1)
    order = np.lexsort((x_id[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < keep
    return pd.DataFrame({"query_id": q_id[i[best]], "vec_id": x_id[j[best]], "score": exact[best]})


def nearest(
    vectors: DataFrame, queries: DataFrame, options: AnnOptions | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest inner products found.

    vectors and queries both have id_col and vector_col; a query's own row, told by its id, is no
    candidate. Vectors that are null, empty, zero or hold a null or non-finite component take no
    part, nor do rows without an id; vectors of another length than the query's are no candidates.
    Ties go to the smaller id. A query without candidates has no rows. Repeated rows of one id and
    vector count once; other columns are ignored; empty tables give an empty result. Every row is
    indexed; what is gathered at the driver is the longest length by dimension and the occupied
    cells with their numbers of rows, whose number the width and the directions bound, not the rows.
    """
    o = options or AnnOptions()
    if not 1 <= o.directions <= 5:
        raise ValueError("between 1 and 5 directions can be told apart")
    scratch = Scratch(vectors.sparkSession, "nearest")
    part = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(
        usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    ).dropDuplicates().withColumn("dim", F.size("embedding"))
    rows, asked = scratch.keep(part(vectors), "rows"), part(queries)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    kind = rows.schema["embedding"].dataType.simpleString()
    stats = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("longest")).collect()
    hashed = rows.mapInPandas(_hasher(o, {s["dim"]: s["longest"] for s in stats}), f"vec_id long, embedding {kind}, dim int, cells array<long>")
    hashed = scratch.keep(hashed, "hashed").select("dim", "vec_id", "embedding", F.posexplode("cells").alias("table", "cell"))
    counted = sorted(map(tuple, hashed.groupBy("dim", "table", "cell").count().collect()))
    most = {s["dim"]: max(o.bucket_rows[0], min(o.bucket_rows[1], math.ceil(s["n"] / 12))) for s in stats}
    tables, places = {}, []
    for (dim, table), own in itertools.groupby(counted, key=lambda r: r[:2]):
        cells, sizes = np.array([r[2:] for r in own], dtype=np.int64).T
        first, splits = buckets(cells, sizes, most[dim])
        tables[dim, table] = (cells, sizes, first, splits)
        places += [(dim, table, int(c), int(f), int(n)) for c, f, n in zip(cells, first, splits, strict=True)]
    spread = vectors.sparkSession.createDataFrame(places, "dim int, table int, cell long, first long, splits long")
    right = hashed.join(F.broadcast(spread), ["dim", "table", "cell"]).withColumn("bucket", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("splits")))
    kind = asked.schema["embedding"].dataType.simpleString()
    visits = asked.mapInPandas(_prober(o, tables), f"q_dim int, q_table int, q_bucket long, query_id long, query {kind}, look array<long>")
    visits = scratch.keep(visits, "visits")
    # A bucket that many queries visit is copied for every query_rows of them.
    asking = visits.groupBy("q_dim", "q_table", "q_bucket").agg(F.ceil(F.count("*") / o.query_rows).cast("int").alias("chunks"))
    left = visits.join(asking, ["q_dim", "q_table", "q_bucket"]).withColumn("q_chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    right = right.join(asking.select(F.col("q_dim").alias("dim"), F.col("q_table").alias("table"), F.col("q_bucket").alias("bucket"), "chunks"), ["dim", "table", "bucket"])
    right = right.select("dim", "table", "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "embedding", "cell")
    found = (
        left.select("q_dim", "q_table", "q_bucket", "q_chunk", "query_id", "query", "look").groupBy("q_dim", "q_table", "q_bucket", "q_chunk")
        .cogroup(right.groupBy("dim", "table", "bucket", "chunk")).applyInPandas(_search(o), "query_id long, vec_id long, score double")
    )
    # A row that several tables find stands side by side with itself: dense ranks count it once.
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= o.k)
    return ranked.groupBy("query_id", "rank", "vec_id", "score").agg(F.count("*").alias("times")).drop("times")
