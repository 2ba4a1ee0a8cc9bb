"""Near-duplicate documents by one-permutation MinHash with optimal densification.

Sets of word shingles are hashed once; the hash range is cut into bins whose minima form the
sketch. Empty bins borrow from bins picked by a hash of (bin, attempt), so two sketches agree in
each bin with the probability of the sets' Jaccard similarity. Bands of bins become bucket keys.
Each bucket yields a star of candidate edges from one centre to its other members; edges are
confirmed on full sets. Where members of a bucket still lie in different components, their sets
are compared in tiles with everything else in the bucket's group, so that no link is lost to the
star's bound. Equal sets are one node throughout, which keeps groups of copies out of the buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termsieve.functions.columns import fresh

from .graph import connected_components
from .joins import dealt_join, hot_keys
from .scratch import Scratch
from .shingles import mix, shingle_sets
from .workers import let_go, small_batches

_U = np.uint64
SALTS = 32


@dataclass(frozen=True)
class MinHashOptions:
    """Link sets with 100 * intersection >= percent * union.

    With 42 bands of 6 bins a pair at similarity 0.85 shares no bucket with probability 2e-9,
    one at 0.8 with 3e-6.
    """

    width: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    tile: int = 96


_donors: dict[int, np.ndarray] = {}


def _donor_block(bins: int, block: int) -> np.ndarray:
    """For each bin the donors of 32 attempts."""
    key = bins * 100_000 + block
    if key not in _donors:
        attempt = np.arange(block * 32, block * 32 + 32, dtype=np.uint64)
        grid = np.arange(bins, dtype=np.uint64)[:, None] * _U(1 << 32) + attempt[None, :]
        _donors[key] = (mix(mix(grid + _U(0x632BE59BD9B4E019))) % _U(bins)).astype(np.int64)
    return _donors[key]


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Minima of the bins of sorted distinct hashes, densified; hashes must not be empty."""
    step = _U((1 << 64) // bins + 1)
    bin_of = (hashes // step).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    out = np.zeros(bins, dtype=np.uint64)
    full = np.zeros(bins, dtype=bool)
    out[bin_of[first]] = hashes[first]
    full[bin_of[first]] = True
    empty = np.flatnonzero(~full)
    block = 0
    while len(empty):
        donors = _donor_block(bins, block)[empty]
        ok = full[donors]
        hit = ok.any(axis=1)
        out[empty[hit]] = out[donors[hit, ok[hit].argmax(axis=1)]]
        empty = empty[~hit]
        block += 1
    return out


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sketch(hashes, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + s[:, r])
    return key.view(np.int64)


def _sketcher(o: MinHashOptions):
    def run(batches):
        let_go()
        for batch in batches:
            n, a, b, keys, counts = [], [], [], [], [0]
            for h in shingle_sets(batch.column("text"), o.width):
                n.append(len(h))
                a.append(int(mix(h + _U(0x1234567)).sum(dtype=np.uint64)) if len(h) else 0)
                b.append(int(np.bitwise_xor.reduce(mix(h * _U(0xD1342543DE82EF95)))) if len(h) else 0)
                if len(h):
                    keys.append(band_keys(h, o.bands, o.rows))
                counts.append(counts[-1] + (o.bands if len(h) else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(a, np.uint64).view(np.int64)),
                    pa.array(np.array(b, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "text_hash", "n_shingles", "fp_a", "fp_b", "bands"],
            )

    return run


def _set_maker(width: int):
    def run(batches):
        let_go()
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            counts = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(flat))],
                ["doc_id", "hashes"],
            )

    return run


def _tile_links(percent: int):
    """Compare the left documents of one tile pair with its right ones; emit a forest of the links."""

    def run(key, left, right):
        import pandas as pd

        none = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        if not len(left) or not len(right):
            return none
        r_sets = [np.asarray(h) for h in right["hashes"]]
        r_size = np.array([len(h) for h in r_sets])
        values = np.concatenate(r_sets)
        owner = np.repeat(np.arange(len(r_sets)), r_size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        r_comp, r_id = right["comp"].to_numpy(), right["doc"].to_numpy()
        found = []
        for doc, comp, h in zip(left["one"], left["own"], left["set"], strict=True):
            h = np.asarray(h)
            lo, hi = np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")
            spans = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
            common = np.bincount(owner[at], minlength=len(r_sets))
            ok = (100 * common >= percent * (len(h) + r_size - common)) & (r_comp != comp)
            if ok.any():
                # One link for each component reached is enough.
                _, first = np.unique(r_comp[ok], return_index=True)
                found += [(int(comp), int(c)) for c in r_comp[ok][first]]
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"]) if found else none

    return run


def near_duplicates(docs: DataFrame, options: MinHashOptions | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of docs.

    Words are runs of anything but the six ASCII spaces, A-Z lower-cased. Null, empty and blank
    texts have no shingles, link with nothing and are kept. Repeated rows give repeated results.
    Rows whose doc_id is null link with nothing: component_id is null and kept is true. Texts
    under one repeated doc_id are separate documents unless a class of equal sets has that id as
    its smallest. Other columns of docs are ignored. An empty table gives an empty result.
    """
    o = options or MinHashOptions()
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.keep(
        base.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketcher(o), "doc_id long, text_hash long, n_shingles long, fp_a long, fp_b long, bands array<long>"), "sketches"
    )
    # Classes of equal sets; the smallest doc_id stands for its class.
    classes = scratch.keep(
        sketches.where("n_shingles > 0 and doc_id is not null")
        .groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")),
        "classes",
    )
    rows = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    centre = (
        rows.groupBy("key")
        .agg(F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("doc"), F.col("n_shingles").alias("size"))).alias("c"), F.count("*").alias("n"))
        .where("n > 1").select("key", F.col("c.doc").alias("centre"), F.col("c.size").alias("centre_size"), "n")
    )
    centre = scratch.keep(centre, "centres")
    hot = hot_keys(centre, ["key"], "n", classes.count() * o.bands)
    members = scratch.keep(
        dealt_join(rows, centre, ["key"], hot, ["rep"]).where("rep <> centre")
        .select("key", F.col("rep").alias("doc"), F.col("n_shingles").alias("size"), "centre", "centre_size", "n"),
        "members",
    )
    wanted = scratch.keep(
        members.select(F.explode(F.array("doc", "centre")).alias("doc_id")).distinct(), "wanted"
    )
    # Copies of one class hold equal sets: each wanted document is cut into shingles once.
    sets = scratch.keep(
        base.join(wanted, "doc_id", "left_semi").mapInArrow(_set_maker(o.width), "doc_id long, hashes array<long>")
        .select("doc_id", "hashes"),
        "sets",
    )
    # Sets whose sizes differ too much can't be similar enough.
    close = 100 * F.least("size", "centre_size") >= o.percent * F.greatest("size", "centre_size")
    stars = scratch.keep(members.where(close).select("doc", "centre").distinct(), "stars")
    linked = _confirmed(stars, sets, o.percent)
    links = scratch.keep(linked, "star-links")
    comps = connected_components(links.select("a", "b"), scratch, "first")
    more = _rest(members, comps, sets, scratch, o)
    every = links.unionAll(more)
    comps = connected_components(every, scratch, "second")
    rep_comp = (
        classes.select("fp_a", "fp_b", "n_shingles", "rep")
        .join(comps, classes.rep == comps.node, "left")
        .select("fp_a", "fp_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    )
    scratch.keep_only("sketches", "classes", "second-")
    out = sketches.select("doc_id", "text_hash", "n_shingles", "fp_a", "fp_b").join(rep_comp, ["fp_a", "fp_b", "n_shingles"], "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash",
    )


def keep_one(docs: DataFrame, options: MinHashOptions | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that near_duplicates doesn't keep; of rows that repeat a doc_id and text one stays."""
    judged = near_duplicates(docs, options, id_col, text_col)
    name, hashed, times = (fresh(docs, c) for c in ("id", "hash", "n"))
    names = judged.where("kept").groupBy(F.col("doc_id").alias(name), F.col("text_hash").alias(hashed)).agg(F.count("*").alias(times))
    names = Scratch(docs.sparkSession, "kept").keep(names, "names")
    text = F.xxhash64(F.col(text_col).cast("string"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(name)) & (text == F.col(hashed))
    out = docs.join(names.select(name, hashed), same, "left_semi")
    # Rows of a repeated name are few; only they are grouped.
    again = names.where((F.col(times) > 1) & F.col(name).isNotNull()).select(name, hashed)
    if again.isEmpty():
        return out
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (doc, centre) whose full sets are similar enough, as (a, b)."""
    left = sets.select(F.col("doc_id").alias("doc"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("doc_id").alias("centre"), F.col("hashes").alias("hb"))
    hot = hot_keys(pairs.groupBy("centre").agg(F.count("*").alias("n")), ["centre"], "n", pairs.count())
    both = dealt_join(pairs.join(left, "doc"), right, ["centre"], hot, ["doc"])
    common = both.select("doc", "centre", (F.size("ha") + F.size("hb")).alias("total"), F.size(F.array_intersect("ha", "hb")).alias("common"))
    return common.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select(F.col("doc").alias("a"), F.col("centre").alias("b"))


def _rest(members: DataFrame, comps: DataFrame, sets: DataFrame, scratch: Scratch, o: MinHashOptions) -> DataFrame:
    """Links that the stars can't show: between members of a bucket that aren't its centre.

    A bucket is settled when its members besides the centre lie in one component. The buckets
    left over are gathered into groups; in a group everything outside the largest component is
    compared with every document of another component, tile by tile.
    """
    named = comps.withColumnRenamed("node", "doc").withColumnRenamed("component", "comp")
    tagged = scratch.keep(
        members.where("n > 2").select("key", "doc", "centre").join(named, "doc", "left")
        .select("key", "doc", "centre", F.coalesce("comp", "doc").alias("comp")),
        "tagged",
    )
    unsettled = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    # A large bucket's members are dealt by a salt beside its key.
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    salted = unsettled.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    open_rows = tagged.withColumn("salt", salt).join(salted, ["key", "salt"], "left_semi").select("doc", "centre").distinct()
    open_rows = scratch.keep(open_rows, "open")
    groups = connected_components(open_rows.select(F.col("doc").alias("a"), F.col("centre").alias("b")), scratch, "groups")
    there = (
        groups.select(F.col("node").alias("doc"), F.col("component").alias("grp")).join(named, "doc", "left")
        .select("doc", "grp", F.coalesce("comp", "doc").alias("comp"))
    )
    there = scratch.keep(there, "there")
    by_comp = there.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    total = by_comp.groupBy("grp").agg(F.sum("n").alias("docs"), F.max(F.struct("n", "comp")).alias("top"))
    total = total.select("grp", "docs", F.col("top.comp").alias("top"), (F.col("docs") - F.col("top.n")).alias("rest"))
    tiles = total.select(
        "grp", "top",
        F.ceil(F.col("docs") / o.tile).cast("int").alias("cols"),
        F.ceil(F.col("rest") / o.tile).cast("int").alias("bands"),
    ).where("bands > 0")
    hot = hot_keys(total.withColumnRenamed("docs", "n"), ["grp"], "n", there.count())
    placed = dealt_join(there, tiles, ["grp"], hot, ["doc"]).join(sets.select(F.col("doc_id").alias("doc"), "hashes"), "doc")
    spot = lambda n, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(n)).cast("int")
    right = placed.select(
        "grp", spot("cols", 1).alias("j"), F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("i"), "doc", "comp", "hashes"
    )
    left = placed.where("comp <> top").select(
        F.col("grp").alias("of"), spot("bands", 2).alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"),
        F.col("doc").alias("one"), F.col("comp").alias("own"), F.col("hashes").alias("set"),
    )
    found = left.groupBy("of", "row", "col").cogroup(right.groupBy("grp", "i", "j")).applyInPandas(_tile_links(o.percent), "a long, b long")
    return scratch.keep(found.distinct(), "more-links")
