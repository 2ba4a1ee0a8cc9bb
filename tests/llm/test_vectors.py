import tracemalloc

import numpy as np

from termsieve.llm.ann import AnnOptions, buckets, cells_of, extended, nearest, visited
from termsieve.llm.embed_dedup import EmbeddingOptions, embedding_duplicates, linked, possible_pairs, quantise

SCHEMA = "vec_id long, embedding array<float>, label int, score string"
NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, 1), (9002, [0.0, 0.0], 1), (9003, [NAN, 1.0], 1), (9004, [1.0, INF], 1), (9005, [1.0, None], 1), (9006, [], 1), (None, [1.0, 0.0], 1), (9007, [1.0, 0.0], None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x") for i, v, label in rows], SCHEMA)


def test_links_and_components_as_comparing_all(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base[0] + 0.12 * rng.normal(size=(150, 8)), base[1:30] + 0.05 * rng.normal(size=(29, 8)), base[:5]]).astype(np.float32)
    ids = rng.permutation(len(x)) * 2
    labels = rng.integers(0, 2, len(x))
    rows = [(int(i), v.tolist(), int(lab)) for i, v, lab in zip(ids, x, labels, strict=True)]
    out = {r.vec_id: r for r in embedding_duplicates(frame(spark, rows + rows[:3] + ODD), EmbeddingOptions(tile=32)).collect()}
    y = x.astype(np.float64)
    n = np.linalg.norm(y, axis=1)
    link = ((y @ y.T) / n[:, None] / n >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    comp = ids.copy()
    for _ in ids:
        comp = np.array([min([comp[k], *comp[link[k]]]) for k in range(len(ids))])
    assert 100 < link.sum()
    for k, i in enumerate(ids):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (link[k].sum(), comp[k], comp[k] == i)
    for i, _, _ in ODD:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert embedding_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_copies_are_one_vector_with_a_count(spark, monkeypatch):
    from termsieve.llm import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, a.tolist(), 1) for i in range(10, 400)] + [(i, (a + 0.01 * b).tolist(), 1) for i in range(400, 420)] + [(5, (3 * a).tolist(), 1), (6, b.tolist(), 1), (7, a.tolist(), 2), (10, a.tolist(), 1)]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates(frame(spark, rows)).collect()}
    assert out == {5: (410, 5, True), 6: (0, 6, True), 7: (0, 7, True), **{i: (410, 5, False) for i in range(10, 420)}}


def test_a_tile_pair_of_alike_vectors_stays_small():
    rng = np.random.default_rng(13)
    n, o = 4096, EmbeddingOptions()
    x = rng.normal(size=64) + 0.001 * rng.normal(size=(2 * n, 64))
    ids, count = np.arange(2 * n) * 3, np.full(2 * n, 2)
    tracemalloc.start()
    links, root = linked(ids, count, x, np.arange(0, 2 * n, 2), np.arange(1, 2 * n, 2), False, o)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == 2 * n).all() and (root == 0).all() and peak < 300 << 20


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(4)
    for d in (2, 16, 64):
        x = rng.normal(size=(200, d)) * 10 ** rng.uniform(-20, 20, (200, 1))
        x[100:] = x[:100] * (1 + 0.02 * rng.normal(size=(100, d)))
        q = quantise(x)
        cos = q[0] @ q[0].T
        for t in (0.9, 0.98, 0.9999):
            maybe = np.zeros_like(cos, dtype=bool)
            maybe[possible_pairs(q, q, t)] = True
            assert maybe[cos >= t].all()


def test_nearest_are_found(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:900] = x[700] + 0.05 * rng.normal(size=(200, 24))
    x = x.astype(np.float32)
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD + [(7, x[7].tolist(), 0)])
    out = nearest(df, df.where("vec_id % 20 = 0")).collect()
    y = x.astype(np.float64)
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append(r)
        assert r.vec_id != r.query_id and abs(r.score - y[r.query_id] @ y[r.vec_id]) < 1e-9
    recall = []
    for q in range(0, 1500, 20):
        s = y @ y[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20])
        rows = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        recall.append(len(best & {r.vec_id for r in rows}) / 20)
    assert np.mean(recall) >= 0.9


def test_few_rows_ties_and_none(spark):
    df = frame(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.5, 0.5, 0.5], 0), *ODD[:6]])
    assert [(r.rank, r.vec_id, r.score) for r in nearest(df, df.where("vec_id = 0"), AnnOptions(share=1.0)).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 1.0)]
    assert nearest(df, df.where("vec_id = 3")).count() == 0 and nearest(df.limit(0), df.limit(0)).count() == 0


def test_no_query_comes_short_with_the_default_options(spark):
    """20 rows for each query, or all others where there are fewer, also for a rare dimension and mixed lengths."""
    rng = np.random.default_rng(8)
    sizes = {63: 8, 64: 25, 65: 21}
    rows = [(d * 1000 + i, rng.normal(size=d).tolist(), 0) for d, n in sizes.items() for i in range(n)]
    rows += [(1000 + i, (rng.normal(size=62) * (50 if i == 0 else 1)).tolist(), 0) for i in range(500)]
    df = frame(spark, rows)
    got = {}
    for r in nearest(df, df).collect():
        assert r.query_id != r.vec_id
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for d, n in (sizes | {1: 500}).items():
        for i in range(n):
            want = min(20, n - 1)
            assert sorted(k for k, _ in got[d * 1000 + i]) == list(range(1, want + 1)) and len({v for _, v in got[d * 1000 + i]}) == want
    few = frame(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [-1.0, 0.0], 0)])
    assert [(r.rank, r.vec_id, r.score) for r in nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, -1.0)]


def test_buckets_hold_bounded_numbers_of_rows():
    rng = np.random.default_rng(9)
    rows = rng.integers(1, 900, 300)
    first, splits = buckets(np.arange(300), rows, 256)
    held: dict[int, float] = {}
    for n, a, k in zip(rows, first, splits, strict=True):
        for b in range(a, a + k):
            held[b] = held.get(b, 0) + n / k
    assert max(held.values()) <= 256 and sorted(held) == list(range(len(held)))
    # Cells that share a bucket are small, a split cell shares none.
    assert all((first == a).sum() == 1 for a, k in zip(first, splits, strict=True) if k > 1)


def test_cells_and_visits():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 12))
    o = AnnOptions()
    ext = extended(x, np.linalg.norm(x, axis=1).max())
    for t in range(o.tables):
        cells, n = np.unique(cells_of(ext, o, t), return_counts=True)
        q = np.c_[x[:50] / np.linalg.norm(x[:50], axis=1)[:, None], np.zeros(50)]
        see = visited(q, cells, n, o, t)
        assert (see @ n > o.k).all() and 0 < see.mean() < 1
        assert see.sum() <= visited(q, cells, n, AnnOptions(share=0.99), t).sum()


def test_the_same_rows_in_small_buckets_and_blocks(spark):
    """A hot cell of copies, cells dealt over many buckets, queries in chunks: nothing is lost, cells decide alone."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 8))
    x[200:500] = x[200]
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    rows = lambda o: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest(df, df.where("vec_id % 7 = 0"), o).collect())
    few = rows(AnnOptions(bucket_rows=(16, 16), query_rows=8, block=512))
    assert few == rows(AnnOptions()) and len(few) == 100 * 20
