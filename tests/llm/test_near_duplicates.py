import random
import re
from collections import defaultdict

import numpy as np
import pytest

from termsieve.llm.minhash import MinHashOptions, band_keys, keep_one, near_duplicates, sketch
from termsieve.llm.shingles import mix, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, width, percent):
    """Every pair; union-find on doc_id."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            n = len(s & t)
            if s and t and 100 * n >= percent * (len(s) + len(t) - n) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for _ in range(25):
        texts.append([r.choice(words) for _ in range(r.choice([1, 2, 5, 20, 60, 200]))])
    # A hot group: one long text and many copies, each with a few words changed.
    base = [r.choice(words) for _ in range(120)]
    for k in range(140):
        t = list(base)
        for _ in range(k % 9):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(t)
    for t in list(texts[:25]):
        texts.append(t[:-1] if len(t) > 5 else t)
    for i, t in enumerate(texts):
        rows.append((i * 3 + 1, r.choice([" ", "\n", "\t "]).join(x.upper() if r.random() < 0.1 else x for x in t)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_same_components_as_comparing_all(spark, seed, width, percent):
    rows = corpus(seed)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), MinHashOptions(width=width, percent=percent, tile=16)).collect()
    want = components(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in out) and len(out) == len(rows)


def test_odd_rows(spark):
    long_text = " ".join(str(i) for i in range(50_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "A b", "x"), (5, "a B", "y"), (5, "a B", "y"), (None, "a b", "z"), (6, long_text, "x"), (7, long_text + " end", "x"), (8, "É b", "x"), (9, "é b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (6, 49996, 6, True), (7, 49997, 6, False), (8, 1, 8, True), (9, 1, 9, True)],
        key=repr,
    )
    kept = keep_one(df)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 8, 9, None], key=repr) and kept.columns == df.columns
    twice = spark.createDataFrame([(1, "p q"), (1, "p q"), (2, None), (2, None)], "doc_id long, text string")
    assert keep_one(twice).where("doc_id = 1").count() == 1
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    for n, share in ((40, 0.5), (400, 0.85), (8, 0.8)):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
            k = round(n * 2 * share / (1 + share))
            y = np.concatenate([x[:k], rng.integers(0, 1 << 63, n - k, dtype=np.int64).astype(np.uint64)])
            a, b = sketch(np.unique(mix(x)), 252), sketch(np.unique(mix(y)), 252)
            agree.append((a == b).mean())
        true = k / (2 * n - k)
        assert abs(np.mean(agree) - true) < 0.05, (n, true, np.mean(agree))
    assert len(set(band_keys(np.array([5], np.uint64), 42, 6))) == 42


def test_shingle_hashes_tell_sets_apart():
    import pyarrow as pa

    texts = ["a b c", "a bc", "ab c", "a b c d", "b c a", "", None, "a  b\tc", "A B C"] + ["x " * 200_000]
    sets = [tuple(s) for s in shingle_sets(pa.array(texts), 3)]
    assert sets[0] == sets[7] == sets[8] and len({sets[i] for i in (0, 1, 2, 3, 4)}) == 5 and sets[5] == sets[6] == () and len(sets[9]) == 1
    groups = defaultdict(set)
    r = random.Random(1)
    for _ in range(3000):
        t = " ".join(r.choice("abcd") for _ in range(r.randint(1, 6)))
        groups[tuple(next(shingle_sets(pa.array([t]), 3)))].add(shingles(t, 3))
    assert all(len(g) == 1 for g in groups.values())
