import math

import pytest
from pyspark.sql import functions as F

from termsieve.llm.mixing import MixOptions, _key, key_range, mix, mixed, quality


def water(sizes, weights=(5, 2, 1), share=1.5, passes=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, over = sum(w[n] for n in open_), 0.0
        for n in list(open_):
            out[n] += left * w[n] / total
        for n in list(open_):
            if out[n] >= passes * sizes[n]:
                over += out[n] - passes * sizes[n]
                out[n] = passes * sizes[n]
                open_.discard(n)
        left = over
    return out


def rows():
    out = [(i, " ".join(["w"] * (1 + i * 7 % 23)), ("hot" if i % 3 else f"s{i % 5}") if i % 11 else None, "x") for i in range(900)]
    return [*out, (2000, None, "s1", "x"), (2001, "", "s1", "x"), (2002, " \n ", "é", "x"), (None, "a b", "s2", "x"), (3, "again w", "hot", "x"), (3, "again w", "hot", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string, size string")


def test_targets_and_budgets(docs):
    got = mix(docs).collect()
    assert len(got) == len(rows())
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 12, s
    assert all(r.source_size == sizes[r.source] for r in got)
    # A whole pass comes before a second one.
    for s in sizes:
        copies = {r.copies for r in got if r.source == s and r.size}
        assert len(copies) <= 2 and max(copies, default=0) - min(copies, default=0) <= 1


def test_reruns_agree_whatever_the_partitions(docs):
    key = lambda df: sorted(map(repr, mix(df).collect()))
    assert key(docs) == key(docs.repartition(7))


def test_documents_as_the_mix_takes_them(docs):
    want = {}
    for r in mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    out = mixed(docs)
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert out.columns == docs.columns
    assert {k: v for k, v in want.items() if v and k != 3} == {k: v for k, v in got.items() if k != 3}


def test_few_and_no_sources(spark, docs):
    assert mix(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.copies, r.taken, r.target) for r in mix(empty).collect()] == [(0, 0, 0.0)] * 2
    one = spark.createDataFrame([(i, "a b c", "a") for i in range(100)], "doc_id long, text string, source string")
    assert sum(r.taken for r in mix(one).collect()) == 450
    assert {r.copies for r in mix(one, MixOptions(share=2.0)).collect()} == {2}


def test_better_documents_come_first(spark):
    rows = [(i, "good text here now " * 5 if i % 2 else "4%;! now\n" * 8, "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, MixOptions(share=0.5)).collect()
    taken = lambda odd: sum(r.copies for r in got if r.doc_id % 2 == odd)
    assert taken(1) > 1.5 * taken(0)
    weights = spark.createDataFrame([(t,) for t in ("plain words", "zwölf Boxkämpfer, groß", "語語語語。語", "a\na\na\nb", "12:30-14", "", None)], "t string").select(quality(F.col("t"))).collect()
    assert [round(w[0], 2) for w in weights] == [1.0, 1.0, 1.0, 0.5, 0.1, 1.0, 1.0]


def test_taken_as_by_sorting_each_source(spark):
    """Efraimidis-Spirakis with plain lists, on the same keys."""
    texts = ["w w", "4%;! now\n" * 8, "good text here now " * 3, "語語語", "a\na\na b c d e"]
    rows = [(i, texts[i % 5], ("hot", "hot", "cold", None, "é")[i % 4 if i % 7 else 4]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    o = MixOptions()
    keys = {r.doc_id: r.k for r in docs.select("doc_id", _key(o, "doc_id", F.col("text")).alias("k")).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    target = water({s: sum(size[i] for i, _, x in rows if x == s) for s in {x for _, _, x in rows}})
    want = {}
    for s, t in target.items():
        own = sorted((keys[i], i) for i, _, x in rows if x == s)
        total = sum(size[i] for _, i in own)
        passes = min(math.floor(t / total + 1e-12), 2)
        ahead = 0
        for _, i in own:
            want[i] = passes + (passes < 2 and ahead + size[i] / 2 <= t - passes * total)
            ahead += size[i]
    assert {r.doc_id: r.copies for r in mix(docs, o).collect()} == want and len(set(want.values())) > 1


def test_no_range_of_keys_is_large_whatever_the_weights(spark):
    n = 1_000_000
    for text in ("4%;!", "plain words"):
        keyed = spark.range(n).select(_key(MixOptions(), "id", F.lit(text)).alias("key")).select(key_range(F.col("key"), F.lit(n)).alias("r"))
        assert keyed.groupBy("r").count().agg(F.max("count")).first()[0] <= 0.01 * n


def test_columns_under_the_operators_own_names_stay(spark):
    names = ["_size", "_key", "_source", "_whole", "_cut", "_copy", "size", "KEY", "range", "src"]
    docs = spark.createDataFrame([(i, "a b c", "s", *(f"{c}{i}" for c in names)) for i in range(20)], ["doc_id", "text", "source", *names])
    out = mixed(docs)
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
    assert out.count() == sum(r.copies for r in mix(docs).collect())
