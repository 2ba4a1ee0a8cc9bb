import pytest

from termsieve.llm import joins
from termsieve.llm.minhash import keep_one, near_duplicates
from termsieve.llm.scratch import Scratch, shared_root

from .test_near_duplicates import components, corpus


def test_hot_keys_are_dealt_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    many = spark.range(2000).selectExpr("id as v", "case when id % 3 = 0 then 0 else id % 40 end as k")
    one = spark.range(30).selectExpr("id as k", "id * 10 as w")
    hot = joins.hot_keys(many.groupBy("k").count(), ["k"], "count", 2000)
    assert [r.k for r in hot.collect()] == [0]
    plain = sorted(map(tuple, many.join(one, "k").select("k", "v", "w").collect()))
    assert sorted(map(tuple, joins.dealt_join(many, one, ["k"], hot, ["v"]).select("k", "v", "w").collect())) == plain
    assert joins.dealt_join(many, one, ["k"], hot, ["v"], "left").count() == 2000
    # No more hot keys than the bound, however many keys there are.
    monkeypatch.setattr(joins, "HOT_KEYS", 10)
    assert joins.hot_keys(many.groupBy("k").count(), ["k"], "count", 2000).count() <= 10


def test_near_duplicates_with_every_bucket_hot(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    rows = corpus(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows, 5, 80)
    names = ["_id", "_hash", "_n", "hot", "salt", "key"]
    df = spark.createDataFrame([(*r, *(f"{c}{i}" for c in names)) for i, r in enumerate(rows)], ["doc_id", "text", *names])
    kept = keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_scratch_folder(spark):
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_root(Cluster())
    s = Scratch(spark, "test")
    for name in ("a", "b-0", "b-1"):
        s.keep(spark.range(3), name)
    s.keep_only("b-")
    assert s.names == {"b-0", "b-1"} and spark.read.parquet(f"{s.path}/b-1").count() == 3
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(f"{s.path}/a")
