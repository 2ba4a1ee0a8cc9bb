import random

from pyspark.sql import functions as F

from termsieve.functions import text as T
from termsieve.functions.arrays import cut, parts, running
from termsieve.functions.columns import aside, fresh


def merged(ranges):
    out = []
    for a, e in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [tuple(x) for x in out]


def test_ranges_against_plain_lists(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        starts = [r.randint(-5, 300) for _ in range(r.randint(0, 200))]
        rows.append((i, "é😀a" * 90, [(a, a + r.randint(0, 6)) for a in starts]))
    df = spark.createDataFrame(rows, "i int, t string, rs array<struct<start:int,end:int>>")
    for x in df.select("*", T.merge_ranges(F.col("rs")).alias("m"), T.mask_ranges(F.col("t"), F.col("rs")).alias("k")).collect():
        assert [tuple(v) for v in x.m] == merged([tuple(v) for v in x.rs])
        want = list(x.t)
        for a, e in x.rs:
            for k in range(max(a, 0), min(e, len(want))):
                want[k] = "*"
        assert x.k == "".join(want)
    assert spark.range(1).select(T.merge_ranges(F.lit(None).cast(T.RANGES))).first()[0] is None


def test_many_ranges(spark):
    n = 60_000
    ranges = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 2).alias("end")))
    row = spark.range(1).select(F.size(T.merge_ranges(ranges)), T.mask_ranges(F.repeat(F.lit("abc"), n), ranges)).first()
    assert row[0] == n and row[1] == "**c" * n


def test_cutting_and_running(spark):
    text = "😀é" + "x" * 1500 + "ß"
    places = [(0, 2), (1, 1503), (511, 513), (512, 1024), (1502, 1503), (5, 5), (1503, 1503)]
    got = spark.range(1).select(*[cut(parts(F.lit(text)), F.lit(a), F.lit(b)) for a, b in places]).first()
    assert list(got) == [text[a:b] for a, b in places]
    values = [3, 1, 4, 1, 5] * 40
    assert spark.range(1).select(running(F.lit(values), F.greatest)).first()[0] == [max([0, *values[:i]]) for i in range(200)]


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id", "id as _Key", "id as __key")
    assert fresh(df, "key") == "___key" and fresh(df, "other") == "_other"


def test_columns_put_aside(spark):
    df = spark.range(1).selectExpr("id", "1 as Score", "2 as `a.b`", "3 as _own_score")
    inside, back = aside(df, ["score", "more"])
    assert inside.columns == ["id", "__own_Score", "a.b", "_own_score"]
    out = back(inside.withColumn("score", F.lit(9)))
    assert out.columns == df.columns and tuple(out.first()) == (0, 1, 2, 3)
