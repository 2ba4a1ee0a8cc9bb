import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from termsieve.llm.queries import queries, vocabulary_path

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(90001, None, "en", None, 0), (90002, "", "en", "s", 0), (90003, "12 !", None, "s", 4), (90004, docs.first().text + " mail a.b@c.org", "en", "s", 9), (90004, docs.first().text + " mail a.b@c.org", "en", "s", 9)],
        docs.schema,
    )
    docs = docs.unionByName(extra)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == columns, name
        ids = [r.doc_id for r in rows]
        if name == "language_id":
            assert not {90001, 90002, 90003} & set(ids) and len(ids) >= n - 5
        elif name == "minhash_dedup":
            assert len(ids) == len(set(ids)) < n - 4 and 90004 not in ids
        elif name == "pii":
            assert not any("@mail" in r.text for r in rows) and any("[EMAIL]" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows)
        else:
            assert len(ids) > len(set(ids)) and max(ids.count(i) for i in set(ids)) == 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == len(rows) and all(r.n_tokens == len(r.ids) > 0 for r in out.collect())


def test_last_stage_tells_the_decoded_text(spark):
    texts = ["Plain words.", "Über 12 – 語", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    lib = Tokenizer.from_file(vocabulary_path())
    want = {i: lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts)}
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_stages_keep_clashing_columns_and_long_texts(spark):
    names = ["score", "email", "_key", "_hash", "added", "REJECTED", "a.b", "copies"]
    long = "the house of the long road and the river " * 30_000 + "mail a.b@c.org now"
    rows = [(i, f"the house number {w} of the road and the river is not far from the {w} bridge", "en", f"s{i % 2}", 1) for i, w in enumerate(["red", "old", "new", "long", "wide", "grey"] * 3)]
    rows += [(100, long, "en", "s0", 1), (101, None, None, None, None), (102, "", "en", "s1", 0), (None, "the house without a name and the old river", "en", "s1", 1)]
    docs = spark.createDataFrame([(*r, *(f"{c}{i}" for c in names)) for i, r in enumerate(rows)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    own = {r.doc_id: tuple(r[c] for c in names) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        kept = out.collect()
        assert out.columns == docs.columns and all(tuple(r[c] for c in names) == own[r.doc_id] for r in kept), name
        docs = spark.createDataFrame(kept, docs.schema)
    assert any(r.doc_id == 100 and r.text.endswith("[EMAIL] now") for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(kept)


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF).count() > 200
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_queries_against_sql(spark):
    from termsieve.llm.oracles import oracle_sql

    db = connect(SF)
    for name, sql in oracle_sql().items():
        assert compare(spark, db, SF, queries()[name], sql) == ""
