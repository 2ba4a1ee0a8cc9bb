"""Documents to token ids: each stage calls one operator on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termsieve.functions.columns import aside
from termsieve.llm.bpe import encode_texts
from termsieve.llm.langid import fit, predict
from termsieve.llm.minhash import MinHashOptions, keep_one
from termsieve.llm.mixing import mixed
from termsieve.llm.pii import KINDS, find_pii, redact
from termsieve.llm.queries import vocabulary_path
from termsieve.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; null texts and texts without letters go.

    The model is fitted on a bounded sample of all of docs with a known lang, those included that op10
    keeps for testing: nothing is measured here. Repeated rows and rows with null ids are told one by one.
    """
    inside, back = aside(docs, ("lang_pred", "score", "rejected"))
    return back(predict(inside, fit(docs)).where(~F.col("rejected")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Texts without words have no duplicates and stay; of rows that repeat a doc_id and its text one stays;
    rows without a doc_id stay.
    """
    return keep_one(docs, MinHashOptions())


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows. Null texts stay null, every row stays."""
    inside, back = aside(docs, (*KINDS, "added"))
    return back(redact(find_pii(inside)).withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are never taken, a null source is one of its own."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, their digest and that of the text decoded from them, for every row; a null text has no ids."""
    return encode_texts(docs, vocabulary_path(), decode=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("pii", pii),
    ("mix_sources", mix_sources),
    ("bpe", bpe),
]

# The stages' models and exact components have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again, and goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    last = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if last:
                scratch.drop(last)
            last = name
    return docs
