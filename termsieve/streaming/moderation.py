"""Moderating streams: a check is one narrow step for each text, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from termsieve.config import ScanOptions
from termsieve.plans.moderator import Moderator


def read_texts(spark: SparkSession, path: str, schema: str, kind: str = "parquet", **options) -> DataFrame:
    """A stream over the files that arrive in a folder."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def moderate_stream(moderator: Moderator, texts: DataFrame, options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
    """texts with the columns of Moderator.check."""
    return moderator.check(texts, options, text_col)


def write_verdicts(verdicts: DataFrame, path: str, checkpoint: str, partition_by: str = "decision", trigger: dict | None = None) -> StreamingQuery:
    """Append verdicts to Parquet, by decision; files and offsets commit together, so each text counts once."""
    return (
        verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy(partition_by).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )
