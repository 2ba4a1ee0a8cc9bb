"""Joins in which a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS, HOT_KEYS, SALTS = 5_000, 10_000, 32


def hot_keys(counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The keys with more than HOT_ROWS of total rows, and more than total / HOT_KEYS: HOT_KEYS rows at most."""
    return counted.where(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)).select(*keys).withColumn("hot", F.lit(True))


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each key; a hot key's rows are dealt by a hash of `by` over SALTS tasks.

    hot comes from hot_keys, so its size is bounded and it is broadcast.
    """
    small = F.broadcast(hot)
    left = many.join(small, keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(small, keys, "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, [*keys, "salt"], how).drop("salt")
