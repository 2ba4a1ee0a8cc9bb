"""Names for columns that come and go inside an operator."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, label: str) -> str:
    """label, with underscores put before it until df has no column of that name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{label}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names under others, and what brings a result back to df's columns."""
    taken = {n.lower() for n in names}
    moved: dict[str, str] = {}
    out = df
    for c in df.columns:
        if c.lower() in taken:
            moved[c] = fresh(out, f"own_{c}")
            out = out.withColumnRenamed(c, moved[c])
    return out, lambda result: result.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns])
