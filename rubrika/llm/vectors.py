"""Usable vectors of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> Column:
    """True for a vector that is not null, not empty, not zero and has finite components only."""
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    some = F.exists(embedding, lambda x: x.cast("double") != 0.0)
    return F.coalesce(finite & some, F.lit(False))


def doubles(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn(embedding, F.col(embedding).cast("array<double>"))
