"""Keeping blank texts away from a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrika.functions.text import is_blank

BLANK_REASON = "text is blank"


def flag_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``reason``: why a row cannot be scored, or null."""
    return df.withColumn("reason", F.when(is_blank(F.col(text)), F.lit(BLANK_REASON)))


def split_blank(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and the blank ones with their reason."""
    flagged = flag_blank(df, text)
    return (
        flagged.where(F.col("reason").isNull()).drop("reason"),
        flagged.where(F.col("reason").isNotNull()),
    )


def require_text(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows; the query fails at the first blank text."""
    checked = F.when(is_blank(F.col(text)), F.raise_error(F.lit(BLANK_REASON)))
    return df.withColumn(text, checked.otherwise(F.col(text)))
