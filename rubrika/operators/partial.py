"""Mergeable parts of the log's statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_KEYS = ("prediction_date", "predicted_label")
STATE_VALUES = ("n", "sum_confidence", "n_confidence", "last_seen")


def partial_states(accepted: DataFrame, *also: str) -> DataFrame:
    """``n, sum_confidence, n_confidence, last_seen`` by day and label, and by the columns ``also``."""
    return accepted.groupBy(*also, *STATE_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("confidence").cast("decimal(20,15)")).cast("decimal(30,15)").alias("sum_confidence"),
        F.count("confidence").alias("n_confidence"),
        F.max("created_at").alias("last_seen"),
    )
