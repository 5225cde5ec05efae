"""Accuracy and log loss of scored, labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the usual floor under a probability before its logarithm.
EPSILON = 1e-15


def accuracy(predicted: str = "predicted_id", label: str = "label") -> Column:
    return F.avg((F.col(predicted) == F.col(label)).cast("double"))


def log_loss(probabilities: str = "probabilities", label: str = "label") -> Column:
    true_share = F.get(F.col(probabilities), F.col(label).cast("int"))
    return F.avg(-F.log(F.greatest(true_share, F.lit(EPSILON))))


def evaluate(scored: DataFrame, *by: str) -> DataFrame:
    """Row count, accuracy and log loss, over all rows or per group."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        accuracy().alias("accuracy"),
        log_loss().alias("log_loss"),
    )
