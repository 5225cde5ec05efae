"""Questions to the prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrika.functions.text import percent_text, preview, utc_date
from rubrika.schemas import HISTORY_LIMIT, RECENT_LIMIT


def average_confidence() -> Column:
    """Mean to four decimals, summed as decimals so that the order of rows has no part in it."""
    exact = F.avg(F.col("confidence").cast("decimal(20,15)"))
    return F.round(exact, 4).cast("double")


def category_stats(log: DataFrame) -> DataFrame:
    """Predictions, mean confidence and latest time per label, the largest label first."""
    return (
        log.groupBy("predicted_label")
        .agg(
            F.count(F.lit(1)).alias("total_predictions"),
            average_confidence().alias("avg_confidence"),
            F.max("created_at").alias("last_seen"),
        )
        .orderBy(F.desc("total_predictions"), "predicted_label")
    )


def daily_volume(log: DataFrame) -> DataFrame:
    """Predictions and distinct labels per UTC day, the latest day first."""
    return (
        log.groupBy(utc_date(F.col("created_at")).alias("prediction_date"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_distinct("predicted_label").alias("unique_categories"),
        )
        .orderBy(F.desc("prediction_date"))
    )


def recent_predictions(log: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """The latest predictions: a top-k per task and a merge, over five columns."""
    keys = [name for name in ("created_at", "batch_id", "id") if name in log.columns]
    return (
        log.orderBy(*[F.desc(name) for name in keys])
        .limit(limit)
        .select("id", "input_text", "predicted_label", "confidence", "created_at")
    )


def history_lines(rows: DataFrame) -> DataFrame:
    """One heading and one text preview per prediction, as the history panel shows them."""
    heading = F.concat(
        F.lit("["),
        F.date_format("created_at", "yyyy-MM-dd HH:mm"),
        F.lit("] "),
        F.col("predicted_label"),
        F.lit(" ("),
        percent_text(F.col("confidence")),
        F.lit("%)"),
    )
    return rows.select("id", heading.alias("heading"), preview(F.col("input_text")).alias("preview"))


def history(log: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """History lines of the latest predictions."""
    return history_lines(recent_predictions(log, limit))
