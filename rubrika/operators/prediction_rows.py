"""Shaping and checking rows for the prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrika.functions.text import truncate
from rubrika.schemas import (
    DEFAULT_VERSION,
    MAX_LABEL_CHARS,
    MAX_VERSION_CHARS,
    PREDICTIONS,
)


def prepare(df: DataFrame, key: str | None = None, text: str = "input_text") -> DataFrame:
    """Rows in the log's shape: cut text, default version, ingest time.

    ``key`` names a source key; without one an id is made that is unique in the batch. A missing
    ``created_at`` column means now; a missing ``model_version`` column or value means the default.
    A ``reason`` column, which says why a row has no prediction, is passed on.
    """
    has = set(df.columns)
    version = F.col("model_version") if "model_version" in has else F.lit(None).cast("string")
    values = {
        "id": F.col(key) if key else F.monotonically_increasing_id(),
        "input_text": truncate(F.col(text)),
        "predicted_label": F.col("predicted_label"),
        "confidence": F.col("confidence"),
        "all_scores": F.col("all_scores") if "all_scores" in has else F.lit(None),
        "model_version": F.coalesce(version, F.lit(DEFAULT_VERSION)),
        "created_at": F.col("created_at") if "created_at" in has else F.current_timestamp(),
    }
    rest = ["reason"] if "reason" in has else []
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in PREDICTIONS], *rest)


def rejection_reason() -> Column:
    """The first rule a row breaks, or null."""

    def too_long(name: str, limit: int) -> Column:
        return F.when(F.char_length(name) > limit, F.lit(f"{name} is longer than {limit}"))

    required = ("id", "input_text", "predicted_label", "confidence", "created_at")
    in_range = (F.col("confidence") >= 0) & (F.col("confidence") <= 1)
    return F.coalesce(
        *[F.when(F.col(name).isNull(), F.lit(f"{name} is null")) for name in required],
        F.when(~in_range, F.lit("confidence is outside 0..1")),
        too_long("predicted_label", MAX_LABEL_CHARS),
        too_long("model_version", MAX_VERSION_CHARS),
    )


def validate(rows: DataFrame) -> DataFrame:
    """All rows, with ``reason`` and ``status`` (accepted or rejected)."""
    given = [F.col("reason")] if "reason" in rows.columns else []
    return rows.withColumn("reason", F.coalesce(*given, rejection_reason())).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise("rejected")
    )
