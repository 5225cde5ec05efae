"""Scoring whole tables: label, class id, confidence and ranked scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrika.functions import scores
from rubrika.functions.labels import label_name
from rubrika.operators.encoding import with_tokens
from rubrika.operators.epochs import EpochModel
from rubrika.operators.guard import flag_blank, require_text, split_blank
from rubrika.operators.token_model import TokenModel
from rubrika.schemas import LABELS

PREDICTION_COLUMNS = ("predicted_id", "predicted_label", "confidence", "all_scores")
BATCH_ROWS = 256


def with_predictions(
    df: DataFrame,
    probabilities: str = "probabilities",
    names: Sequence[str] = LABELS,
    ranked: bool = True,
) -> DataFrame:
    """Adds the prediction columns from an array of class probabilities; null gives nulls.

    ``ranked=False`` leaves out the score list, which needs a name for every class.
    """
    p = F.col(probabilities)
    name = F.when(p.isNotNull(), label_name(F.col("predicted_id"), names))
    out = df.withColumn("predicted_id", scores.predicted_id(p)).withColumns(
        {"predicted_label": name, "confidence": scores.confidence(p)}
    )
    if ranked:
        out = out.withColumn("all_scores", scores.ranked_scores(p, names))
    return out


def score(
    df: DataFrame,
    model: PipelineModel | TokenModel | EpochModel,
    text: str = "text",
    clean: bool = True,
    on_blank: str = "drop",
    names: Sequence[str] = LABELS,
    keep_probabilities: bool = False,
) -> DataFrame:
    """Scores the texts of ``df``, batch or stream, in one pass, without a shuffle for a
    pipeline in the JVM; a ``TokenModel`` joins, and its sums travel by row.

    ``on_blank`` says what becomes of blank texts: ``drop`` leaves their rows out, ``fail`` fails
    the query, and ``keep`` passes them on without a prediction and with a ``reason``, so that the
    log sets them aside. ``clean=False`` scores the raw text.
    """
    extra = ["probabilities"] if keep_probabilities else []
    own = isinstance(model, (TokenModel, EpochModel))
    share = F.col("probabilities") if own else vector_to_array("probability")
    if on_blank == "keep":
        rows, extra = flag_blank(df, text), [*extra, "reason"]
        share = F.when(F.col("reason").isNull(), share)
    elif on_blank == "fail":
        rows = require_text(df, text)
    elif on_blank == "drop":
        rows = split_blank(df, text)[0]
    else:
        raise ValueError(f"on_blank is drop, fail or keep, not {on_blank}")
    scored = model.transform(with_tokens(rows, text, clean)).withColumn("probabilities", share)
    scored = with_predictions(scored, names=names)
    return scored.select(*df.columns, *PREDICTION_COLUMNS, *extra)


def batch_predict(
    spark: SparkSession, model: PipelineModel | TokenModel | EpochModel, texts: Sequence[str], **options
) -> DataFrame:
    """Scores texts the caller holds, numbered by ``position``; any blank one fails the call."""
    df = spark.createDataFrame(list(enumerate(texts)), "position long, text string")
    return score(df, model, on_blank="fail", **options)


def predict(spark: SparkSession, model: PipelineModel | TokenModel | EpochModel, text: str, **options) -> dict:
    """Scores one text to a dict of the prediction columns."""
    row = batch_predict(spark, model, [text], **options).first()
    return {name: row.asDict(recursive=True)[name] for name in PREDICTION_COLUMNS}


def linear_logits(features: Column, weights: Sequence[Sequence[float]], scale: float = 1.0) -> Column:
    """One dot product per class as array expressions."""

    def dot(row: Sequence[float]) -> Column:
        products = F.zip_with(
            features, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x.cast("double") * w
        )
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) * F.lit(scale)

    return F.array(*[dot(row) for row in weights])


def linear_model(weights: Sequence[Sequence[float]], scale: float = 1.0) -> Callable:
    """A model maker for ``model_udf``: softmax of one dot product per class."""
    matrix = np.asarray(weights, dtype=np.float64)

    def load():
        def run(batch: np.ndarray) -> np.ndarray:
            z = batch.astype(np.float64) @ matrix.T * scale
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return run

    return load


def bag_of_ids_model(weights: np.ndarray, prior: Sequence[float]) -> Callable:
    """A model maker for ``model_udf`` on ``input_ids`` and ``attention_mask``.

    ``weights`` has a row per token id and a column per class; the logits are ``prior`` plus the
    rows of all unmasked ids.
    """
    table, start = np.asarray(weights, dtype=np.float64), np.asarray(prior, dtype=np.float64)

    def load():
        def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            used = table[ids.astype(np.int64)] * mask[..., np.newaxis]
            z = start + used.sum(axis=1)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return run

    return load


def model_udf(load: Callable, width: int, columns: int = 1, batch_rows: int = BATCH_ROWS) -> Callable:
    """Column function from arrays of ``width`` numbers to class probabilities.

    ``load`` runs once per Python worker and returns the batch function; rows arrive as Arrow
    batches. This is the way in for models that do not run in the JVM.
    """
    return predict_batch_udf(
        load,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_rows,
        input_tensor_shapes=[[width]] * columns,
    )
