"""Probabilities, predicted class and ranked score list, as array expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrika.functions.labels import required_label_name
from rubrika.schemas import LABELS, SCORES

DECIMALS = 4


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, for use inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array, shifted by its maximum so that exp stays finite."""

    def divide(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
        return _bind(total, lambda t: F.transform(weights, lambda w: w / t))

    return _bind(
        F.array_max(logits).cast("double"),
        lambda top: _bind(F.transform(logits, lambda z: F.exp(z.cast("double") - top)), divide),
    )


def predicted_id(probabilities: Column) -> Column:
    """Index of the largest unrounded probability; the first one on ties."""
    return F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1


def confidence(probabilities: Column) -> Column:
    return F.round(F.array_max(probabilities), DECIMALS)


def ranked_scores(probabilities: Column, names: Sequence[str] = LABELS) -> Column:
    """Label and rounded score per class, best first; equal rounded scores keep class order."""
    keyed = F.transform(
        probabilities,
        lambda p, i: F.struct(
            F.negative(F.round(p, DECIMALS)).alias("order"),
            i.alias("id"),
            required_label_name(i, names).alias("label"),
            F.round(p, DECIMALS).alias("score"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")),
    )


def scores_to_json(scores: Column) -> Column:
    return F.to_json(scores)


def scores_from_json(text: Column) -> Column:
    return F.from_json(text, SCORES)
