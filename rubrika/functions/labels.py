"""Class ids and category names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrika.schemas import LABELS, UNKNOWN_LABEL


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(name) for name in names])


def label_name(label_id: Column, names: Sequence[str] = LABELS) -> Column:
    """Name of a class id, or the unknown name for any other id."""
    return F.coalesce(F.get(_names(names), label_id.cast("int")), F.lit(UNKNOWN_LABEL))


def required_label_name(label_id: Column, names: Sequence[str] = LABELS) -> Column:
    """Name of a class id; fails the query when the class has none."""
    missing = F.concat(F.lit("no category name for class "), label_id.cast("string"))
    return F.coalesce(F.get(_names(names), label_id.cast("int")), F.raise_error(missing))


def label_id(name: Column, names: Sequence[str] = LABELS) -> Column:
    """Class id of a name; null when it is no category."""
    position = F.array_position(_names(names), name).cast("int")
    return F.when(position > 0, position - 1)


def zero_based(label: Column) -> Column:
    """Class ids of a corpus that counts from one."""
    return label - 1
