"""Which streaming query a micro-batch belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame


def query_id(batch: DataFrame) -> str:
    """The id of the query that hands over ``batch``: lasting, as its checkpoint keeps it."""
    found = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise ValueError("not inside a micro-batch of a streaming query")
    return found
