"""Statistics of the log from partial states that are written with each attempt.

A state is what the rows of one attempt, day and label add to the statistics: how many they are, the
exact sum and number of their confidences, and the latest time. States merge by sums and maxima, so
the views of a log need no row of it. An attempt's states lie beside its rows and leave with them when
it is replaced; attempts that were written without states are added up from their rows.

Cases: rejected rows have no state; null labels are a state of their own, null confidences count as
rows but not in the mean; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.schemas import STATES
from rubrika.operators.partial import STATE_KEYS, STATE_VALUES, partial_states
from rubrika.sources import prediction_log

def read_states(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The states of the attempts that readers see, or saw at the number ``upto``."""
    prediction_log.create_log(spark, path)
    current = prediction_log.current_attempts(spark, path, upto).select("attempt")
    kept = spark.read.schema(STATES).parquet(f"{path}/states")
    kept = kept.join(current, "attempt", "left_semi").select("attempt", *STATE_KEYS, *STATE_VALUES)
    holding = prediction_log.counts(spark, path, upto).where("status = 'accepted' AND n > 0").select("attempt").distinct()
    without = holding.join(kept.select("attempt").distinct(), "attempt", "left_anti")
    if without.isEmpty():
        return kept
    rows = prediction_log.current_rows(spark, path, upto, "accepted").join(without, "attempt", "left_semi")
    return kept.unionByName(partial_states(rows, "attempt"))


def category_stats(states: DataFrame) -> DataFrame:
    """As ``analytics.category_stats`` of the rows."""
    total = F.sum("sum_confidence").cast("decimal(30,15)")
    mean = F.round(total / F.sum("n_confidence"), 4).cast("double")
    return (
        states.groupBy("predicted_label")
        .agg(
            F.sum("n").alias("total_predictions"),
            F.when(F.sum("n_confidence") > 0, mean).alias("avg_confidence"),
            F.max("last_seen").alias("last_seen"),
        )
        .orderBy(F.desc("total_predictions"), "predicted_label")
    )


def daily_volume(states: DataFrame) -> DataFrame:
    """As ``analytics.daily_volume`` of the rows."""
    return (
        states.groupBy("prediction_date")
        .agg(F.sum("n").alias("total"), F.count_distinct("predicted_label").alias("unique_categories"))
        .orderBy(F.desc("prediction_date"))
    )
