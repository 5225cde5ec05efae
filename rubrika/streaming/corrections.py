"""Daily volume of a stream with late rows kept: days close, and rows that come later correct them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rubrika.functions.text import utc_date
from rubrika.sources import files
from rubrika.streaming.identity import query_id

# What is kept of a day: ``closed`` once the mark has passed its end, ``late`` the rows that came after.
DAYS = "prediction_date date, total long, labels array<string>, late long, closed boolean, newest timestamp"
NAMES = [field.split()[0] for field in DAYS.split(", ")]
EMITTED = "prediction_date date, kind string, total long, unique_categories long, late long"
FINAL, CORRECTION = "final", "correction"


def _folder(path: str, query: str, epoch: int) -> str:
    return f"{path}/days/query={query}/epoch={epoch}"


def _kept(spark: SparkSession, path: str, query: str, epoch: int) -> DataFrame:
    """The days as they were after micro-batch ``epoch``; none before the first."""
    if epoch < 0:
        return spark.createDataFrame([], DAYS)
    return spark.read.schema(DAYS).parquet(_folder(path, query, epoch))


def _advanced(kept: DataFrame, came: DataFrame, lateness: str) -> DataFrame:
    """The days after a micro-batch, with what changed; ``came`` is the batch by day."""
    back = F.expr(f"INTERVAL {lateness}")
    # One time each: the newest seen before this micro-batch and after it.
    seen = kept.agg(F.max("newest") - back).first()[0]
    now = kept.select("newest").union(came.select("came_newest")).agg(F.max("newest") - back).first()[0]
    both = kept.join(came, kept["prediction_date"].eqNullSafe(came["came_date"]), "full")
    none = F.array().cast("array<string>")
    added = F.coalesce("added", F.lit(0))
    day = F.coalesce("prediction_date", "came_date")
    day_end = F.date_add(day, 1).cast("timestamp")
    closed = F.coalesce("closed", F.lit(False))

    def passed(mark) -> Column:
        return F.coalesce(day_end <= F.lit(mark).cast("timestamp"), F.lit(False))

    # A day that no row had come for when the mark passed its end is closed all the same.
    was_closed = closed | passed(seen)
    return both.select(
        day.alias("prediction_date"),
        (F.coalesce("total", F.lit(0)) + added).alias("total"),
        F.array_union(F.coalesce("labels", none), F.coalesce("came_labels", none)).alias("labels"),
        (F.coalesce("late", F.lit(0)) + F.when(was_closed, added).otherwise(F.lit(0))).alias("late"),
        (was_closed | passed(now)).alias("closed"),
        F.greatest("newest", "came_newest").alias("newest"),
        closed.alias("closed_before"),
        added.alias("added"),
    )


def corrected_daily_volume(
    predictions: DataFrame, lateness: str, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Starts a query that keeps the volume of every UTC day and drops no row.

    A day closes when the newest time seen, less ``lateness`` (as in "1 hour"), reaches its end. It is
    then emitted once as ``final``; rows that come later are added, and the day is emitted again, whole,
    as a ``correction``. Each micro-batch is added up by day in its tasks, so a day that holds most rows
    costs a row per task. What is kept is a row per day, closed days too: a micro-batch that is run
    again starts from the days before it and writes the same.

    Cases: rows without time count for the day null, which never closes; null labels are counted in the
    total only, as in the view of the log; a micro-batch without rows changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, query = batch.sparkSession, query_id(batch)
        staged = f"{path}/came/query={query}/epoch={epoch}"
        by_day = batch.groupBy(utc_date(F.col("created_at")).alias("came_date")).agg(
            F.count(F.lit(1)).alias("added"),
            F.collect_set("predicted_label").alias("came_labels"),
            F.max("created_at").alias("came_newest"),
        )
        by_day.write.mode("overwrite").parquet(staged)
        came = spark.read.schema(by_day.schema).parquet(staged)
        changed = _advanced(_kept(spark, path, query, epoch - 1), came, lateness)
        changed.select(*NAMES).coalesce(1).write.mode("overwrite").parquet(_folder(path, query, epoch))
        kind = F.when(F.col("closed") & ~F.col("closed_before"), FINAL).when(
            F.col("closed") & (F.col("added") > 0), CORRECTION
        )
        emitted = changed.select(
            "prediction_date",
            kind.alias("kind"),
            "total",
            F.size("labels").cast("long").alias("unique_categories"),
            "late",
        ).where("kind IS NOT NULL")
        emitted.coalesce(1).write.mode("overwrite").parquet(f"{path}/emitted/query={query}/epoch={epoch}")
        files.delete(spark, staged)
        if epoch > 1:  # no run starts from it any more
            files.delete(spark, _folder(path, query, epoch - 2))

    writer = predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_emitted(spark: SparkSession, path: str, query: str) -> DataFrame:
    """All that a query emitted, with the ``epoch`` of each row."""
    return spark.read.schema(f"{EMITTED}, epoch long").parquet(f"{path}/emitted/query={query}")


def read_corrected(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``prediction_date, total, unique_categories, late, closed``: every day as it is now."""
    rows = spark.read.schema(f"{DAYS}, epoch long").parquet(f"{path}/days/query={query}")
    newest = rows.agg(F.max("epoch")).first()[0]
    days = rows.where(F.col("epoch") == F.lit(newest))
    return days.select(
        "prediction_date", "total", F.size("labels").cast("long").alias("unique_categories"), "late", "closed"
    )
