"""Running statistics over a stream of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rubrika.functions.text import utc_date
from rubrika.operators.analytics import category_stats
from rubrika.streaming.identity import query_id


def running_category_stats(predictions: DataFrame) -> DataFrame:
    """Category statistics of all predictions so far; state is one row per label."""
    return category_stats(predictions)


def daily_volume_by_window(predictions: DataFrame, lateness: str | None = None) -> DataFrame:
    """Predictions and distinct labels per UTC day as one-day windows.

    With ``lateness`` a day is final once the watermark passes its end, its state is dropped, and
    later rows for it are left out and counted by the query. The set of labels kept per day is as
    small as the set of categories.
    """
    if lateness:
        predictions = predictions.withWatermark("created_at", lateness)
    return (
        predictions.groupBy(F.window("created_at", "1 day").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.size(F.collect_set("predicted_label")).cast("long").alias("unique_categories"),
        )
        .select(
            utc_date(F.col("day.start")).alias("prediction_date"), "total", "unique_categories"
        )
    )


def write_running(
    result: DataFrame, path: str, checkpoint: str, mode: str, **trigger
) -> StreamingQuery:
    """Starts a query that keeps ``result`` as a table.

    In complete mode every micro-batch writes the whole result, a row per label or day, as one file
    into one of two slots of the query, in turn: the slot before it stays whole until the next
    write, and no more files than two gather. In append mode the file sink adds final rows, each
    once; there a path belongs to one checkpoint.
    """
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    if mode == "append":
        return writer.format("parquet").option("path", path).start()

    def write(batch: DataFrame, epoch: int) -> None:
        stamped = batch.withColumns(
            {"written_at": F.current_timestamp(), "epoch": F.lit(epoch).cast("long")}
        )
        folder = f"{path}/query={query_id(batch)}/slot={epoch % 2}"
        stamped.coalesce(1).write.mode("overwrite").parquet(folder)

    return writer.foreachBatch(write).start()


def read_running(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The latest result of a query in complete mode: of the query that wrote last, its newest
    micro-batch. A query with new offsets counts from nothing, so its result takes over."""
    whole = StructType([*schema.fields]).add("written_at", "timestamp").add("epoch", "long")
    whole = whole.add("query", "string").add("slot", "integer")
    rows = spark.read.schema(whole).parquet(path)
    query = rows.agg(F.max_by("query", "written_at")).first()[0]
    mine = rows.where(F.col("query") == F.lit(query))
    newest = mine.agg(F.max("epoch")).first()[0]
    return mine.where(F.col("epoch") == F.lit(newest)).select(*schema.names)
