"""Closed days of a log written anew by day, and what they replace removed.

``compact`` takes the days before a date that attempts hold outside the newest compaction, writes all
rows that readers see of them, a few files per status and day however many batches there were, counts
them against the log's own counts, and publishes them in one step. Until then, or if it fails, readers see
what they saw before; afterwards they see the same rows. A batch that is
repeated later replaces its rows here too, as each row keeps the name of its attempt and readers take
those of current attempts alone. Two compactions at a time cannot both be published.

``remove_replaced`` deletes what no reader needs that reads the log as of a given number or later.
"""

from __future__ import annotations

import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.schemas import COMPACTED, PIECES
from rubrika.sources import files, prediction_log, publication
from rubrika.sources.prediction_log import PARTITIONS
from rubrika.sources.publication import ATTEMPT, COMPACTION, REMOVAL


def _open_pieces(spark: SparkSession, path: str, before: datetime.date, upto: int) -> DataFrame:
    """Statuses and days before a date of which current attempts hold rows that are not compacted."""
    counts = prediction_log.counts(spark, path, upto).where(F.col("prediction_date") < F.lit(before))
    pieces = prediction_log.compacted_pieces(spark, path, upto)
    if pieces is not None:
        counts = counts.join(pieces.select(*PARTITIONS, "attempt"), [*PARTITIONS, "attempt"], "left_anti")
    return counts.select(*PARTITIONS).distinct()


def compact(spark: SparkSession, path: str, before: datetime.date) -> int | None:
    """Writes closed days anew and returns the number under which they were published, or None if
    there was nothing to do. Raises ``Outdated`` if another compaction was published meanwhile."""
    since = publication.newest(spark, path)
    days = _open_pieces(spark, path, before, since).collect()  # a row per status and day
    if not days:
        return None
    name = uuid4().hex
    folder = f"{path}/compacted/compaction={name}"
    dates = sorted({day["prediction_date"] for day in days})
    chosen = spark.createDataFrame([tuple(d) for d in days], "status string, prediction_date date")
    rows = prediction_log.current_rows(spark, path, since)
    rows = rows.where(F.col("prediction_date").between(dates[0], dates[-1]))
    rows = rows.join(F.broadcast(chosen), list(PARTITIONS), "left_semi").hint("rebalance", *map(F.col, PARTITIONS))
    rows.write.partitionBy(*PARTITIONS).parquet(folder)

    written = spark.read.schema(COMPACTED).option("basePath", f"{path}/compacted").parquet(folder)
    pieces = written.groupBy(*PARTITIONS, "attempt").agg(F.count(F.lit(1)).alias("n"))
    pieces.coalesce(1).write.parquet(f"{path}/pieces/compaction={name}")
    _compare(spark, path, name, chosen, since)
    number = publication.publish(
        spark, path, {"kind": COMPACTION, "attempt": name}, since, lambda other: other["kind"] == COMPACTION
    )
    publication.write_snapshot(spark, path, number)
    return number


def _compare(spark: SparkSession, path: str, name: str, chosen: DataFrame, upto: int) -> None:
    """Raises unless the compaction holds what the log's counts say of its days."""
    held = spark.read.schema(PIECES).parquet(f"{path}/pieces").where(F.col("compaction") == name)
    want = prediction_log.counts(spark, path, upto).join(F.broadcast(chosen), list(PARTITIONS), "left_semi")
    keys = [*PARTITIONS, "attempt"]
    both = want.groupBy(*keys).agg(F.sum("n").alias("want")).join(held.select(*keys, "n"), keys, "full")
    wrong = both.where("want IS DISTINCT FROM n").first()
    if wrong:
        raise ValueError(f"a compaction does not hold the rows of the log: {wrong.asDict()}")


def remove_replaced(spark: SparkSession, path: str, reached: int) -> int:
    """Deletes what readers that stand at the number ``reached`` or later do not need: attempts
    replaced by then, days that a compaction holds, and older compactions; then thins the list.
    Returns how many folders went. Readers that stand before ``reached`` may fail. One that is cut
    short can be run again."""
    listed = publication.published(spark, path, reached)
    newest = prediction_log.newest_attempts(spark, path, reached)
    replaced = listed.where(F.col("kind") == ATTEMPT).join(newest.select("attempt"), "attempt", "left_anti")
    gone, folders = [], []
    for row in replaced.toLocalIterator():
        gone.append(row["attempt"])
        folders += [prediction_log.folder(path, part, row.asDict(), row["attempt"]) for part in ("rows", "counts", "states")]
    pieces = prediction_log.compacted_pieces(spark, path, reached)
    if pieces is not None:
        for row in newest.join(pieces.select(*PARTITIONS, "attempt"), "attempt").toLocalIterator():
            where = prediction_log.folder(path, "rows", row.asDict(), row["attempt"])
            folders.append(f"{where}/status={row['status']}/prediction_date={row['prediction_date']}")
        older = listed.where(F.col("kind") == COMPACTION)
        older = older.join(pieces.select(F.col("compaction").alias("attempt")), "attempt", "left_anti")
        for row in older.toLocalIterator():
            gone.append(row["attempt"])
            folders += [f"{path}/{part}/compaction={row['attempt']}" for part in ("compacted", "pieces")]
    removed = [name for name in folders if files.exists(spark, name)]
    for name in removed:
        files.delete(spark, name)
    number = publication.publish(spark, path, {"kind": REMOVAL})
    names = spark.createDataFrame([(name,) for name in gone], "attempt string")
    publication.write_snapshot(spark, path, number, names)
    publication.forget(spark, path, number)
    return len(removed)
