"""The prediction log: Parquet rows by source, batch and attempt, and a numbered list.

A batch is named by its source (a table, a stream) and a number. Each write of a batch is an attempt
in a folder of its own; only when it is complete does it take the next number of the list
(``rubrika.sources.publication``), and readers take the highest number of each batch. So a repeated
batch, or a replayed micro-batch, leaves no doubles, a failed attempt changes nothing, no source
reaches another one's batches, and no clock decides. A source may run anew under another ``run`` name;
readers see the rows of the run with the highest number alone. Accepted and rejected rows are written
together, apart by partition. ``unique`` batches also reject ids that their source holds already
(``rubrika.sources.unique_ids``). Closed days can be written anew, by day
(``rubrika.sources.compaction``); readers then take those rows from there.
"""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubrika.functions.text import utc_date
from rubrika.operators import analytics
from rubrika.operators.partial import partial_states
from rubrika.operators.prediction_rows import validate
from rubrika.schemas import COMPACTED, KEYS, LOG_COUNTS, LOG_TABLE, PIECES, RECENT_LIMIT
from rubrika.sources import files, publication, unique_ids
from rubrika.sources.publication import ATTEMPT, COMPACTION

PARTITIONS = ("status", "prediction_date")
TABLE_SOURCE = "table"
FIRST_RUN = "first"
TRIES = 5
# A table of attempts, or of attempts by day, up to this many rows (some 150 bytes each) may be
# broadcast.
BROADCAST_ENTRIES = 500_000


def create_log(spark: SparkSession, path: str) -> None:
    """Makes an empty log unless there is one."""
    for part in ("rows", "counts", "states", "compacted", "pieces", "keys", "list", "preparing"):
        files.make_folder(spark, f"{path}/{part}")


def batch_rows(rows: DataFrame, rebalance: bool = False) -> DataFrame:
    """Prepared rows, checked and dated, as ``append`` writes them."""
    checked = validate(rows).withColumn("prediction_date", utc_date(F.col("created_at")))
    return _gathered(checked, rebalance)


def _gathered(rows: DataFrame, rebalance: bool) -> DataFrame:
    return rows.hint("rebalance", *[F.col(name) for name in PARTITIONS]) if rebalance else rows


def append(
    rows: DataFrame,
    path: str,
    batch_id: int,
    rebalance: bool = False,
    source: str = TABLE_SOURCE,
    run: str = FIRST_RUN,
    unique: bool = False,
    states: bool = False,
) -> int:
    """Checks prepared rows, writes them as one attempt of a batch, publishes it, and returns its
    number.

    Rows of one day, or ordered by day, are written where they are. For a batch over many days
    ``rebalance`` first gathers the rows of each day, which saves one small file per task and day;
    adaptive execution splits a day that holds most of the rows. Rows per status and day are counted
    from file footers and written beside the rows.

    With ``unique`` an id that occurs again in the batch, or that another batch of the source's run
    holds, is rejected. Should another attempt of that run be published meanwhile, the check is made
    again with it.

    With ``states`` the attempt's part of the statistics is written beside its rows
    (``rubrika.sources.states``): one more scan, of three columns.
    """
    for name in (source, run):
        if not re.fullmatch(r"[\w.-]+", name, re.ASCII):
            raise ValueError(f"letters, digits, '_', '.' and '-' name a source or run, not {name!r}")
    spark = rows.sparkSession
    create_log(spark, path)
    batch = {"kind": ATTEMPT, "source": source, "run": run, "batch_id": batch_id, "keyed": unique}
    if not unique:
        attempt = _write(batch_rows(rows, rebalance), path, batch, states)
        return publication.publish(spark, path, batch | {"attempt": attempt})

    # Written once before the check, so that what is checked is what is kept.
    waiting = f"{path}/preparing/{uuid4().hex}"
    batch_rows(rows).write.parquet(waiting)
    checked = spark.read.parquet(waiting)
    try:
        for _ in range(TRIES):
            since = publication.newest(spark, path)
            older = _ids_of_other_batches(spark, path, batch)
            told = unique_ids.reject_repeated(checked, older)
            attempt = _write(_gathered(told, rebalance), path, batch, states)
            unique_ids.write_keys(_attempt_rows(spark, path, batch, attempt), f"{path}/keys", batch, attempt)
            try:
                return publication.publish(
                    spark,
                    path,
                    batch | {"attempt": attempt},
                    since,
                    lambda other: (other["kind"], other["source"], other["run"]) == (ATTEMPT, source, run),
                )
            except publication.Outdated:
                continue
        raise publication.Outdated(f"other batches of {source} were published {TRIES} times meanwhile")
    finally:
        files.delete(spark, waiting)


def folder(path: str, part: str, batch: dict, attempt: str) -> str:
    """Where an attempt's rows or counts lie."""
    named = {key: batch[key] for key in ("source", "run", "batch_id")} | {"attempt": attempt}
    return "/".join([path, part, *[f"{key}={value}" for key, value in named.items()]])


def _attempt_rows(spark: SparkSession, path: str, batch: dict, attempt: str) -> DataFrame:
    reader = spark.read.schema(LOG_TABLE).option("basePath", f"{path}/rows")
    return reader.parquet(folder(path, "rows", batch, attempt))


def _write(checked: DataFrame, path: str, batch: dict, states: bool = False) -> str:
    """Writes the rows of an attempt, their numbers and states; returns its name."""
    spark, attempt = checked.sparkSession, uuid4().hex
    checked.write.partitionBy(*PARTITIONS).parquet(folder(path, "rows", batch, attempt))
    counts = _attempt_rows(spark, path, batch, attempt).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.parquet(folder(path, "counts", batch, attempt))
    if states:
        accepted = _attempt_rows(spark, path, batch, attempt).where("status = 'accepted'")
        partial_states(accepted).write.parquet(folder(path, "states", batch, attempt))
    return attempt


def _ids_of_other_batches(spark: SparkSession, path: str, batch: dict) -> DataFrame:
    """Accepted ids of the other batches of a run: from the key table, and for batches that were
    written without it from their rows."""
    source, run = batch["source"], batch["run"]
    mine = (F.col("source") == source) & (F.col("run") == run)
    others = newest_attempts(spark, path).where(mine & (F.col("batch_id") != batch["batch_id"]))
    keys = spark.read.schema(KEYS).parquet(f"{path}/keys").where(mine)
    keyed = keys.join(_few(others.where("keyed").select("attempt")), "attempt", "left_semi")
    rest = others.where("NOT keyed").select("attempt")
    plain = _placed(spark, path, "accepted").where(mine).join(_few(rest), "attempt", "left_semi")
    return keyed.select("id", "bucket").union(plain.select("id", unique_ids.bucket(F.col("id"))))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ENTRIES else table


def newest_attempts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The list's attempt of the highest number for each batch of each run."""
    listed = publication.published(spark, path, upto).where(F.col("kind") == ATTEMPT)
    place = F.row_number().over(Window.partitionBy("source", "run", "batch_id").orderBy(F.desc("number")))
    return listed.withColumn("place", place).where("place = 1").drop("place")


def current_attempts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The attempts that readers see: those of the run with the highest number of each source."""
    newest_run = F.max_by("run", "number").over(Window.partitionBy("source"))
    listed = newest_attempts(spark, path, upto).withColumn("newest_run", newest_run)
    return listed.where("run = newest_run").drop("newest_run")


def runs(spark: SparkSession, path: str, source: str) -> set[str]:
    """Names of the published runs of a source, newest or not."""
    create_log(spark, path)
    listed = publication.published(spark, path).where(F.col("source") == source)
    return {row["run"] for row in listed.select("run").distinct().collect()}


def counts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Rows by status and day of the attempts that readers see."""
    current = _few(current_attempts(spark, path, upto).select("attempt"))
    return spark.read.schema(LOG_COUNTS).parquet(f"{path}/counts").join(current, "attempt", "left_semi")


def compacted_pieces(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """What the newest compaction of each status and day holds of which attempt, or none."""
    listed = publication.published(spark, path, upto).where(F.col("kind") == COMPACTION)
    if listed.isEmpty():
        return None
    numbers = listed.select(F.col("attempt").alias("compaction"), "number")
    pieces = spark.read.schema(PIECES).parquet(f"{path}/pieces").join(_few(numbers), "compaction")
    best = F.max("number").over(Window.partitionBy(*PARTITIONS))
    return pieces.withColumn("best", best).where("number = best").drop("best")


def _placed(spark: SparkSession, path: str, status: str | None, upto: int | None = None) -> DataFrame:
    """Rows of all complete attempts, each from where it lies: closed days as far as a
    compaction holds them, all others from the attempts' folders."""
    wanted = F.lit(True) if status is None else F.col("status") == status
    raw = spark.read.schema(LOG_TABLE).parquet(f"{path}/rows").where(wanted)
    pieces = compacted_pieces(spark, path, upto)
    if pieces is None:
        return raw
    held = _few(pieces.where(wanted).select(*PARTITIONS, "attempt"))
    days = _few(pieces.where(wanted).select(*PARTITIONS, "compaction").distinct())
    null_safe = [F.col(f"raw.{c}").eqNullSafe(F.col(f"held.{c}")) for c in (*PARTITIONS, "attempt")]
    raw = raw.alias("raw").join(held.alias("held"), null_safe, "left_anti")
    rows = spark.read.schema(COMPACTED).parquet(f"{path}/compacted").where(wanted)
    null_safe = [F.col(f"rows.{c}").eqNullSafe(F.col(f"days.{c}")) for c in (*PARTITIONS, "compaction")]
    rows = rows.alias("rows").join(days.alias("days"), null_safe, "left_semi")
    return raw.unionByName(rows.drop("compaction"))


def current_rows(spark: SparkSession, path: str, upto: int | None = None, status: str | None = None) -> DataFrame:
    """The rows that readers see, accepted and rejected, with all columns."""
    current = _few(current_attempts(spark, path, upto).select("attempt"))
    rows = _placed(spark, path, status, upto).join(current, "attempt", "left_semi")
    return rows.select(*LOG_TABLE.names)


def _read(spark: SparkSession, path: str, status: str, upto: int | None) -> DataFrame:
    return current_rows(spark, path, upto, status).drop("status", "run", "attempt")


def read_log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Accepted predictions; ``source``, ``batch_id`` and ``prediction_date`` prune folders. ``upto``
    reads the log as it was at a number of the list."""
    return _read(spark, path, "accepted", upto).drop("reason")


def read_rejected(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Rows set aside, with the reason."""
    return _read(spark, path, "rejected", upto)


def batch_outcome(spark: SparkSession, path: str) -> DataFrame:
    """Rows per source, batch and status, from the counts alone."""
    return counts(spark, path).groupBy("source", "batch_id", "status").agg(F.sum("n").alias("n"))


def read_recent(spark: SparkSession, path: str, limit: int = RECENT_LIMIT) -> DataFrame:
    """The latest predictions of a stored log, reading only the newest days that hold them.

    Rows per day come from the counts, so no file of an older day is opened. Each of the ``limit``
    newest days holds at least one row, so they always suffice; the driver sees that many dates.
    """
    days = (
        counts(spark, path)
        .where("status = 'accepted' AND n > 0")
        .groupBy("prediction_date")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("prediction_date"))
        .limit(limit)
    ).collect()
    found, oldest = 0, None
    for day in days:
        oldest, found = day["prediction_date"], found + day["n"]
        if found >= limit:
            break
    log = read_log(spark, path)
    newest = log if oldest is None else log.where(F.col("prediction_date") >= F.lit(oldest))
    return analytics.recent_predictions(newest, limit)


def register_views(log: DataFrame) -> None:
    """Temp views ``predictions``, ``category_stats`` and ``daily_prediction_volume``."""
    log.createOrReplaceTempView("predictions")
    analytics.category_stats(log).createOrReplaceTempView("category_stats")
    analytics.daily_volume(log).createOrReplaceTempView("daily_prediction_volume")
