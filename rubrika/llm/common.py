"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubrika.session import shared_folder, use_utc
from rubrika.sources import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """The rows written to the shared folder and read back: later steps start from files that
    every executor can open, so a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_path = path
    return found


def release(*frames: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once nothing that is still to run reads them, and has the
    driver collect its garbage: Spark deletes shuffle files of plans that are gone only then."""
    for frame in frames:
        paths = frame.stored_path
        for path in [paths] if isinstance(paths, str) else paths:
            files.delete(frame.sparkSession, path)
    collect_garbage(frames[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def one_of_equal(docs: DataFrame, keys: tuple[str, ...], repeated: DataFrame) -> DataFrame:
    """``docs`` with one row for each of the keys in ``repeated`` (a stored table of ``keys``): the first by all
    other columns. Rows with other keys stay where they are."""
    if repeated.isEmpty():
        return docs
    same = [docs[key].eqNullSafe(repeated[key]) for key in keys]
    alone = docs.join(repeated, same, "left_anti")
    rest = [name for name in docs.columns if name not in keys and name != "text"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest) if rest else Window.partitionBy(*keys).orderBy(*keys))
    first = docs.join(repeated, same, "left_semi").withColumn("_place", place).where("_place = 1").drop("_place")
    return alone.unionByName(first)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ids_of(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
