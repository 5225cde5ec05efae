"""Labelled corpora: reading, splitting, taking a head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from rubrika.schemas import ARTICLES

# Fixed value: a head of n training rows goes with n // 5 held-out rows.
HEAD_RATIO = 5


def read_corpus(
    spark: SparkSession,
    path: str,
    source: str = "parquet",
    schema: StructType | str = ARTICLES,
    **options,
) -> DataFrame:
    """A corpus in any format Spark reads, by a given schema, so no pass infers one."""
    return spark.read.format(source).schema(schema).options(**options).load(path)


MALFORMED = "record does not fit the schema"


def read_checked(
    spark: SparkSession,
    path: str,
    source: str,
    schema: StructType | str = ARTICLES,
    required: tuple[str, ...] = ("doc_id", "text"),
    raw: str = "_raw",
    **options,
) -> DataFrame:
    """A corpus in json or csv with what is wrong with each row: ``reason``, null for a good row, and the
    record as it was read in ``raw``, null unless it does not fit the schema.

    Records that cannot be parsed, or have a value of another type, or (csv) another number of fields,
    are kept with what could be read of them; so are rows that lack a ``required`` column. Nothing
    fails and nothing is lost: ``accepted`` and ``rejected`` part the rows by the reason. One scan, no
    shuffle; readers that select columns still parse whole records, as the reason depends on them.
    """
    if source not in ("json", "csv"):
        raise ValueError(f"{source} files have a schema of their own; only json and csv are checked")
    shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if raw in shape.names or "reason" in shape.names:
        raise ValueError(f"the schema must not name {raw} or reason")
    whole = StructType([*shape.fields]).add(raw, "string")
    rows = (
        spark.read.format(source)
        .schema(whole)
        .options(**{"mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw, "enforceSchema": "true"} | options)
        .load(path)
    )
    reason = F.when(F.col(raw).isNotNull(), F.lit(MALFORMED))
    for name in required:
        reason = reason.when(F.col(name).isNull(), F.lit(f"{name} is missing"))
    return rows.withColumn("reason", reason)


def accepted(checked: DataFrame, raw: str = "_raw") -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason", raw)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull())


def with_split(df: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """Adds ``split``: one key in ``folds`` is ``test``, the others ``train``.

    For a corpus without splits of its own: one that has a ``split`` column keeps it. Whole numbers
    count as they are, keys of any other type by their hash. A null key fails the query.
    """
    if "split" in df.columns:
        return df
    whole = isinstance(df.schema[key].dataType, IntegralType)
    number = F.col(key) if whole else F.xxhash64(key)
    split = F.when(F.pmod(number, F.lit(folds)) == 0, F.lit("test")).otherwise("train")
    missing = F.raise_error(F.lit(f"{key} is null")).cast("string")
    return df.withColumn("split", F.when(F.col(key).isNull(), missing).otherwise(split))


def train_and_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        df.where(F.col("split") == "train").drop("split"),
        df.where(F.col("split") == "test").drop("split"),
    )


def head(
    train: DataFrame, test: DataFrame, size: int | None, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """The first ``size`` training rows and a fifth as many held-out rows, in key order.

    No size, or 0, keeps everything.
    """
    if not size:
        return train, test
    return train.orderBy(key).limit(size), test.orderBy(key).limit(size // HEAD_RATIO)
