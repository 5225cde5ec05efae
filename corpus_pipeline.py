"""A corpus pipeline: language, near duplicates, personal data, mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each result as Parquet to the shared folder and rereads it as the
next stage's documents.

Cases: null and empty texts, and texts without a letter, are rejected by the first stage; rows are told
apart by id and text, so different texts under one id, or without one, are documents of their own, and
of rows equal in both the first by its other columns stays from the second stage on; other columns are passed on by the first three stages and the mix; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.llm import crf_language, mixing, ngram_join, packing, pii
from rubrika.llm.common import one_of_equal, stored, table

KEYS = ("doc_id", "_text")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from those that name theirs. Where none
    does, all documents with a letter."""
    model = crf_language.fit_on(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = crf_language.predict(docs, model)
    return found.where(F.col("lang_pred") != crf_language.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, of equal ids the one
    with the smallest hash of its text."""
    texts = docs.withColumn("_text", F.xxhash64("text"))
    found = ngram_join.near_duplicates(texts, carry=("_text",))
    # Ids come before null, whose place among the rows is the hash alone.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text")
    kept = found.groupBy("group").agg(F.min(place).alias("first"))
    kept = stored(kept.select("first.doc_id", "first._text"), "kept")
    times = found.groupBy("doc_id", "_text").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeated = stored(times.select("doc_id", "_text"), "repeated")
    same = [texts[key].eqNullSafe(kept[key]) for key in KEYS]
    return one_of_equal(texts.join(kept, same, "left_semi"), KEYS, repeated).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal numbers, dates and addresses."""
    return pii.pseudonymize(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.take_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2,048 ids."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mix", mix),
    ("pack", pack),
]

# Learned labels, keyed permutations and tokenizers have no SQL form; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
    return docs
