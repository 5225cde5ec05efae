"""How the given tables play the parts of corpus, prediction log and dense features."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.functions.labels import label_name
from rubrika.operators.encoding import with_tokens
from rubrika.schemas import UNKNOWN_LABEL
from rubrika.session import use_utc
from rubrika.sources.corpus import with_split

LANGUAGES = ("en", "fr", "de", "es")
EVENT_LABELS = {
    "view": "World",
    "click": "Sports",
    "purchase": "Business",
    "signup": "Science/Technology",
}
# Class means of the embeddings are close together; this spreads their probabilities.
LOGIT_SCALE = 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def language_class(lang: Column) -> Column:
    """The language as class id from 0."""
    return F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), lang).cast("int") - 1


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language as class, and a train / test split."""
    docs = table(spark, sf_dir, "documents")
    return with_split(docs.select("doc_id", "text", language_class(F.col("lang")).alias("label")))


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(corpus(spark, sf_dir)).drop("text")


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def rest(text: Column) -> Column:
    return F.substr(text, F.char_length(first_line(text)) + 2)


def event_label(event_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EVENT_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(names, event_type), F.lit(UNKNOWN_LABEL))


def predictions(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as rows of the prediction log."""
    value = F.col("value")
    confidence = F.round((value / (value + F.lit(100.0))).cast("decimal(18,10)"), 4)
    label = event_label(F.col("event_type"))
    scores = F.array(
        F.struct(label.alias("label"), confidence.cast("double").alias("score"))
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("props").alias("input_text"),
        label.alias("predicted_label"),
        confidence.cast("double").alias("confidence"),
        scores.alias("all_scores"),
        F.lit("v1.0").alias("model_version"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "events"))


def unchecked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of events as they might arrive: shares above 1, no label for errors."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("props").alias("input_text"),
        F.when(F.col("event_type") != "error", event_label(F.col("event_type"))).alias(
            "predicted_label"
        ),
        (F.col("value") / 100.0).alias("confidence"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def article_time(doc_id: Column) -> Column:
    """A time for each document, spread by the hour over the thirty days of the events."""
    return F.timestamp_seconds(F.pmod(doc_id * 3600, F.lit(30 * 86400)) + 1704067200)


def unchecked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of documents: whole text, a free-form label, a version for some."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        text.alias("input_text"),
        first_line(text).alias("predicted_label"),
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("confidence"),
        F.nullif(F.split_part(text, F.lit("\n"), F.lit(2)), F.lit("")).alias("model_version"),
        article_time(F.col("doc_id")).alias("created_at"),
    )


def article_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of documents for the history panel."""
    share = (F.col("n_chars") / (F.col("n_chars") + 1000.0)).cast("decimal(18,10)")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("input_text"),
        label_name(language_class(F.col("lang"))).alias("predicted_label"),
        F.round(share, 4).cast("double").alias("confidence"),
        article_time(F.col("doc_id")).alias("created_at"),
    )


def class_means(embeddings: DataFrame, max_classes: int = 1000) -> list[list[float]]:
    """Mean vector per class, in class order: the weights of a linear model.

    The driver gets one vector per class, after partial sums in the tasks.
    """
    rows = (
        embeddings.groupBy("label")
        .agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("mean"))
        .limit(max_classes + 1)
        .collect()
    )
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    return [row["mean"] for row in sorted(rows, key=lambda row: row["label"])]
