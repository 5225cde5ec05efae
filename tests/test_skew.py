"""One key that holds much of the data: results stay whole."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rubrika.operators import analytics, encoding
from rubrika.schemas import PREDICTIONS
from rubrika.sources import prediction_log
from rubrika.streaming import stats

N = 3000


@pytest.fixture(scope="module")
def docs(spark):
    """A third of all tokens is one word; one document is as long as a third of the others."""
    word = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), F.col("id") % 97))
    many = spark.range(N).select((F.col("id") % 300).alias("doc_id"), word.alias("word"), "id")
    grouped = many.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "word"))).alias("x"))
    texts = grouped.select("doc_id", F.concat_ws(" ", F.col("x.word")).alias("text"))
    long = spark.createDataFrame([(1000, " ".join(["hot", "cold"] * 500))], "doc_id long, text string")
    return encoding.with_tokens(texts.union(long)).cache()


def test_hot_token(docs):
    hand = Counter()
    for row in docs.collect():
        hand.update(row.text.split())
    assert hand["hot"] > N / 3
    counted = {r.token: r.n for r in encoding.token_counts(docs).collect()}
    assert counted == dict(hand)


def test_hot_token_in_both_joins(docs, spark):
    built = encoding.build_vocabulary(encoding.token_counts(docs), 60)
    vocabulary = spark.createDataFrame(built.collect(), built.schema)
    broadcast = encoding.encode(docs, vocabulary).collect()
    salted = encoding.encode(docs, vocabulary, broadcast_rows=0).collect()
    assert len(broadcast) == 301 and sorted(broadcast) == sorted(salted)


def test_hot_day_and_label(spark, tmp_path):
    days = [datetime(2024, 1, 1 + (i % 29 if i % 2 else 0)) for i in range(N)]
    rows = [
        (i, "t", "World" if i % 3 else "Sports", 0.5, None, "v1.0", day)
        for i, day in enumerate(days)
    ]
    path = str(tmp_path / "log")
    df = spark.createDataFrame(rows, PREDICTIONS).repartition(8)
    prediction_log.append(df, path, 1, rebalance=True)
    log = prediction_log.read_log(spark, path)
    assert log.count() == N
    assert sorted(analytics.daily_volume(log).collect()) == sorted(analytics.daily_volume(df).collect())
    assert sorted(stats.daily_volume_by_window(log).collect()) == sorted(
        analytics.daily_volume(df).collect()
    )
    assert analytics.category_stats(log).collect() == analytics.category_stats(df).collect()
