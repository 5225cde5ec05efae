"""What the physical plans must look like at scale."""

import re

import pytest
from pyspark.sql import functions as F

from rubrika.functions.text import clean_text
from rubrika.operators import analytics, encoding, scoring, selection, training
from rubrika.operators.token_model import fit_token_model
from rubrika.plans import bindings
from rubrika.plans.catalog import QUERIES
from rubrika.session import shared_folder
from rubrika.sources import prediction_log
from rubrika.sources.corpus import head, read_corpus, train_and_test, with_split

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_statistics_read_three_columns_and_combine_first(spark):
    text = plan(analytics.category_stats(bindings.event_log(spark, SF_DIR)))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>", text)
    assert "partial_count" in text and "partial_max" in text


def test_latest_predictions_are_a_top_k(spark):
    text = plan(analytics.recent_predictions(bindings.event_log(spark, SF_DIR)))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_scoring_has_no_shuffle_and_splits_once(spark):
    docs = bindings.table(spark, SF_DIR, "documents").select("doc_id", "text", "lang")
    labelled = docs.withColumn("label", bindings.language_class(F.col("lang")))
    model = training.fit_naive_bayes(encoding.with_tokens(labelled))
    text = plan(scoring.score(docs.drop("lang"), model))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["token_counts", "scores_ranked"])
def test_texts_are_split_once(spark, name):
    assert plan(QUERIES[name](spark, SF_DIR)).count("regexp_extract_all") == 1


def test_the_vocabulary_is_picked_where_the_counts_lie(spark):
    """No order and no limit over the counts, and no text: a filter alone, before ids are given."""
    text = plan(QUERIES["vocab_build"](spark, SF_DIR))
    assert "regexp_extract_all" not in text and "TakeOrdered" not in text and "Limit" not in text
    counts = spark.range(50_000).selectExpr("CAST(id AS string) AS token", "id % 7 AS n")
    assert "Exchange" not in plan(selection.largest(counts, 100))


def test_cleaning_stays_in_generated_code(spark):
    pages = bindings.table(spark, SF_DIR, "pages")
    text = pages.select(clean_text(F.col("html")))
    assert re.search(r"\*\(1\) Project", text._jdf.queryExecution().executedPlan().toString())
    assert "ReadSchema: struct<html:string>" in plan(text)


def test_date_filter_prunes_the_log(spark):
    path = shared_folder(spark, "log")
    prediction_log.append(bindings.event_log(spark, SF_DIR), path, 1, True)
    log = prediction_log.read_log(spark, path)
    text = plan(log.where("prediction_date >= '2024-01-25'").select("predicted_label"))
    assert re.search(r"PartitionFilters: .*status.*accepted.*prediction_date", text)
    assert "ReadSchema: struct<predicted_label:string>" in text
    recent = plan(prediction_log.read_recent(spark, path, 10))
    assert re.search(r"PartitionFilters: .*prediction_date#\d+ >= ", recent)


def test_a_batch_is_shuffled_only_on_request(spark):
    rows = bindings.event_log(spark, SF_DIR)
    assert "Exchange" not in plan(prediction_log.batch_rows(rows))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(prediction_log.batch_rows(rows, rebalance=True))


def test_encoding_joins_by_broadcast_and_moves_no_text(spark):
    docs = encoding.with_tokens(bindings.table(spark, SF_DIR, "documents").select("doc_id", "text"))
    words = spark.createDataFrame([("the", 4)], "token string, token_id int")
    text = plan(encoding.encode(docs, words))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text
    keys = re.findall(r"Arguments: hashpartitioning\((\w+)#", text)
    assert keys == ["doc_id"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = plan(encoding.encode(docs, words, broadcast_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"hashpartitioning\(token#\d+, salt#\d+", salted)) == 2


def test_no_cross_joins(spark):
    for name in ("encode_fixed_length", "vector_score", "category_stats", "nb_model"):
        text = plan(QUERIES[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


@pytest.mark.parametrize("name", ["clean_documents", "clean_pages", "corpus_split", "combine_title_body"])
def test_projections_move_nothing(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF_DIR))


def test_token_model_moves_numbers_and_joins_by_checked_size(spark):
    docs = bindings.table(spark, SF_DIR, "documents").select("doc_id", "text", "lang")
    labelled = docs.withColumn("label", bindings.language_class(F.col("lang")))
    model = fit_token_model(encoding.with_tokens(labelled), shared_folder(spark, "token-model"))
    tokens = encoding.with_tokens(docs.drop("lang"))
    text = plan(model.transform(tokens).select("doc_id", "probabilities"))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text
    assert text.count("partial_sum") and text.count("regexp_extract_all") == 1
    salted = plan(model.transform(tokens, broadcast_rows=0))
    assert "NestedLoop" not in salted and re.search(r"salt#\d+", salted)


@pytest.mark.parametrize("source", ["json", "csv", "orc", "parquet"])
def test_corpus_formats(spark, tmp_path, source):
    rows = [(1, 'a "quoted", text', 0), (2, "é", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    options = {"header": "true", "escape": '"'} if source == "csv" else {}
    df.write.options(**options).format(source).save(str(tmp_path / "c"))
    found = read_corpus(spark, str(tmp_path / "c"), source, **options)
    assert sorted(map(tuple, found.collect())) == rows


def test_head_and_split(spark):
    train, test = train_and_test(with_split(spark.range(100).withColumnRenamed("id", "doc_id")))
    assert (train.count(), test.count()) == (80, 20)
    some, few = head(train, test, 12)
    assert [r.doc_id for r in some.collect()] == [1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13, 14]
    assert [r.doc_id for r in few.collect()] == [0, 5]
    assert head(train, test, 0) == (train, test) == head(train, test, None)
    assert [x.count() for x in head(train, test, 10**6)] == [80, 20]


def test_given_splits_and_keys_of_other_types(spark):
    given = spark.createDataFrame([("a", "test"), ("b", "train")], "doc_id string, split string")
    assert with_split(given) is given
    named = spark.range(1000).selectExpr("concat('key', id) AS doc_id")
    parts = {r["split"]: r["count"] for r in with_split(named).groupBy("split").count().collect()}
    assert set(parts) == {"train", "test"} and 140 < parts["test"] < 260
    with pytest.raises(Exception, match="doc_id is null"):
        with_split(spark.createDataFrame([(1,), (None,)], "doc_id long")).collect()


def test_shared_folder_is_fresh_and_configured(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and (base is None or one.startswith(base.rstrip("/")))
