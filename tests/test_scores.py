import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rubrika.functions import labels, scores
from rubrika.operators.scoring import with_predictions
from rubrika.schemas import LABELS


def predictions(spark, logits, **options):
    df = spark.createDataFrame([(i, z) for i, z in enumerate(logits)], "i int, z array<double>")
    df = df.withColumn("probabilities", scores.softmax(F.col("z")))
    return with_predictions(df, **options).orderBy("i").collect()


def test_mean_logits_of_the_unit_test(spark):
    row = predictions(spark, [[0.1, 0.2, 2.5, 0.3]])[0]
    assert (row.predicted_id, row.predicted_label, row.confidence) == (2, "Business", 0.7682)
    assert [(s.label, s.score) for s in row.all_scores] == [
        ("Business", 0.7682),
        ("Science/Technology", 0.0851),
        ("Sports", 0.0770),
        ("World", 0.0697),
    ]


def test_ties_keep_class_order(spark):
    row = predictions(spark, [[1.0, 1.0, 1.0, 1.0]])[0]
    assert row.predicted_id == 0
    assert [s.label for s in row.all_scores] == list(LABELS)


def test_list_orders_by_rounded_score(spark):
    """Two classes that round alike stand in class order, though the second is likelier."""
    df = spark.createDataFrame([([0.30001, 0.30002, 0.2, 0.19997],)], "probabilities array<double>")
    row = with_predictions(df).first()
    assert row.predicted_label == "Sports"
    assert [s.label for s in row.all_scores][:2] == ["World", "Sports"]


def test_one_class(spark):
    row = predictions(spark, [[3.5]])[0]
    assert (row.predicted_id, row.confidence, len(row.all_scores)) == (0, 1.0, 1)


def test_a_class_without_name(spark):
    logits = [[0.0, 0.0, 0.0, 0.0, 9.0]]
    assert predictions(spark, logits, ranked=False)[0].predicted_label == "Unknown"
    with pytest.raises(PySparkException, match="no category name for class 4"):
        predictions(spark, logits)


def test_extreme_logits_stay_finite(spark):
    row = predictions(spark, [[-1e4, 0.0, 1e4, -1e300]])[0]
    assert (row.predicted_id, row.confidence) == (2, 1.0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50), min_size=4, max_size=4), min_size=1, max_size=30))
def test_score_properties(spark, logits):
    for row in predictions(spark, logits):
        values = [s.score for s in row.all_scores]
        assert abs(sum(values) - 1) <= 5e-4 and values == sorted(values, reverse=True)
        assert {s.label for s in row.all_scores} == set(LABELS)
        assert row.confidence == values[0] and row.predicted_label in LABELS


def test_labels_both_ways(spark):
    df = spark.createDataFrame([(i,) for i in (-1, 0, 3, 4, None)], "i int")
    name = labels.label_name(F.col("i"))
    rows = df.select(name, labels.label_id(name), labels.zero_based(F.col("i"))).collect()
    assert [r[0] for r in rows] == ["Unknown", "World", "Science/Technology", "Unknown", "Unknown"]
    assert [r[1] for r in rows] == [None, 0, 3, None, None]
    assert [r[2] for r in rows] == [-2, -1, 2, 3, None]


def test_json_there_and_back(spark):
    row = [("World", 0.0001), ("Sports", 0.9999)]
    df = spark.createDataFrame([(row,)], "s array<struct<label string, score double>>")
    text = scores.scores_to_json(F.col("s"))
    assert df.select(scores.scores_from_json(text)).first()[0] == [tuple(x) for x in row]
