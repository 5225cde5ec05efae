from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rubrika.operators import analytics
from rubrika.operators.guard import require_text, split_blank
from rubrika.operators.prediction_rows import prepare, validate
from rubrika.schemas import LOG_TABLE, PREDICTIONS
from rubrika.sources import prediction_log

T0 = datetime(2024, 3, 1, 12)


def frame(spark, rows):
    return spark.createDataFrame(rows, PREDICTIONS)


def good(i, **change):
    row = dict(
        id=i,
        input_text=f"text {i}",
        predicted_label="World",
        confidence=0.5,
        all_scores=[("World", 0.5)],
        model_version="v1.0",
        created_at=T0,
    )
    row.update(change)
    return tuple(row.values())


BROKEN = {
    "id is null": dict(id=None),
    "input_text is null": dict(input_text=None),
    "predicted_label is null": dict(predicted_label=None),
    "confidence is null": dict(confidence=None),
    "created_at is null": dict(created_at=None),
    "confidence is outside 0..1": dict(confidence=1.0001),
    "predicted_label is longer than 64": dict(predicted_label="é" * 65),
    "model_version is longer than 128": dict(model_version="v" * 129),
}


@pytest.mark.parametrize("reason", BROKEN)
def test_each_rule(spark, reason):
    row = validate(frame(spark, [good(1, **BROKEN[reason])])).first()
    assert (row.status, row.reason) == ("rejected", reason)


@pytest.mark.parametrize("bad", [-0.0001, float("nan"), float("inf")])
def test_confidence_range(spark, bad):
    assert validate(frame(spark, [good(1, confidence=bad)])).first().status == "rejected"


def test_edges_are_accepted(spark):
    rows = [
        good(1, confidence=0.0),
        good(2, confidence=1.0),
        good(3, predicted_label="é" * 64, model_version="v" * 128),
        good(4, all_scores=None, model_version=None),
    ]
    assert {r.status for r in validate(frame(spark, rows)).collect()} == {"accepted"}


def test_prepare_fills_in(spark):
    schema = "t string, predicted_label string, confidence double"
    df = spark.createDataFrame([("x" * 5000, "World", 0.5)], schema)
    row = prepare(df, text="t").first()
    assert len(row.input_text) == 4000 and row.model_version == "v1.0"
    assert row.created_at is not None and row.id is not None and row.all_scores is None
    versions = spark.createDataFrame(
        [("a", "World", 0.5, None), ("b", "World", 0.5, "v2")],
        "input_text string, predicted_label string, confidence double, model_version string",
    )
    assert [r.model_version for r in prepare(versions).orderBy("input_text").collect()] == ["v1.0", "v2"]


def test_made_ids_are_unique(spark):
    df = spark.range(1000).repartition(5).selectExpr(
        "'t' AS input_text", "'World' AS predicted_label", "0.5D AS confidence"
    )
    assert prepare(df).select("id").distinct().count() == 1000


@pytest.mark.parametrize("rebalance", [True, False])
def test_append_read_and_repeat(spark, tmp_path, rebalance):
    path = str(tmp_path / "log")
    prediction_log.create_log(spark, path)
    assert prediction_log.read_log(spark, path).count() == 0
    first = [good(1), good(2, confidence=7.0), good(3, created_at=datetime(2024, 3, 2))]
    for _ in range(2):
        prediction_log.append(frame(spark, first), path, 1, rebalance)
    prediction_log.append(frame(spark, [good(1), good(9, created_at=None)]), path, 2, rebalance)
    prediction_log.create_log(spark, path)

    log = prediction_log.read_log(spark, path)
    assert sorted((r.batch_id, r.id) for r in log.collect()) == [(1, 1), (1, 3), (2, 1)]
    assert {str(r.prediction_date) for r in log.collect()} == {"2024-03-01", "2024-03-02"}
    assert log.where("batch_id = 1 AND id = 1").first().all_scores == [("World", 0.5)]
    rejected = prediction_log.read_rejected(spark, path).collect()
    assert sorted((r.batch_id, r.id, r.reason) for r in rejected) == [
        (1, 2, "confidence is outside 0..1"),
        (2, 9, "created_at is null"),
    ]
    outcome = prediction_log.batch_outcome(spark, path).collect()
    assert {(r.batch_id, r.status): r.n for r in outcome} == {
        (1, "accepted"): 2,
        (1, "rejected"): 1,
        (2, "accepted"): 1,
        (2, "rejected"): 1,
    }


def test_missing_log_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        prediction_log.read_log(spark, str(tmp_path / "none")).count()


def test_a_row_in_and_out(spark, tmp_path):
    path = str(tmp_path / "log")
    row = good(
        1,
        input_text="A late train makes a long evening.",
        predicted_label="Business",
        confidence=0.812,
        all_scores=[("Business", 0.812), ("Science/Technology", 0.101)],
    )
    prediction_log.append(frame(spark, [row]), path, 0)
    latest = analytics.recent_predictions(prediction_log.read_log(spark, path), 3).collect()
    assert [(r.predicted_label, r.confidence) for r in latest] == [("Business", 0.812)]
    line = analytics.history(prediction_log.read_log(spark, path)).first()
    assert line.heading == "[2024-03-01 12:00] Business (81.2%)"
    assert line.preview == "A late train makes a long evening."


@pytest.mark.parametrize("limit", [1, 3, 7, 500])
def test_newest_days_hold_the_latest_rows(spark, tmp_path, limit):
    path = str(tmp_path / "log")
    rows = [good(i, created_at=datetime(2024, 1, 1 + (i * i) % 9, i % 24)) for i in range(60)]
    prediction_log.append(frame(spark, rows), path, 1, True)
    log = prediction_log.read_log(spark, path)
    whole = analytics.recent_predictions(log, limit).collect()
    assert prediction_log.read_recent(spark, path, limit).collect() == whole
    assert len(whole) == min(limit, 60)


def test_newest_days_of_an_empty_log(spark, tmp_path):
    path = str(tmp_path / "log")
    prediction_log.create_log(spark, path)
    assert prediction_log.read_recent(spark, path).count() == 0


def test_views(spark):
    rows = [
        good(1, confidence=0.12345),
        good(2, confidence=0.12345),
        good(3, predicted_label="Sports", created_at=datetime(2024, 3, 2)),
        good(4, predicted_label="Business"),
    ]
    prediction_log.register_views(frame(spark, rows))
    stats = spark.table("category_stats").collect()
    assert [tuple(r) for r in stats] == [
        ("World", 2, 0.1235, T0),
        ("Business", 1, 0.5, T0),
        ("Sports", 1, 0.5, datetime(2024, 3, 2)),
    ]
    days = [(str(r[0]), r[1], r[2]) for r in spark.table("daily_prediction_volume").collect()]
    assert days == [("2024-03-02", 1, 1), ("2024-03-01", 3, 2)]
    asked = spark.sql(
        "SELECT id FROM predictions WHERE predicted_label = :label ORDER BY id LIMIT :n",
        args={"label": "World", "n": 1},
    )
    assert [r.id for r in asked.collect()] == [1]


def test_split_blank_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "i int, text string")
    kept, blank = split_blank(df)
    assert [r.i for r in kept.collect()] == [1]
    assert {(r.i, r.reason) for r in blank.collect()} == {(2, "text is blank"), (3, "text is blank")}
    assert require_text(df.where("i = 1")).collect() == [(1, "a")]


def test_log_table_schema(spark, tmp_path):
    path = str(tmp_path / "log")
    prediction_log.append(frame(spark, [good(1)]), path, 5)
    stored = prediction_log.read_rejected(spark, path).schema
    inner = ("status", "run", "attempt")
    assert [(f.name, f.dataType) for f in stored] == [
        (f.name, f.dataType) for f in LOG_TABLE if f.name not in inner
    ]
    assert prediction_log.read_log(spark, path).select(F.col("batch_id")).first()[0] == 5


def test_a_failed_attempt_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = frame(spark, [good(i) for i in range(40)])
    prediction_log.append(rows, path, 1)
    broken = F.when(F.col("id") >= 0, F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        prediction_log.append(rows.withColumn("confidence", broken), path, 1)
    assert prediction_log.read_log(spark, path).count() == 40
    prediction_log.append(rows.where("id < 0"), path, 1)
    assert prediction_log.read_log(spark, path).count() == 0
    assert prediction_log.batch_outcome(spark, path).count() == 0


def test_sources_do_not_meet(spark, tmp_path):
    path = str(tmp_path / "log")
    for source in ("a", "b"):
        prediction_log.append(frame(spark, [good(1), good(2)]), path, 0, source=source)
    prediction_log.append(frame(spark, [good(3)]), path, 0, source="b", run="second")
    log = prediction_log.read_log(spark, path)
    assert sorted((r.source, r.id) for r in log.collect()) == [("a", 1), ("a", 2), ("b", 3)]
    assert prediction_log.runs(spark, path, "b") == {"first", "second"}
    with pytest.raises(ValueError, match="name a source"):
        prediction_log.append(frame(spark, [good(1)]), path, 0, source="a/b")
