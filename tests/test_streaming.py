from datetime import datetime, timedelta

import pytest

from rubrika.operators import analytics, scoring, training
from rubrika.operators.encoding import with_tokens
from rubrika.operators.prediction_rows import prepare
from rubrika.schemas import PREDICTIONS
from rubrika.sources import prediction_log
from rubrika.streaming import stats
from rubrika.streaming.score import score_to_log
from tests.test_models import ROWS


def stream_of(spark, folder, schema, per_batch=1):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return source.parquet(str(folder))


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, label int")
    return training.fit_naive_bayes(with_tokens(df))


def test_stream_scores_like_a_batch(spark, model, tmp_path):
    texts = [(r[0], r[1] if r[0] % 7 else "  ") for r in ROWS]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "in"))
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "offsets")

    def start():
        stream = stream_of(spark, tmp_path / "in", df.schema)
        score_to_log(stream, model, log, checkpoint).awaitTermination()

    start()
    scored = prepare(scoring.score(df, model), key="doc_id", text="text")
    columns = ["id", "input_text", "predicted_label", "confidence", "all_scores"]
    stored = prediction_log.read_log(spark, log)
    assert stored.select("batch_id").distinct().count() == 3
    assert sorted(stored.select(columns).collect()) == sorted(scored.select(columns).collect())

    rejected = prediction_log.read_rejected(spark, log)
    assert {r.reason for r in rejected.collect()} == {"text is blank"}
    assert stored.count() + rejected.count() == df.count()

    start()
    assert prediction_log.read_log(spark, log).count() == scored.count()

    # New offsets under the same name are refused, or take the place of the older run.
    def restart(**options):
        stream = stream_of(spark, tmp_path / "in", df.schema, per_batch=2)
        score_to_log(stream, model, log, str(tmp_path / "offsets2"), **options).awaitTermination()

    name = stored.first().source
    with pytest.raises(Exception, match="other offsets"):
        restart(source=name)
    assert prediction_log.read_log(spark, log).count() == scored.count()
    restart(source=name, replace=True)
    assert prediction_log.read_log(spark, log).count() == scored.count()
    assert prediction_log.read_log(spark, log).select("batch_id").distinct().count() == 2


def test_table_and_stream_share_a_log(spark, model, tmp_path):
    df = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    log = str(tmp_path / "log")
    rows_of_table = prepare(scoring.score(df.limit(3), model), key="doc_id", text="text")
    prediction_log.append(rows_of_table, log, 0)
    stream = stream_of(spark, tmp_path / "in", df.schema)
    score_to_log(stream, model, log, str(tmp_path / "offsets")).awaitTermination()
    assert prediction_log.read_log(spark, log).count() == 3 + len(ROWS)


def rows(days):
    labels = ("World", "Sports", "Business")
    return [
        (i, f"t{i}", labels[i % 3 if d % 2 else 0], (i % 10) / 10, None, "v1.0", datetime(2024, 1, d, i % 24))
        for i, d in enumerate(days)
    ]


def write_files(spark, folder, parts):
    for part in parts:
        df = spark.createDataFrame(part, PREDICTIONS)
        df.coalesce(1).write.mode("append").parquet(str(folder))


def test_running_stats_equal_batch(spark, tmp_path):
    write_files(spark, tmp_path / "in", [rows([1, 2, 3] * 20), rows([2, 3, 4] * 20), rows([1] * 9)])
    batch = spark.read.schema(PREDICTIONS).parquet(str(tmp_path / "in"))
    stream = stream_of(spark, tmp_path / "in", PREDICTIONS)
    for name, running, whole in (
        ("labels", stats.running_category_stats(stream), analytics.category_stats(batch)),
        ("days", stats.daily_volume_by_window(stream), analytics.daily_volume(batch)),
    ):
        out, offsets = str(tmp_path / name), str(tmp_path / f"{name}-offsets")
        stats.write_running(running, out, offsets, "complete").awaitTermination()
        found = stats.read_running(spark, out, running.schema)
        assert sorted(found.collect()) == sorted(whole.collect())

    write_files(spark, tmp_path / "in", [rows([5] * 40)])
    again = stats.running_category_stats(stream_of(spark, tmp_path / "in", PREDICTIONS, 9))
    out = str(tmp_path / "labels")
    stats.write_running(again, out, str(tmp_path / "new-offsets"), "complete").awaitTermination()
    batch = spark.read.schema(PREDICTIONS).parquet(str(tmp_path / "in"))
    found = stats.read_running(spark, out, again.schema)
    assert sorted(found.collect()) == sorted(analytics.category_stats(batch).collect())
    assert len(list((tmp_path / "labels").glob("query=*/slot=*/*.parquet"))) == 3


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    """Kept, dropped and still open rows add up to all rows."""
    parts = [rows([10] * 5), rows([12] * 4), rows([10] * 3 + [12] * 2), rows([13] * 6)]
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    dropped = 0
    for part in parts:
        write_files(spark, tmp_path / "in", [part])
        days = stats.daily_volume_by_window(stream_of(spark, tmp_path / "in", PREDICTIONS), "1 hour")
        query = stats.write_running(days, out, offsets, "append")
        query.awaitTermination()
        for progress in query.recentProgress:
            dropped += sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])
    final = {str(r.prediction_date): r.total for r in spark.read.parquet(out).collect()}
    assert final == {"2024-01-10": 5, "2024-01-12": 6}
    still_open = 6
    late = spark.read.parquet(str(tmp_path / "in")).count() - sum(final.values()) - still_open
    assert late == 3
    # Late rows combine before the watermark sees them, so it counts one group or more.
    assert 1 <= dropped <= late


def test_window_days_are_utc_days(spark, tmp_path):
    edge = datetime(2024, 1, 2)
    part = [
        (i, "t", "World", 0.5, None, None, edge + timedelta(microseconds=d))
        for i, d in enumerate((-1, 0, 1))
    ]
    df = spark.createDataFrame(part, PREDICTIONS)
    days = stats.daily_volume_by_window(df).orderBy("prediction_date").collect()
    assert [(str(r.prediction_date), r.total) for r in days] == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_days_are_utc_in_another_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 12:00:00Z' AS created_at, 'World' AS predicted_label")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert str(stats.daily_volume_by_window(df).first().prediction_date) == "2024-01-01"
        assert str(analytics.daily_volume(df).first().prediction_date) == "2024-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
