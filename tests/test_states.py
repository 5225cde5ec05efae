"""Statistics merged from states equal those of the rows, which are then not opened."""

from datetime import datetime

from rubrika.operators import analytics
from rubrika.schemas import PREDICTIONS
from rubrika.sources import files, prediction_log, states


def log_rows(spark, values):
    rows = [(i, f"t{i}", label, share, None, "v1.0", datetime(2024, 1, day, 5)) for i, label, share, day in values]
    return spark.createDataFrame(rows, PREDICTIONS)


def test_states_equal_rows_and_replace_with_attempts(spark, tmp_path):
    path = str(tmp_path / "log")
    assert states.category_stats(states.read_states(spark, path)).count() == 0
    first = [(1, "World", 0.12345, 1), (2, "Sports", 1.0, 1), (3, None, 0.5, 2), (4, "World", 7.0, 2)]
    prediction_log.append(log_rows(spark, first), path, 1, states=True)
    before = prediction_log.append(log_rows(spark, [(9, "World", 0.1, 3)]), path, 2, states=True)
    prediction_log.append(log_rows(spark, [(10, "Business", 0.33335, 3), (11, "World", 0.2, 4)]), path, 2, states=True)
    prediction_log.append(log_rows(spark, [(12, "Sports", 0.25, 4)]), path, 3)  # without states
    prediction_log.append(log_rows(spark, [(13, "Sports", 7.0, 4)]), path, 4, states=True)  # none is accepted
    for upto in (None, before):
        log = prediction_log.read_log(spark, path, upto)
        merged = states.read_states(spark, path, upto)
        assert states.category_stats(merged).collect() == analytics.category_stats(log).collect()
        assert states.daily_volume(merged).collect() == analytics.daily_volume(log).collect()


def test_no_row_is_opened(spark, tmp_path):
    path = str(tmp_path / "log")
    prediction_log.append(log_rows(spark, [(i, "World", i / 10, 1 + i) for i in range(9)]), path, 1, states=True)
    want = analytics.category_stats(prediction_log.read_log(spark, path)).collect()
    files.delete(spark, f"{path}/rows")
    assert states.category_stats(states.read_states(spark, path)).collect() == want
