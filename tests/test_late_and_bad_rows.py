"""Days corrected by late rows, repeated articles of a stream, records that cannot be read."""

from datetime import datetime

import pytest

from rubrika.operators import analytics
from rubrika.schemas import PREDICTIONS
from rubrika.sources import corpus
from rubrika.streaming import corrections
from rubrika.streaming.repeats import distinct_articles
from tests.test_streaming import rows, stream_of


@pytest.fixture(scope="module")
def few(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def test_late_rows_correct_closed_days(few, tmp_path):
    batches = [rows([1, 1, 2, 2]), rows([4, 4]), rows([1, 1, 1, 5]), rows([6])]
    batches[2].append((99, "no label", None, 0.5, None, "v1.0", datetime(2024, 1, 2, 3)))
    batches[3].append((98, "no time", "World", 0.5, None, "v1.0", None))
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "offsets")

    def run():
        stream = stream_of(few, source, PREDICTIONS)
        query = corrections.corrected_daily_volume(stream, "1 hour", path, checkpoint)
        query.awaitTermination()
        return query.id

    names = set()
    for batch in batches:  # started anew for each batch, it goes on where it stopped
        few.createDataFrame(batch, PREDICTIONS).coalesce(1).write.mode("append").parquet(source)
        names.add(run())
    assert len(names) == 1
    name = names.pop()

    emitted = corrections.read_emitted(few, path, name).orderBy("epoch", "prediction_date").collect()
    told = [(r.epoch, r.prediction_date.day, r.kind, r.total, r.late) for r in emitted]
    assert told[:2] == [(0, 1, "final", 2, 0), (1, 2, "final", 2, 0)]
    assert (2, 1, "correction", 5, 3) in told and (2, 2, "correction", 3, 1) in told
    assert sum(kind == "final" for _, day, kind, _, _ in told if day == 1) == 1

    now = corrections.read_corrected(few, path, name)
    everything = few.createDataFrame([r for b in batches for r in b], PREDICTIONS)
    wanted = analytics.daily_volume(everything)
    columns = ["prediction_date", "total", "unique_categories"]
    assert set(now.select(columns).collect()) == set(wanted.select(columns).collect())
    assert now.agg({"total": "sum"}).first()[0] == everything.count()
    assert [r.closed for r in now.where("prediction_date IS NULL").collect()] == [False]


def test_a_micro_batch_run_again_changes_nothing(few, tmp_path):
    kept = few.createDataFrame([(datetime(2024, 1, 1).date(), 2, ["World"], 0, True, datetime(2024, 1, 3))], corrections.DAYS)
    came = few.createDataFrame(
        [(datetime(2024, 1, 1).date(), 3, ["World", "Sports"], datetime(2024, 1, 1, 5))],
        "came_date date, added long, came_labels array<string>, came_newest timestamp",
    )
    once, again = (corrections._advanced(kept, came, "1 hour").collect() for _ in range(2))
    assert once == again
    assert (once[0].total, once[0].late, sorted(once[0].labels)) == (5, 3, ["Sports", "World"])
    empty = corrections._advanced(kept, came.limit(0), "1 hour").first()
    assert (empty.total, empty.added, empty.closed) == (2, 0, True)


def test_repeats_within_and_beyond_the_span(few, tmp_path):
    source, schema = str(tmp_path / "in"), "doc_id long, text string, created_at timestamp"
    batches = [
        [(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1)), (3, None, datetime(2024, 1, 1)), (4, "", datetime(2024, 1, 1))],
        [(5, "a", datetime(2024, 1, 1, 12)), (6, None, datetime(2024, 1, 1, 13)), (7, "c", datetime(2024, 1, 9))],
        [(8, "a", datetime(2024, 1, 9, 1)), (9, "c", datetime(2024, 1, 9, 2))],
        [(10, "a", datetime(2024, 1, 9, 3)), (11, "c", datetime(2024, 1, 9, 4))],
    ]
    for batch in batches:
        few.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = stream_of(few, source, few.createDataFrame([], schema).schema)
    out = str(tmp_path / "out")
    query = (
        distinct_articles(stream, "1 day")
        .writeStream.option("checkpointLocation", str(tmp_path / "offsets"))
        .trigger(availableNow=True)
        .start(out, format="parquet")
    )
    query.awaitTermination()
    # 8 comes in the micro-batch at whose end the text of 1 leaves the state, 10 after it.
    assert sorted(r.doc_id for r in few.read.parquet(out).collect()) == [1, 2, 3, 4, 7, 10]


def test_csv_records_that_do_not_fit(spark, tmp_path):
    (tmp_path / "in.csv").write_text('1,good one,2\n2,"quoted, too",x\n3,short\n,no id,1\n5,many,1,2\n')
    checked = corpus.read_checked(spark, str(tmp_path / "in.csv"), "csv")
    assert [r.doc_id for r in corpus.accepted(checked).collect()] == [1]
    bad = {(r.reason, r._raw) for r in corpus.rejected(checked).collect()}
    unfit = corpus.MALFORMED
    assert bad == {(unfit, '2,"quoted, too",x'), (unfit, "3,short"), ("doc_id is missing", None), (unfit, "5,many,1,2")}
    assert corpus.accepted(checked).columns == ["doc_id", "text", "label"]


def test_json_records_that_do_not_fit(spark, tmp_path):
    lines = ['{"doc_id": 1, "text": "t", "label": 0}', '{"doc_id": 2, "text"', '{"doc_id": 3, "label": 1}', "[]", '{"doc_id": 4, "text": ""}']
    (tmp_path / "in.json").write_text("\n".join(lines) + "\n")
    checked = corpus.read_checked(spark, str(tmp_path / "in.json"), "json")
    assert sorted(r.doc_id for r in corpus.accepted(checked).collect()) == [1, 4]
    reasons = [r.reason for r in corpus.rejected(checked).collect()]
    assert reasons.count("text is missing") >= 1 and corpus.MALFORMED in reasons
    (tmp_path / "none.json").write_text("")
    assert corpus.read_checked(spark, str(tmp_path / "none.json"), "json").count() == 0


def test_formats_and_names_that_cannot_be_checked(spark):
    with pytest.raises(ValueError, match="only json and csv"):
        corpus.read_checked(spark, "x", "parquet")
    with pytest.raises(ValueError, match="must not name"):
        corpus.read_checked(spark, "x", "json", "doc_id long, reason string")
