"""Numbers of the log's list, unique ids, compaction."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rubrika.sources import compaction, prediction_log, publication, unique_ids
from tests.test_log import T0, frame, good


def entry(k):
    return {"kind": "attempt", "source": "s", "run": "r", "batch_id": k, "attempt": f"a{k}", "keyed": False}


def kept(spark, path, **options):
    return sorted((r.source, r.batch_id, r.id) for r in prediction_log.read_log(spark, path, **options).collect())


def rejected(spark, path):
    return [(r.batch_id, r.id, r.reason) for r in prediction_log.read_rejected(spark, path).collect()]


# --- numbers ---------------------------------------------------------------------------------


def test_writers_at_the_same_time_get_different_numbers(spark, tmp_path):
    path = str(tmp_path / "log")
    prediction_log.create_log(spark, path)
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: publication.publish(spark, path, entry(k)), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    listed = publication.published(spark, path).collect()
    assert {(r.number, r.attempt) for r in listed} == {(n, f"a{k}") for k, n in enumerate(numbers)}
    assert not os.listdir(f"{path}/preparing")


def test_a_clash_is_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    prediction_log.create_log(spark, path)
    since = publication.newest(spark, path)
    publication.publish(spark, path, entry(1))
    with pytest.raises(publication.Outdated):
        publication.publish(spark, path, entry(2), since, lambda other: other["batch_id"] == 1)
    assert publication.publish(spark, path, entry(2), since, lambda other: other["batch_id"] == 7) == 2


def test_a_clock_set_back(spark, tmp_path):
    """The second attempt comes from a machine whose clock is a year behind."""
    path = str(tmp_path / "log")
    prediction_log.append(frame(spark, [good(1)]), path, 1)
    before = set(Path(path).rglob("*"))
    prediction_log.append(frame(spark, [good(2)]), path, 1)
    past = (T0 - timedelta(days=365)).timestamp()
    for name in set(Path(path).rglob("*")) - before:
        os.utime(name, (past, past))
    assert kept(spark, path) == [("table", 1, 2)]
    assert kept(spark, path, upto=1) == [("table", 1, 1)]


def test_runs_go_by_number(spark, tmp_path):
    path = str(tmp_path / "log")
    for k, run in enumerate(("one", "two", "one")):
        prediction_log.append(frame(spark, [good(k)]), path, k, run=run)
    assert [x[2] for x in kept(spark, path)] == [0, 2]
    assert [x[2] for x in kept(spark, path, upto=2)] == [1]


def test_a_snapshot_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in (1, 2, 1):
        prediction_log.append(frame(spark, [good(k)]), path, k)
    whole = kept(spark, path)
    publication.write_snapshot(spark, path, 3)
    assert kept(spark, path) == whole and kept(spark, path, upto=2) == whole
    publication.forget(spark, path, 3)
    assert not [n for n in os.listdir(f"{path}/list") if n.endswith(".json") and n[0] != "."]
    assert kept(spark, path) == whole
    assert prediction_log.append(frame(spark, [good(9)]), path, 3) == 4
    assert kept(spark, path) == [*whole, ("table", 3, 9)]


# --- unique ids ------------------------------------------------------------------------------


def test_repeated_ids(spark, tmp_path):
    path = str(tmp_path / "log")
    later = T0 + timedelta(hours=1)
    first = [good(1), good(1, created_at=later), good(2), good(2), good(3, confidence=9.0), good(None), good(3)]
    for _ in range(2):  # an attempt does not meet its own batch
        prediction_log.append(frame(spark, first), path, 1, unique=True)
    assert kept(spark, path) == [("table", 1, 1), ("table", 1, 2), ("table", 1, 3)]
    assert prediction_log.read_log(spark, path).where("id = 1").first().created_at == T0
    assert sorted(rejected(spark, path), key=str) == sorted(
        [
            (1, 1, unique_ids.IN_BATCH),
            (1, 2, unique_ids.IN_BATCH),
            (1, 3, "confidence is outside 0..1"),
            (1, None, "id is null"),
        ],
        key=str,
    )


def test_ids_of_other_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    prediction_log.append(frame(spark, [good(k) for k in range(50)]), path, 1)  # without keys
    prediction_log.append(frame(spark, [good(k) for k in range(40, 90)]), path, 2, unique=True)
    prediction_log.append(frame(spark, [good(k) for k in range(80, 120)]), path, 3, unique=True)
    assert [x[2] for x in kept(spark, path)] == list(range(120))
    assert {r[1] for r in rejected(spark, path) if r[2] == unique_ids.IN_LOG} == {*range(40, 50), *range(80, 90)}
    # A batch that is replaced gives its ids back; another source and run have their own.
    prediction_log.append(frame(spark, []), path, 2, unique=True)
    prediction_log.append(frame(spark, [good(55)]), path, 4, unique=True)
    prediction_log.append(frame(spark, [good(1)]), path, 5, source="other", unique=True)
    assert ("table", 4, 55) in kept(spark, path) and ("other", 5, 1) in kept(spark, path)


def test_a_batch_published_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    whole, done = unique_ids.write_keys, []

    def write_keys(*args):
        whole(*args)
        if not done:
            done.append(1)
            prediction_log.append(frame(spark, [good(1), good(2)]), path, 7)

    monkeypatch.setattr(unique_ids, "write_keys", write_keys)
    prediction_log.append(frame(spark, [good(2), good(3)]), path, 8, unique=True)
    assert kept(spark, path) == [("table", 7, 1), ("table", 7, 2), ("table", 8, 3)]


@pytest.mark.parametrize("words", [0, 10**6])
def test_the_filter_loses_no_id(spark, words):
    ids = spark.range(0, 3000, 3)
    older = spark.range(1500, 9000).select("id", unique_ids.bucket(F.col("id")))
    found = {r.id for r in unique_ids.known(ids, older, words).collect()}
    assert found == set(range(1500, 3000, 3))
    bits = 1 << 14
    passed = unique_ids.may_be_in(older.select("id"), unique_ids.bloom(ids, bits), bits).count()
    assert 500 <= passed < 560


def test_a_hot_id(spark, tmp_path):
    """A third of all rows share one id, in rows that differ and rows that do not."""
    path = str(tmp_path / "log")
    rows = [good(0 if k % 3 == 0 else k, input_text=f"text {k % 300}") for k in range(3000)]
    prediction_log.append(frame(spark, rows).repartition(8), path, 1, unique=True)
    assert [x[2] for x in kept(spark, path)] == [0, *[k for k in range(3000) if k % 3]]
    assert len(rejected(spark, path)) == 999


# --- compaction --------------------------------------------------------------------------------


def fill(spark, path, batches=6):
    for batch in range(batches):
        rows = [good(100 * batch + k, created_at=T0 + timedelta(days=k % 5)) for k in range(20)]
        rows.append(good(None, created_at=T0))
        prediction_log.append(frame(spark, rows).coalesce(1), path, batch)


def data_files(path, part):
    return [p for p in Path(f"{path}/{part}").rglob("part-*.parquet")]


def test_compaction_keeps_rows_and_bounds_files(spark, tmp_path):
    path = str(tmp_path / "log")
    fill(spark, path)
    whole, aside = kept(spark, path), sorted(rejected(spark, path), key=str)
    recent = prediction_log.read_recent(spark, path, 7).collect()
    number = compaction.compact(spark, path, date(2024, 3, 4))
    assert kept(spark, path) == whole and sorted(rejected(spark, path), key=str) == aside
    assert prediction_log.read_recent(spark, path, 7).collect() == recent
    assert len(data_files(path, "compacted")) == 4  # three closed days, one of them with rejected rows
    before = len(data_files(path, "rows"))
    assert compaction.remove_replaced(spark, path, number) == 6 * 4
    assert len(data_files(path, "rows")) == before - 6 * 4
    assert kept(spark, path) == whole and sorted(rejected(spark, path), key=str) == aside
    assert compaction.compact(spark, path, date(2024, 3, 4)) is None


def test_batches_replaced_after_a_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    fill(spark, path, 3)
    first = compaction.compact(spark, path, date(2024, 3, 3))
    prediction_log.append(frame(spark, [good(7), good(8, created_at=T0 + timedelta(days=4))]), path, 1)
    want = kept(spark, path)
    assert [x for x in want if x[1] == 1] == [("table", 1, 7), ("table", 1, 8)]
    second = compaction.compact(spark, path, date(2024, 3, 9))
    assert kept(spark, path) == want
    as_of_first = kept(spark, path, upto=first)
    assert len(as_of_first) == 60
    compaction.remove_replaced(spark, path, second)
    assert kept(spark, path) == want
    assert not data_files(path, "rows")


def test_a_failed_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    fill(spark, path, 2)
    whole, at = kept(spark, path), publication.newest(spark, path)
    monkeypatch.setattr(compaction, "_compare", lambda *_: (_ for _ in ()).throw(ValueError("lost rows")))
    with pytest.raises(ValueError, match="lost rows"):
        compaction.compact(spark, path, date(2024, 3, 9))
    assert kept(spark, path) == whole and publication.newest(spark, path) == at


def test_missing_rows_are_noticed(spark, tmp_path):
    path = str(tmp_path / "log")
    fill(spark, path, 2)
    os.remove(data_files(path, "rows")[0])
    with pytest.raises(ValueError, match="does not hold"):
        compaction.compact(spark, path, date(2024, 3, 9))


def test_two_compactions_at_a_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    fill(spark, path, 2)
    whole, compare, done = kept(spark, path), compaction._compare, []

    def other_first(*args):
        compare(*args)
        if not done:
            done.append(1)
            compaction.compact(spark, path, date(2024, 3, 2))

    monkeypatch.setattr(compaction, "_compare", other_first)
    with pytest.raises(publication.Outdated):
        compaction.compact(spark, path, date(2024, 3, 9))
    assert kept(spark, path) == whole
    assert compaction.compact(spark, path, date(2024, 3, 9))
    assert kept(spark, path) == whole


def test_unique_ids_after_a_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    prediction_log.append(frame(spark, [good(1), good(2)]), path, 1)
    prediction_log.append(frame(spark, [good(3)]), path, 2, unique=True)
    number = compaction.compact(spark, path, date(2024, 3, 9))
    compaction.remove_replaced(spark, path, number)
    prediction_log.append(frame(spark, [good(k) for k in range(1, 6)]), path, 3, unique=True)
    assert [x[2] for x in kept(spark, path)] == [1, 2, 3, 4, 5]
