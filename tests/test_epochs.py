"""Epoch training beside plain loops."""

import numpy as np
import pytest

from rubrika.operators import epochs
from rubrika.operators.encoding import with_tokens
from rubrika.operators.scoring import score
from rubrika.sources import files
from rubrika.sources.models import load_model, save_model

WORDS = [f"w{k}" for k in range(30)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    found = []
    for k in range(160):
        label = int(rng.integers(0, 4))
        words = [WORDS[int(x)] for x in rng.integers(0, 30, int(rng.integers(0, 25)))] + [f"class{label}"] * (k % 3)
        found.append((k, " ".join(words), label))
    return found


def frame(spark, rows):
    return with_tokens(spark.createDataFrame(rows, "doc_id long, text string, label int")).repartition(3)


def plain_training(train, test, steps, rate):
    counts = {}
    for _, text, _ in train:
        for word in text.split():
            counts[word] = counts.get(word, 0) + 1
    known = sorted(counts, key=lambda w: (-counts[w], w))

    def matrix(rows):
        x = np.zeros((len(rows), len(known)))
        for k, (_, text, _) in enumerate(rows):
            words = text.split()
            for word in words:
                if word in counts:
                    x[k, known.index(word)] += 1 / len(words)
        return x, np.array([label for _, _, label in rows])

    (x, y), (u, v) = matrix(train), matrix(test)
    w, found = np.zeros((len(known), 4)), []

    def measure():
        p = epochs.softmax(u @ w)
        found.append((-np.log(p[np.arange(len(v)), v]).mean(), (p.argmax(axis=1) == v).mean()))

    measure()
    for _ in range(steps):
        p = epochs.softmax(x @ w)
        p[np.arange(len(y)), y] -= 1
        w = w - rate * (x.T @ p) / len(y)
        measure()
    return known, w, found


def test_epochs_beside_a_plain_loop(spark, rows, tmp_path):
    train, test = rows[:120], rows[120:]
    known, weights, found = plain_training(train, test, 4, 20.0)
    model, metrics = epochs.train_epochs(frame(spark, train), frame(spark, test), str(tmp_path / "m"), 4, rate=20.0)
    assert model.vocabulary == known
    assert np.allclose([(m["loss"], m["accuracy"]) for m in metrics], found)
    best = max(range(5), key=lambda k: (found[k][1], -k))
    assert [m["is_best"] for m in metrics] == [k == best for k in range(5)]
    if best == 4:
        assert np.allclose(model.weights, weights)
    assert metrics[-1]["train_loss"] < metrics[1]["train_loss"] == pytest.approx(np.log(4))


@pytest.mark.parametrize("steps, momentum", [(1, 0.0), (3, 0.5)])
def test_a_run_cut_in_half_equals_one_run(spark, rows, tmp_path, steps, momentum):
    train, test = frame(spark, rows[:120]).cache(), frame(spark, rows[120:]).cache()
    options = dict(steps=steps, rate=10.0, momentum=momentum)
    whole, metrics = epochs.train_epochs(train, test, str(tmp_path / "whole"), 4, **options)
    cut = str(tmp_path / "cut")
    epochs.train_epochs(train, test, cut, 2, **options)
    files.delete(spark, f"{cut}/state/epoch=2/_SUCCESS")  # the run ended while it wrote this epoch
    again, taken_up = epochs.train_epochs(train, test, cut, 4, **options)
    assert taken_up == metrics and np.array_equal(again.weights, whole.weights)


def test_gradients_meet_in_a_tree(spark, rows, tmp_path, monkeypatch):
    train, test = frame(spark, rows[:120]).repartition(7), frame(spark, rows[120:])
    _, wide = epochs.train_epochs(train, test, str(tmp_path / "a"), 2)
    monkeypatch.setattr(epochs, "FAN", 2)
    _, narrow = epochs.train_epochs(train, test, str(tmp_path / "b"), 2)
    assert np.allclose([m["loss"] for m in wide], [m["loss"] for m in narrow])


def test_scores_of_a_stored_model(spark, rows, tmp_path):
    train, test = frame(spark, rows[:120]), frame(spark, rows[120:])
    model, metrics = epochs.train_epochs(train, test, str(tmp_path / "m"), 3, rate=20.0)
    save_model(model, str(tmp_path / "model"))
    read = load_model(str(tmp_path / "model"))
    texts = spark.createDataFrame(rows[120:], "doc_id long, text string, label int")
    scored = score(texts, read, on_blank="keep").collect()
    hits = [r["predicted_id"] == r["label"] for r in scored if r["predicted_id"] is not None]
    assert len(scored) == 40 and sum(hits) > 0.5 * len(hits)
    assert {r.doc_id: r.all_scores for r in scored} == {
        r.doc_id: r.all_scores for r in score(texts, model, on_blank="keep").collect()
    }


def test_odd_training_rows(spark, tmp_path):
    rows = [(k, "a b", k % 4) for k in range(8)] + [(9, "", 0)]
    held_out = [(1, "a", 0), (2, "a", None), (3, None, 1), (4, "unseen", 2)]
    _, metrics = epochs.train_epochs(frame(spark, rows), frame(spark, held_out), str(tmp_path / "m"), 1)
    assert (metrics[0]["n_train"], metrics[0]["n_test"]) == (9, 3)
    _, metrics = epochs.train_epochs(frame(spark, rows), frame(spark, []), str(tmp_path / "n"), 1)
    assert metrics[1]["accuracy"] is None and metrics[0]["is_best"]
    with pytest.raises(ValueError, match="class"):
        epochs.train_epochs(frame(spark, [(1, "a", None)]), frame(spark, []), str(tmp_path / "o"), 1)
    with pytest.raises(ValueError, match="at most"):
        epochs.train_epochs(frame(spark, rows), frame(spark, []), str(tmp_path / "p"), 1, vocabulary_size=10**8)
