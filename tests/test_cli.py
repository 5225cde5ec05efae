import re

import pytest

from rubrika.__main__ import main
from rubrika.sources.prediction_log import read_log
from tests.test_models import ROWS


def test_train_score_and_ask(spark, tmp_path, capsys):
    corpus, model, log = (str(tmp_path / n) for n in ("corpus", "model", "log"))
    spark.createDataFrame(ROWS, "doc_id long, text string, label int").write.parquet(corpus)
    main(["train", "--input", corpus, "--model", model, "--subset", "150"])
    assert "accuracy" in capsys.readouterr().out
    for _ in range(2):
        main(["score", "--input", corpus, "--model", model, "--log", log, "--batch", "3"])
    assert "accepted" in capsys.readouterr().out
    assert read_log(spark, log).count() == len(ROWS)
    main(["predict", "--model", model, "a goal in the match"])
    assert "Sports" in capsys.readouterr().out
    main(["stats", "--log", log])
    main(["recent", "--log", log, "--limit", "5"])
    out = capsys.readouterr().out
    assert "total_predictions" in out and "unique_categories" in out and out.count("%)") == 5


@pytest.mark.parametrize("kind", ["bayes", "select", "epochs"])
def test_given_splits_names_and_version(spark, tmp_path, capsys, kind):
    """Only rows marked ``train`` are learned from, whatever their keys; the log has the model's names
    and version; an id that is scored again is set aside."""
    corpus, model, log = (str(tmp_path / n) for n in ("corpus", "model", "log"))
    rows = [(*row, "train" if row[0] % 3 else "test") for row in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, label int, split string").write.parquet(corpus)
    names = ["Welt", "Sport", "Geld", "Technik"]
    main(["train", "--input", corpus, "--model", model, "--kind", kind, "--names", *names, "--version", "v9"])
    held_out = sum(row[3] == "test" for row in rows)
    assert re.search(rf"\| *{held_out}\|", capsys.readouterr().out)
    for batch in ("1", "2"):
        main(["score", "--input", corpus, "--model", model, "--log", log, "--batch", batch, "--unique"])
    kept = read_log(spark, log).collect()
    assert len(kept) == len(ROWS) and {r.batch_id for r in kept} == {1}
    assert {r.model_version for r in kept} == {"v9"} and {r.predicted_label for r in kept} <= set(names)
    main(["compact", "--log", log, "--before", "2999-01-01", "--reached", "2"])
    assert "compacted, number 3" in capsys.readouterr().out
    assert read_log(spark, log).count() == len(ROWS)
