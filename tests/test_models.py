import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rubrika.functions import scores
from rubrika.operators import scoring, training
from rubrika.operators.encoding import with_tokens
from rubrika.operators.evaluation import evaluate
from rubrika.operators.prediction_rows import prepare
from rubrika.operators.token_model import fit_token_model, load_token_model
from rubrika.schemas import LABELS
from rubrika.sources import prediction_log
from rubrika.sources.models import load_model, save_model

random.seed(11)
TOPICS = ("war vote treaty", "goal match coach", "market stock bank", "planet chip robot")
FILLER = "the of and to in a".split()


def article(label):
    words = random.choices(TOPICS[label].split(), k=4) + random.choices(FILLER, k=8)
    random.shuffle(words)
    return " ".join(words)


ROWS = [(i, article(i % 4 if i % 3 else 0), i % 4 if i % 3 else 0) for i in range(240)]


@pytest.fixture(scope="module")
def articles(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, label int")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def bayes(articles):
    return training.fit_naive_bayes(with_tokens(articles))


def by_hand(text):
    """Class probabilities by plain counting."""
    counts = [Counter() for _ in LABELS]
    for _, words, label in ROWS:
        counts[label].update(words.split())
    vocabulary = set().union(*counts)
    logs = []
    for c in range(4):
        total = sum(counts[c].values()) + len(vocabulary)
        prior = math.log((sum(r[2] == c for r in ROWS) + 1) / (len(ROWS) + 4))
        known = [w for w in text.split() if w in vocabulary]
        logs.append(prior + sum(math.log((counts[c][w] + 1) / total) for w in known))
    weights = [math.exp(x - max(logs)) for x in logs]
    return [w / sum(weights) for w in weights]


def test_bayes_equals_counting(spark, articles, bayes):
    texts = [r[1] for r in ROWS[:40]] + ["goal market", "never seen words", "the chip"]
    scored = scoring.batch_predict(spark, bayes, texts, keep_probabilities=True)
    for row in scored.collect():
        hand = by_hand(texts[row.position])
        assert np.allclose(row.probabilities, hand, atol=1e-9)
        assert row.predicted_id == hand.index(max(hand))
        assert len(row.all_scores) == 4


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_token_model_equals_counting(spark, articles, tmp_path, broadcast_rows):
    model = fit_token_model(with_tokens(articles), str(tmp_path / "fitted"))
    save_model(model, str(tmp_path / "saved"))
    model = load_token_model(spark, str(tmp_path / "saved"))
    texts = [r[1] for r in ROWS[:20]] + ["goal market", "never seen words", "goal goal"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "goal"), (None, "goal"), (5, "the chip"), (None, "")]
    df = with_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    found = model.transform(df, broadcast_rows).collect()
    assert sorted((str(r.doc_id), r.text) for r in found) == sorted((str(a), b) for a, b in rows)
    for row in found:
        assert np.allclose(row.probabilities, by_hand(row.text), atol=1e-9)


def test_a_fit_that_cannot_hold_every_token_fails(articles):
    with pytest.raises(ValueError, match="distinct tokens"):
        training.fit_naive_bayes(with_tokens(articles), max_tokens=5)


def test_unknown_words_fall_back_to_class_sizes(spark, bayes):
    assert scoring.predict(spark, bayes, "zzz")["predicted_label"] == "World"


def test_vocabulary_size_is_kept(articles):
    model = training.fit_naive_bayes(with_tokens(articles), vocabulary_size=7)
    counts = Counter(w for _, t, _ in ROWS for w in t.split())
    best = sorted(counts, key=lambda w: (-counts[w], w))[:7]
    assert set(model.stages[0].vocabulary) == set(best)
    with pytest.raises(ValueError, match="vocabulary_size"):
        training.fit_naive_bayes(with_tokens(articles), vocabulary_size=10**9)


def test_training_needs_every_class(articles):
    with pytest.raises(ValueError, match="every class"):
        training.fit_naive_bayes(with_tokens(articles.where("label < 3")))
    with pytest.raises(ValueError, match="no class"):
        training.fit_naive_bayes(with_tokens(articles.withColumn("label", F.col("label") + 1)))


def test_saved_model_scores_alike(spark, articles, bayes, tmp_path):
    path = str(tmp_path / "model")
    for _ in range(2):
        save_model(bayes, path)
    before = scoring.score(articles, bayes).orderBy("doc_id").collect()
    assert scoring.score(articles, load_model(path)).orderBy("doc_id").collect() == before


def test_no_model(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not exist|no such|path"):
        load_model(str(tmp_path / "none"))


@pytest.mark.parametrize("text", ["", "   \n\t  ", " "])
def test_blank_text_fails_the_call(spark, bayes, text):
    with pytest.raises(PySparkException, match="text is blank"):
        scoring.predict(spark, bayes, text)
    with pytest.raises(PySparkException, match="text is blank"):
        scoring.batch_predict(spark, bayes, ["goal", text]).collect()


def test_blank_rows_stay_out_of_tables(spark, bayes):
    df = spark.createDataFrame([(1, "goal"), (2, " "), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in scoring.score(df, bayes).collect()] == [1]
    assert scoring.score(df, bayes).columns == ["doc_id", "text", *scoring.PREDICTION_COLUMNS]
    with pytest.raises(ValueError, match="on_blank"):
        scoring.score(df, bayes, on_blank="skip")


def test_blank_rows_can_be_kept_aside(spark, bayes, tmp_path):
    df = spark.createDataFrame([(1, "goal"), (2, " "), (3, None)], "doc_id long, text string")
    kept = scoring.score(df, bayes, on_blank="keep")
    found = {r.doc_id: (r.predicted_label, r.confidence is None, r.reason) for r in kept.collect()}
    assert found[1][0] is not None and found[1][1:] == (False, None)
    assert found[2] == found[3] == (None, True, "text is blank")
    path = str(tmp_path / "log")
    prediction_log.append(prepare(kept, key="doc_id", text="text"), path, 1)
    rejected = prediction_log.read_rejected(spark, path).collect()
    assert {(r.id, r.reason) for r in rejected} == {(2, "text is blank"), (3, "text is blank")}
    assert [r.id for r in prediction_log.read_log(spark, path).collect()] == [1]


def test_prediction_contract(spark, bayes):
    result = scoring.predict(spark, bayes, "A late goal wins the match.")
    assert set(result) == {"predicted_label", "predicted_id", "confidence", "all_scores"}
    assert result["predicted_label"] == "Sports" and 0 <= result["confidence"] <= 1
    assert abs(sum(s["score"] for s in result["all_scores"]) - 1) < 1e-3


def test_raw_text_can_be_scored(spark, bayes):
    text = "<goal> <goal> <goal> market"
    assert scoring.predict(spark, bayes, text)["predicted_label"] == "Business"
    assert scoring.predict(spark, bayes, text, clean=False)["predicted_label"] == "Sports"


def test_logistic(spark, articles):
    model = training.fit_logistic(with_tokens(articles), num_features=1 << 10, max_iter=20)
    scored = scoring.score(articles, model, keep_probabilities=True)
    result = evaluate(scored).first()
    assert result.n == len(ROWS) and result.accuracy > 0.9 and result.log_loss < 0.5
    for row in scored.collect():
        assert abs(sum(row.probabilities) - 1) < 1e-9


def test_selection_keeps_the_first_best(articles):
    tokens = with_tokens(articles)
    train, check = tokens.where("doc_id % 4 <> 0"), tokens.where("doc_id % 4 = 0")
    grid = [(1, 0.5), (15, 0.01), (15, 0.01)]
    model, metrics = training.select_logistic(train, check, grid, num_features=1 << 10)
    top = max(m["accuracy"] for m in metrics)
    first = next(i for i, m in enumerate(metrics) if m["accuracy"] == top)
    assert [m["is_best"] for m in metrics] == [i == first for i in range(3)]
    scored = model.transform(check)
    assert scored.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] == top


def test_evaluation_by_hand(spark):
    rows = [(0, 0, [0.7, 0.3]), (1, 0, [0.6, 0.4]), (1, 1, [0.0, 1.0]), (0, 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "label int, predicted_id int, probabilities array<double>")
    result = evaluate(df).first()
    losses = [-math.log(0.7), -math.log(0.4), 0.0, -math.log(1e-15)]
    assert (result.n, result.accuracy) == (4, 0.5)
    assert result.log_loss == pytest.approx(sum(losses) / 4)


def test_worker_model_equals_columns(spark):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(4, 8)).tolist()
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 8)))]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    run = scoring.model_udf(scoring.linear_model(weights, 2.0), width=8, batch_rows=64)
    both = df.select(
        run("v").alias("a"),
        scores.softmax(scoring.linear_logits(F.col("v"), weights, 2.0)).alias("b"),
    )
    for a, b in both.collect():
        assert np.allclose(a, b, atol=1e-9)


def test_worker_model_that_cannot_load(spark):
    def load():
        raise RuntimeError("no model here")

    df = spark.createDataFrame([([1.0],)], "v array<float>")
    with pytest.raises(PySparkException, match="no model here"):
        df.select(scoring.model_udf(load, width=1)("v")).collect()


def test_bag_of_ids_skips_masked_ids(spark):
    weights = [[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]]
    df = spark.createDataFrame([([1, 2, 2], [1, 1, 0])], "ids array<int>, mask array<int>")
    run = scoring.model_udf(scoring.bag_of_ids_model(weights, [0.5, 0.0]), width=3, columns=2)
    z = np.exp([1.5, 2.0])
    assert np.allclose(df.select(run("ids", "mask")).first()[0], z / z.sum())


def test_class_counts_match_the_model(articles, bayes):
    tokens = with_tokens(articles)
    table = training.log_likelihoods(training.top_tokens(training.class_token_counts(tokens)))
    theta = bayes.stages[1].theta.toArray()
    place = {t: i for i, t in enumerate(bayes.stages[0].vocabulary)}
    rows = table.collect()
    assert len(rows) == 4 * len(place)
    for row in rows:
        assert row.log_prob == pytest.approx(theta[row.label, place[row.token]], abs=1e-9)
