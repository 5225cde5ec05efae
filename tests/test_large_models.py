"""Models and vocabularies past what a driver may hold: joins that shuffle."""

import re
from collections import Counter
from math import exp, log

import pytest
from pyspark.sql import functions as F

from rubrika.operators import encoding
from rubrika.operators.token_model import FREQUENT_BYTES, fit_token_model
from rubrika.session import shared_folder
from tests.test_plans import plan

TEXTS = ["a a b", "a c d", "b e", "e f f", "a a a g h", "h i", "c b a", "d d"]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(i, t, i % 4) for i, t in enumerate(TEXTS)]
    return encoding.with_tokens(spark.createDataFrame(rows, "doc_id long, text string, label int"))


@pytest.mark.parametrize("broadcast_rows", [0, 1, 2, 4, 100])
def test_frequent_and_rare_tokens_add_up(spark, tokens, broadcast_rows):
    model = fit_token_model(tokens, shared_folder(spark, "token-model"), 4)
    counts = [Counter(w for t in TEXTS[c::4] for w in t.split()) for c in range(4)]
    known = set().union(*counts)
    texts = [*TEXTS, "a zz", "zz zz", "", None, "i i i a", "a zz"]
    df = spark.createDataFrame([(None if t is None else 7, t) for t in texts], "doc_id long, text string")
    found = model.transform(encoding.with_tokens(df), broadcast_rows).collect()
    assert Counter(r.text for r in found) == Counter(texts)
    for row in found:
        words = [w for w in (row.text or "").split() if w in known]
        z = [sum(log((n[w] + 1) / (sum(n.values()) + len(known))) for w in words) for n in counts]
        e = [exp(x - max(z)) for x in z]
        assert row.probabilities == pytest.approx([x / sum(e) for x in e], abs=1e-12)


def test_a_model_past_the_bound_is_not_broadcast(spark, tokens):
    """However few bytes its files have, only the frequent tokens go to every task."""
    model = fit_token_model(tokens, shared_folder(spark, "token-model"), 4)
    text = plan(model.transform(tokens.drop("label"), 2).select("doc_id", "probabilities"))
    tree = text.split("\n\n")[0]
    assert re.search(r"hashpartitioning\(token#\d+, salt#\d+", text) and "SortMergeJoin" in tree
    assert tree.count("Generate (") == 1  # of the texts; no copies of the model


def test_long_tokens_are_not_broadcast(spark):
    """Few tokens may take any number of bytes: those past the bound join by token, however frequent."""
    edge, past, wide = "y" * FREQUENT_BYTES, "z" * (FREQUENT_BYTES + 1), "語" * (FREQUENT_BYTES // 3 + 1)
    texts = [f"a {past} {past}", f"b {edge}", f"{wide} a {past}", f"c {wide}", f"a {past} {edge}"]
    rows = [(i, t, i % 4) for i, t in enumerate(texts)]
    tokens = encoding.with_tokens(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    model = fit_token_model(tokens, shared_folder(spark, "token-model"), 4)
    scored = model.transform(tokens)
    text = plan(scored.select("doc_id", "probabilities"))
    assert re.search(r"hashpartitioning\(token#\d+, salt#\d+", text)
    assert re.search(rf"octet_length\(token#\d+\) <= {FREQUENT_BYTES}\b", text)
    counts = [Counter(w for t in texts[c::4] for w in t.split()) for c in range(4)]
    known = len(set().union(*counts))
    found = {r.doc_id: r.probabilities for r in scored.collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        z = [
            log((len(texts[c::4]) + 1) / (len(texts) + 4))
            + sum(log((n[w] + 1) / (sum(n.values()) + known)) for w in t.split())
            for c, n in enumerate(counts)
        ]
        e = [exp(x - max(z)) for x in z]
        assert found[i] == pytest.approx([x / sum(e) for x in e], abs=1e-12)


def test_a_vocabulary_past_the_bound_is_not_broadcast(spark, tokens):
    words = spark.createDataFrame([("a", 4)], "token string, token_id int")
    text = plan(encoding.encode(tokens, words, broadcast_rows=0))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
