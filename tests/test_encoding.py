import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from rubrika.operators import encoding

random.seed(5)
WORDS = [f"w{i}" for i in range(60)]
TEXTS = [" ".join(random.choices(WORDS, weights=range(60, 0, -1), k=k)) for k in (0, 1, 5, 126, 127, 400)]
TEXTS += ["w0 " * 300, "unseenword w1", "", None]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return encoding.with_tokens(df)


@pytest.fixture(scope="module")
def vocabulary(docs, spark):
    size = 40
    built = encoding.build_vocabulary(encoding.token_counts(docs), size)
    return spark.createDataFrame(built.collect(), built.schema)


def test_vocabulary(vocabulary):
    counts = Counter(w for t in TEXTS if t for w in t.split())
    best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:36]
    assert [(r.token, r.token_id, r.n) for r in vocabulary.orderBy("token_id").collect()] == [
        (w, i + 4, n) for i, (w, n) in enumerate(best)
    ]


def expected(ids, text, length=128, pad=True):
    inner = [ids.get(w, 1) for w in (text or "").split()][: length - 2]
    full = [2, *inner, 3]
    mask = [1] * len(full)
    return (full + [0] * (length - len(full)), mask + [0] * (length - len(full))) if pad else (full, mask)


@pytest.mark.parametrize("pad", [True, False])
@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_encode(docs, vocabulary, pad, broadcast_rows):
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    rows = encoding.encode(docs, vocabulary, pad=pad, broadcast_rows=broadcast_rows).collect()
    assert {r.doc_id: (r.input_ids, r.attention_mask) for r in rows} == {
        i: expected(ids, t, pad=pad) for i, t in enumerate(TEXTS)
    }


def test_a_repeated_key_fails(spark, vocabulary):
    df = spark.createDataFrame([(1, "w0 " * 100), (1, "w1 " * 100)], "doc_id long, text string")
    with pytest.raises(PySparkException, match="doc_id is not unique: 1"):
        encoding.encode(encoding.with_tokens(df), vocabulary).collect()


def test_short_length(docs, vocabulary):
    rows = encoding.encode(docs, vocabulary, max_length=5).collect()
    assert {len(r.input_ids) for r in rows} == {len(r.attention_mask) for r in rows} == {5}
    assert all(r.input_ids[0] == 2 and 3 in r.input_ids for r in rows)


@pytest.mark.parametrize("texts", [("a b", "c d"), ("", ""), ("", "a"), (None, "a")])
def test_short_repeated_keys_fail(spark, vocabulary, texts):
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    with pytest.raises(PySparkException, match="doc_id is not unique: 1"):
        encoding.encode(encoding.with_tokens(df), vocabulary).collect()


def test_null_keys_fail(spark, vocabulary):
    df = spark.createDataFrame([(None, "a b"), (2, "c")], "doc_id long, text string")
    with pytest.raises(PySparkException, match="doc_id is null"):
        encoding.encode(encoding.with_tokens(df), vocabulary).collect()


def test_labels_are_passed_on(spark, vocabulary):
    df = spark.createDataFrame([(1, "w0 w1", 3), (2, "", 0), (3, "w2", None)], "doc_id long, text string, label int")
    rows = encoding.encode(encoding.with_tokens(df), vocabulary, carry=("label",)).collect()
    assert {r["doc_id"]: r["label"] for r in rows} == {1: 3, 2: 0, 3: None}
