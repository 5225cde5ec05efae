"""The exact largest rows beside a whole sort."""

import numpy as np
import pytest

from rubrika.operators import selection

LETTERS = list("abcé漢😀")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(LETTERS, int(rng.integers(0, 7)))) for _ in range(3000)})
    kinds = rng.integers(0, 4, len(words))
    counts = [
        int({0: 1, 1: rng.integers(1, 4), 2: rng.integers(1, 9000), 3: rng.integers(2**40, 2**40 + 10**7)}[k])
        for k in kinds.tolist()
    ]
    return list(zip(words, counts))


@pytest.mark.parametrize("size", [1, 2, 57, 400, 700, 900, 1200, 1700, 10_000])
def test_largest_beside_a_sort(spark, rows, size):
    table = spark.createDataFrame(rows, "token string, n long").repartition(5)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:size]
    found = [tuple(r) for r in selection.largest(table, size).collect()]
    assert sorted(found) == sorted(want)


def test_ties_are_cut_letter_by_letter(spark, rows):
    tokens = [token for token, _ in rows]
    table = spark.createDataFrame([(t,) for t in tokens], "token string").repartition(3)
    for place in (1, 2, 100, len(tokens) - 1, len(tokens)):
        for ordered in (1, 5, 10**6):
            assert selection.smallest_token(table, place, ordered) == tokens[place - 1]


def test_large_counts_need_a_second_histogram(spark):
    table = spark.createDataFrame([(str(k), 2**50 + k) for k in range(300)], "token string, n long")
    assert selection.border(table, 10) == (2**50 + 290, 9)
    assert selection.border(table, 300) == (2**50, 299) and selection.border(table, 301) is None
    assert selection.largest(table.where("n < 0"), 3).count() == 0
