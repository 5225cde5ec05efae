"""Sketches in the n-gram join: no pair of unlike sets becomes a row, and no link is refused."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrika.llm import ngram_join


def _words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("n", [60, 1500])
def test_unlike_sets_with_a_common_passage_make_no_pairs(spark, n):
    """Each of 30 documents shares one passage of six words; the first two are near copies beside it."""
    passage = "one two three four five six".split()
    texts = [_words(i, n) + passage for i in range(30)]
    texts[1] = [*texts[0][:10], "changed", *texts[0][11:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = ngram_join.stored(ngram_join.shingle_sets(docs), "sets")
    lists = ngram_join.shared_lists(sets, 0).withColumn("component", F.col("node"))
    pairs = ngram_join.remaining_pairs(lists.join(ngram_join.sketches(sets, 0), ["node", "class"])).collect()
    nodes = {r.node: r.doc_id for r in sets.select("node", "doc_id").collect()}
    assert {frozenset((nodes[r.a], nodes[r.b])) for r in pairs} == {frozenset((0, 1))}
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {i: 0 if i == 1 else i for i in range(30)}


@pytest.mark.parametrize("n", [40, 700, 899, 900, 1000, 1199, 1201, 2500])
def test_linked_sets_meet_in_a_list_and_pass_their_sketches(n):
    """As far from each other as a link allows, of equal and of different sizes."""
    rng = np.random.default_rng(n)
    for m in {n, (3 * n + 3) // 4, (7 * n + 7) // 8}:
        both = max(ngram_join.overlap(n, m), (3 * n + 3) // 4 if m < n * 0.8 else 0)
        h = np.unique(rng.integers(0, 1 << 46, 2 * n + m, dtype=np.uint64))
        rng.shuffle(h)
        rank = dict(zip(h.tolist(), rng.permutation(len(h)).tolist()))  # the common order
        a, b = h[:n], np.concatenate([h[:both], h[n : n + m - both]])
        a, b = (np.array(sorted(x.tolist(), key=rank.get), np.uint64) for x in (a, b))
        assert 100 * both >= 75 * (len(a) + len(b) - both)
        met = False
        theirs = dict(ngram_join.parts(b))
        for kind, left in ngram_join.parts(a):
            right = theirs.get(kind, left[:0])
            turned = ngram_join.sketch(left) ^ ngram_join.sketch(right)
            turned = int(np.bitwise_count(turned.view(np.uint64)).sum())
            assert turned <= len(np.setxor1d(left, right))
            if not len(right) or 7 * turned > len(left) + len(right):
                continue
            places = {x: r for x, r in zip(right.tolist(), ngram_join.reaches(len(right)).tolist())}
            for x, reach in zip(left.tolist(), ngram_join.reaches(len(left)).tolist()):
                met = met or (x in places and len(left) <= places[x] and len(right) <= reach)
        assert met
