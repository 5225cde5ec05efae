"""The search of one tile: the rows of the definition, in a fraction of its time."""

from time import process_time

import numpy as np
import pandas as pd

from rubrika.llm import permutation_index as index

TOP, WIDTH = 20, index.ORDER


def tile_rows(ids, name, vectors, pivots):
    orders = index._orders(vectors, pivots, 30.0, True).astype(np.uint16)
    packed = {"embedding": [v.tobytes() for v in vectors], "order": [o.tobytes() for o in orders]}
    return pd.DataFrame({name: ids} | packed), orders.astype(np.int64)


def defined(query, vector, asked, ids, x, order):
    """One query after the other: footrule, short list, exact rank."""
    place = np.full(index.PIVOTS, WIDTH)
    place[asked] = np.arange(WIDTH)
    cost = np.abs(place[:, None] - np.arange(WIDTH)) - (WIDTH - place[:, None])
    footrule = cost.ravel()[order * WIDTH + np.arange(WIDTH)].sum(1)
    keep = max(index.LEAST, TOP + 1, int(np.ceil(index.SHARE * len(ids))))
    best = np.flatnonzero(footrule <= np.sort(footrule)[min(keep, len(ids)) - 1])
    best = best[ids[best] != query]
    score = (x[best] * vector).sum(1)
    first = np.lexsort((ids[best], -score))[:TOP]
    return [(query, i, s) for i, s in zip(ids[best][first].tolist(), score[first].tolist())]


def test_a_tile_gives_the_rows_of_the_definition_in_less_time():
    rng = np.random.default_rng(3)
    pivots = rng.normal(size=(index.PIVOTS, 65))
    x = rng.normal(size=(4000, 64))
    x[1::500] = x[::500]  # equal vectors: equal scores, the smaller id first
    ids = rng.permutation(9000)[:4000]
    wanted = np.concatenate([ids[:100], np.arange(9000, 9401)])
    asked = np.concatenate([x[:100], rng.normal(size=(401, 64))])
    posted, order = tile_rows(ids, "vec_id", x, pivots)
    queries, orders = tile_rows(wanted, "query_id", asked, pivots)
    search = index._search(TOP)
    search(queries.head(3), posted)
    began = process_time()
    found = search(queries, posted)
    took = process_time() - began
    began = process_time()
    rows = [r for q, v, o in zip(wanted.tolist(), asked, orders) for r in defined(q, v, o, ids, x, order)]
    assert took < 0.5 * (process_time() - began)
    assert list(found.itertuples(index=False, name=None)) == rows


def test_products_that_are_not_finite_are_ranked():
    x = np.array([[1e200, 1e200], [1e200, -1e200], [1.0, 1.0], [-1e200, 1.0]])
    pivots = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
    posted, _ = tile_rows(np.arange(1, 5), "vec_id", x, pivots)
    queries, _ = tile_rows(np.array([9]), "query_id", np.array([[1e200, 1.0]]), pivots)
    found = index._search(TOP)(queries, posted)
    assert found["vec_id"].tolist() == [1, 2, 3, 4]
    assert found["score"].tolist() == [np.inf, np.inf, 1e200 + 1.0, -np.inf]
