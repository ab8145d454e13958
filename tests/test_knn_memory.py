import tracemalloc

import numpy as np
import pyarrow as pa

from quillcast.operators.retrieval import _nearest_of


def table(name, ids, x):
    return pa.table({name: pa.array(ids, pa.int64()), "v": pa.array(list(x), pa.list_(pa.float64()))})


def test_a_task_holds_the_products_of_a_few_queries():
    x = np.random.default_rng(1).normal(size=(20_000, 8))
    left, right = table("q", range(0, 20_000, 80), x[::80]), table("d", range(20_000), x)
    tracemalloc.start()
    found = _nearest_of(left, right, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 250 * 100 and peak < 50e6  # all products of 250 queries alone are 40 MB, sorted with their ids over 120


def test_ties_by_id_and_vectors_without_direction():
    x = np.array([[1.0, 0.0]] * 5 + [[0.0, 0.0], [0.0, 1.0], [np.nan, 1.0]])
    ids = [9, 3, 7, 1, 5, 2, 4, 6]
    found = _nearest_of(table("q", [9, 2], x[[0, 5]]), table("d", ids, x), 3)
    assert found.to_pydict() == {"q": [9] * 3, "d": [1, 3, 5], "s": [1.0] * 3}
    assert _nearest_of(table("q", [9], x[:1]), table("d", ids, x), 50).column("d").to_pylist() == [1, 3, 5, 7, 4]
