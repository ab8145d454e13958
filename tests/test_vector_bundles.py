import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quillcast.operators.ordering import shared_folder
from quillcast.operators.retrieval import knn
from quillcast.sources import VectorIndex
from quillcast.sources import vector_index as V


def rows_out_of_groups(spark, after):
    """Rows that left Python functions over co-groups, in the executions after so many."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions, found = store.executionsList(), []
    for i in range(after, executions.size()):
        number = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "FlatMapCoGroups" in node.name():
                metrics = [node.metrics().apply(j) for j in range(node.metrics().size())]
                found += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return found


def test_a_query_leaves_one_pool_in_a_bundle_however_many_cells_it_probes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, asked = VectorIndex(spark, f"{shared_folder(spark)}/dense-{uuid.uuid4().hex}").build(vectors, cells=30, parts=4), vectors.where("vec_id % 50 = 0")
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    found = index.search(asked, 3, 30, pool=40)
    assert found.count() == 18 * 3
    assert rows_out_of_groups(spark, before) == [18 * 40]


def test_cut_cells_bundles_and_blocks_give_the_exact_neighbours(spark, monkeypatch):
    for name, value in {"PART": 60, "LEAST": 20, "BLOCK": 7}.items():
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) if i % 3 else np.ones(6)).tolist()) for i in range(600)]  # a large cell of copies
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, asked = VectorIndex(spark, f"{shared_folder(spark)}/dense-{uuid.uuid4().hex}").build(vectors, cells=9, parts=3), vectors.where("vec_id % 20 = 1")
    found = {(r.q, r.d) for r in index.search(asked, 4, 9, pool=600).collect()}
    assert found == {(r.q, r.d) for r in knn(asked, vectors, "vec_id", "embedding", 4).collect()} and len(found) == 30 * 4


def test_pool_of_a_group_is_what_all_its_probed_rows_give(monkeypatch):
    monkeypatch.setattr(V, "PRODUCTS", 300)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6))
    x[40:60] = x[40]
    book = V.Codebook.fit(x, 5, 2)
    cell, code = book.encode(x)
    ids, probed = rng.permutation(1000)[:120], [[0, 2], [4], [1, 2, 3], [0, 1, 2, 3, 4]]
    left = pa.table({"q": ids[:4], "v": pa.array(list(x[:4]), pa.list_(pa.float64())), "cells": pa.array(probed, pa.list_(pa.int32()))})
    right = pa.table({"cell": pa.array(cell, pa.int32()), "id": ids, "code": pa.array([c.tobytes() for c in code], pa.binary())})
    found = V._pooled(left, right, book, 10).to_pylist()
    for i, own in enumerate(probed):
        near = (x[i] @ book.centroids.T)[cell] + sum(t[i, code[:, j]] for j, t in enumerate(book.tables(x[:4])))
        rows = sorted((-round(near[r], 9), ids[r], cell[r]) for r in range(120) if cell[r] in own and r != i)[:10]
        assert [(f["d"], f["cell"], round(f["near"], 9)) for f in found if f["q"] == ids[i]] == [(d, c, -s) for s, d, c in rows]


def test_bundles_are_a_few_of_bounded_size_and_hold_every_part_once(monkeypatch):
    monkeypatch.setattr(V, "LEAST", 10)
    cells = [SimpleNamespace(cell=c, rows=n, parts=-(-n // 50)) for c, n in enumerate([30, 170, 5, 5, 5, 48, 900])]
    placed = V._bundled(cells, 50)
    assert [(c, p) for c, p, _ in placed] == [(c.cell, p) for c in cells for p in range(c.parts)]
    sizes = {}
    for c, _, bundle in placed:
        sizes[bundle] = sizes.get(bundle, 0) + cells[c].rows / cells[c].parts
    assert max(sizes.values()) <= 50 and sorted(sizes) == list(range(len(sizes)))
    assert V._bundled([], 50) == []
    monkeypatch.undo()
    made = [V._bundled([SimpleNamespace(cell=c, rows=n, parts=1) for c in range(100)], V.MOST)[-1][2] + 1 for n in (100, 500, 6000)]
    assert made == [4, 4, 4]  # what leaves them grows with the queries alone
