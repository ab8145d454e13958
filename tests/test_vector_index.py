import uuid

import numpy as np
import pytest

from quillcast import plans
from quillcast.operators.ordering import shared_folder
from quillcast.operators.retrieval import knn
from quillcast.sources import VectorIndex
from quillcast.sources import vector_index as V


def made(spark, rows, schema="vec_id long, embedding array<double>", **sizes):
    return VectorIndex(spark, f"{shared_folder(spark)}/dense-{uuid.uuid4().hex}").build(spark.createDataFrame(rows, schema), **sizes)


def test_query_finds_nine_of_ten_true_neighbours(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = plans.QUERIES["r6_stored_dense_top_k"](spark, sf_dir).cache()
    exact = knn(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 10).cache()
    assert found.count() == exact.count() == found.dropDuplicates(["q", "rank"]).count() and V.recall(found, exact) >= 0.9
    # what is found has its exact cosine
    assert {(r.q, r.d, round(r.s, 5)) for r in found.collect()} <= {(r.q, r.d, round(r.s, 5)) for r in knn(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 500).collect()}


def test_few_cells_serve_clustered_vectors_and_only_their_folders_are_read(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 40)  # the largest cells are searched in parts
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[0 if i % 3 else i % 12] + rng.normal(0, 0.1, 8)).tolist()) for i in range(900)]
    index = made(spark, rows, cells=12, parts=4)
    asked = spark.createDataFrame([r for r in rows if r[0] % 90 == 0], "vec_id long, embedding array<double>")
    exact = knn(asked, spark.createDataFrame(rows, asked.schema), "vec_id", "embedding", 5)
    probes = index.probes_for(asked, 5, 0.95)
    assert probes <= 6 and V.recall(index.search(asked, 5, probes), exact) >= 0.9
    assert V.recall(index.search(asked, 5, 12, pool=900), exact) == 1
    one = index.search(asked.limit(1), 5, 1)
    folders = {f.split("cell=")[1].split("/")[0] for f in spark.read.parquet(f"{index.path}/codes").inputFiles()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert len(folders) > 6 and plan.count("PartitionFilters: [cell") + plan.count("PartitionFilters: [isnotnull(cell") + plan.count("PartitionFilters: [(cell") >= 1


def test_codes_rank_nearly_as_vectors_do():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = V.Codebook.fit(x, 4, 8)
    cell, code = book.encode(x)
    near = (x[:20] @ book.centroids.T)[:, cell] + sum(t[:, code[:, i]] for i, t in enumerate(book.tables(x[:20])))
    assert np.corrcoef(near.ravel(), (x[:20] @ x.T).ravel())[0, 1] > 0.97


@pytest.mark.parametrize("cells", [1, 5])
def test_odd_rows(spark, cells):
    nan = float("nan")
    rows = [(i, [float(i), 1.0], 0) for i in range(1, 9)] + [(20, [8.0, 1.0], 0), (21, None, 0), (22, [0.0, 0.0], 0), (23, [nan, 1.0], 0), (24, [1.0, None], 0), (None, [1.0, 1.0], 0)]
    index = made(spark, rows, "vec_id long, embedding array<double>, cell int", cells=cells, parts=2)
    asked = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    found = index.search(asked, 3, cells).collect()
    assert {r.q for r in found} == {*range(1, 9), 20} and all(r.q != r.d for r in found)
    assert [(r.d, r.s) for r in sorted(found, key=lambda r: r["rank"]) if r.q == 20][0] == (8, 1.0)
    assert made(spark, [], "vec_id long, embedding array<double>").search(asked, 3, 1).collect() == []
