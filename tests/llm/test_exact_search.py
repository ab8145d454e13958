import duckdb
import numpy as np
import pytest

from quillcast.llm.exact_search import BallTree, Found, dot, search, top_k, whole_vectors
from quillcast.llm.queries import OP11_SQL, op11_exact_top_k


def plain(rows, k=5, scale=256):
    """rows (id, vector): every query against every row, in Python's integers."""
    real = [(i, [int(np.floor(float(c) * scale)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for n, (q, x) in enumerate(real):
        if q is None or q % 50:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), -(2**63) if i is None else i) for m, (i, y) in enumerate(real) if m != n)
        out += [(q, r + 1, None if i == -(2**63) else i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(spark, rows, schema="vec_id long, embedding array<double>", **sizes):
    v = whole_vectors(spark.createDataFrame(rows, schema), "vec_id", "embedding", 256)
    return sorted(map(tuple, top_k(v, v.where("id % 50 = 0"), **sizes).collect()), key=str)


def test_query_against_sql(spark, sf_dir):
    want = duckdb.sql(OP11_SQL.replace("FROM embeddings", f"FROM '{sf_dir}/embeddings.parquet'")).fetchall()
    assert sorted(map(tuple, op11_exact_top_k(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


@pytest.mark.parametrize("shard, block, leaf", [(4096, 4096, 64), (70, 3, 4), (10, 100, 1)])
def test_clusters_copies_and_ties_against_brute_force(spark, shard, block, leaf):
    rng = np.random.default_rng(shard)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.1, 5)).tolist()) for i in range(300)]
    rows += [(i, centres[0].tolist()) for i in range(300, 500)]  # one vector that many rows hold
    rows += [(i, (centres[1] / 8).round(1).tolist()) for i in range(500, 560)]
    assert found(spark, rows, shard=shard, block=block, leaf=leaf) == plain(rows)


def test_branch_and_bound_reads_few_leaves_of_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(5)
    points = np.floor(256 * (10 * rng.normal(size=(40, 8))[np.arange(4000) % 40] + rng.normal(0, 0.05, (4000, 8)))).astype(np.int64)
    ids = np.arange(4000)
    tree, best, read = BallTree.build(ids, ids, points, 64), Found(4, 5), []
    monkeypatch.setattr("quillcast.llm.exact_search.dot", lambda a, b: read.append(len(a) * len(b)) or dot(a, b))
    search(tree, ids[:4], points[:4], best)
    for q in range(4):
        scores = points @ points[q]
        scores[q] = -(2**62)
        assert best.ids[best.q == q].tolist() == np.lexsort((ids, -scores))[:5].tolist()
    assert sum(read) < 4 * 4000 / 8


def test_what_is_found_before_closes_nodes(monkeypatch):
    rng = np.random.default_rng(6)
    points, ids = rng.integers(-256, 256, (2000, 16)), np.arange(2000)
    tree, calls = BallTree.build(ids, ids, points, 16), []
    monkeypatch.setattr("quillcast.llm.exact_search.dot", lambda a, b: calls.append(1) or dot(a, b))
    known = Found(1, 2)
    known.add(np.zeros(2, int), np.array([-1, -2]), np.array([-1, -2]), np.full(2, 2**40))
    search(tree, np.array([-9]), points[:1], known)
    assert not calls and known.ids.tolist() == [-2, -1]


def test_products_beyond_doubles_are_exact_and_end_at_a_long():
    a = np.array([[2**40 + 1, 1]], np.int64)
    assert dot(a, a).tolist() == [[2**63 - 1]] and dot(np.array([[2**30 + 1]]), np.array([[2**30 + 3]])).tolist() == [[(2**30 + 1) * (2**30 + 3)]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (50, [1.0]), (None, [1.0, 2.0]), (None, [3.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (100, []), (6, [0.0, 0.0]), (150, None), (200, [2.0**30, 2.0**30])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []
    wild = whole_vectors(spark.createDataFrame([(0, [1e300], 7), (50, [-1e300], 7)], "vec_id long, embedding array<double>, row int"), "vec_id", "embedding", 256)
    assert sorted(r.score for r in top_k(wild, wild).collect()) == [-(2**63)] * 2
