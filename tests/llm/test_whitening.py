import numpy as np
import pytest

from quillcast.llm.exact_search import whole_vectors
from quillcast.llm.queries import op13_embedding_whitening
from quillcast.llm.whitening import covariance, moments, whiten


def plain(vectors, components=8):
    """Python's integers up to the centred rows, then one matrix."""
    x = [[int(np.floor(float(c) * 1024)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [[n * c - s for c, s in zip(v, sums)] for v in x]
    y = np.array([[c / n for c in v] for v in exact])
    e, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e, kind="stable")[:components]
    return [sum(c * c for c in v) for v in exact], y @ axes[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def check(rows, want):
    deviation, whitened, explained = want
    rows = sorted(rows, key=lambda r: (r.vec_id, r.component))
    k = whitened.shape[1]
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    assert [r.component for r in rows] == list(range(1, k + 1)) * len(deviation) and {r.n for r in rows} == {len(deviation)}
    assert [r.deviation for r in rows[::k]] == deviation
    assert np.allclose(got * np.sign((got * whitened).sum(0)), whitened, rtol=0, atol=1e-9)
    assert np.allclose([r.explained for r in rows[:k]], explained, rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query_against_one_matrix(spark, sf_dir):
    table = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    check(op13_embedding_whitening(spark, sf_dir).collect(), plain([r.embedding for r in table]))


@pytest.mark.parametrize("wide, tile", [(5, 2), (6, 2), (7, 32), (3, 1), (12, 5)])
def test_tiles_of_any_size(spark, wide, tile, monkeypatch):
    monkeypatch.setattr("quillcast.llm.whitening.ROWS", 40)
    rng = np.random.default_rng(wide)
    v = rng.normal(size=(150, wide)) @ rng.normal(size=(wide, wide)) + 1000
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(3)
    check(whiten(whole_vectors(df, "vec_id", "embedding", 1024, 100_000), 8, tile).collect(), plain(v.tolist()))


def test_a_great_common_offset_costs_no_digits(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 100, (500, 4))
    df = spark.createDataFrame([((v + 2**50).tolist(),) for v in x], "x array<long>")
    n, sums = moments(df, "x", 4)
    assert (n, sums) == (500, (x.sum(0) + 500 * 2**50).tolist())
    assert np.allclose(covariance(df, "x", 4, n, sums, tile=3), np.cov(x.T, bias=True), rtol=1e-12)


def test_exact_sums_beyond_a_long(spark):
    df = spark.createDataFrame([([2**62, -(2**62)],)] * 5, "x array<long>")
    assert moments(df, "x", 2) == (5, [5 * 2**62, -5 * 2**62])


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0], 9), (1, [1.0, 2.0], 9), (None, [3.0, 1.0], 9), (2, [0.0, 5.0], 9), (3, None, 9), (4, [1.0, None], 9), (5, [nan, 1.0], 9), (6, [1.0], 9), (7, [], 9), (8, [1e300, 0.5], 9)]
    df = spark.createDataFrame(rows[:-1], "vec_id long, embedding array<double>, component int")
    whole = lambda d: whole_vectors(d, "vec_id", "embedding", 1024, 100_000)
    got = whiten(whole(df)).collect()
    assert sorted((r.vec_id, r.component) for r in got if r.vec_id) == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)] and len(got) == 8 and {r.n for r in got} == {4}
    far = whiten(whole(spark.createDataFrame(rows, df.schema))).collect()
    assert len(far) == 10 and all(r.deviation is None for r in far)
    alike = whiten(whole(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in alike} == {(0, 0.0, 0.0, 0.0)}
    assert [(r.component, r.whitened) for r in whiten(whole(df.where("vec_id = 6"))).collect()] == [(1, 0.0)]
    for none in (df.limit(0), df.where("vec_id = 7")):
        assert whiten(whole(none)).collect() == [] and whiten(whole(none)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
