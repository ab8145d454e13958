import numpy as np

from quillcast.llm import embedding_dedup
from quillcast.llm.embedding_dedup import audit_recall, near_vectors, pruned_graph, range_search


def brute(ids, x, least=0.95):
    ok = np.isfinite(x).all(1) & (np.abs(x).sum(1) > 0)
    u = np.zeros_like(x)
    u[ok] = x[ok] / np.linalg.norm(x[ok], axis=1, keepdims=True)
    link = (u @ u.T >= least) & ok[:, None] & ok[None, :]
    np.fill_diagonal(link, False)
    root = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(link)):
            low = min(root[ids[a]], root[ids[b]])
            if (root[ids[a]], root[ids[b]]) != (low, low):
                root[ids[a]] = root[ids[b]] = low
                changed = True
    return {i: (int(link[k].sum()), root[i]) for k, i in enumerate(ids)}


def planted(seed=0, groups=40, n=900, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for g in range(groups):
        at = rng.choice(n, rng.integers(2, 7), replace=False)
        x[at] = x[at[0]] + rng.normal(size=(len(at), d)) * 0.18 * rng.random()
    x[700:800] = x[5] + rng.normal(size=(100, d)) * 0.05
    x[800:830] = x[6]
    return x.astype(np.float32).astype(float)


def test_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MEMBERS", 150)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 120)
    x = planted()
    df = spark.createDataFrame([(i + 1000, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    want = brute([i + 1000 for i in range(len(x))], x)
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert set(got) == set(want)
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(got[i].n_links for i in want) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.97 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_audit(spark):
    x = planted(1, n=850)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert audit_recall(df, sample=400) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [0.0, 1.0], 0), (11, [5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (11, 4, 1, False), (None, 0, None, False), *[(i, 0, i, True) for i in range(4, 11)]], key=str)
    assert near_vectors(df.limit(0)).collect() == []


def grouped(sizes, lone, seed=3, d=32):
    """Vectors of groups of each size, then pairs of near vectors; and the group of each row."""
    rng = np.random.default_rng(seed)
    x = [c + rng.normal(size=(n, d)) * 0.03 for n, c in zip([*sizes, *[2] * lone], rng.normal(size=(len(sizes) + lone, d)))]
    return np.concatenate(x), np.repeat(np.arange(len(x)), list(map(len, x)))


def test_no_group_keeps_the_search_of_other_members():
    for size in (50, 60, 200, 600):
        x, group = grouped([size], 100)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sims = x @ x.T
        found = range_search(sims, pruned_graph(sims), 0.95)
        found |= found.T
        want = sims >= 0.95
        for g in range(group.max() + 1):
            assert found[group == g].sum() >= 0.9 * want[group == g].sum(), (size, g)


def test_recall_by_group_at_production_sizes(spark):
    for sizes in ([50, 100, 300], [5000, 1500, 60]):
        x, group = grouped(sizes, 150)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = (u @ u.T >= 0.95).sum(1) - 1
        got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
        links = np.array([got[i] for i in range(len(x))])
        assert (links <= want).all()
        share = np.bincount(group, links) / np.bincount(group, want)
        assert share.min() >= 0.9, share


def check_groups(spark, x, group, least_share=0.9):
    """Recall of links in each group, of rows with all their links, and of components, against brute force in blocks."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[at : at + 1000] @ u.T >= 0.95).sum(1) for at in range(0, len(u), 1000)]) - 1
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= want).all()
    total = np.bincount(group, want)
    share = np.bincount(group, links)[total > 0] / total[total > 0]
    assert share.min() >= least_share, share
    linked = want > 0
    assert (links[linked] >= 0.9 * want[linked]).mean() >= 0.9
    first = np.unique(group, return_index=True)[1]
    assert np.mean([got[i].component_id == first[group[i]] for i in np.flatnonzero(linked)]) >= 0.9


def test_clusters_beyond_the_pool(spark):
    x, group = grouped([60] * 8, 0)
    lone = np.random.default_rng(8).normal(size=(500, x.shape[1]))
    check_groups(spark, np.concatenate((x, lone)), np.concatenate((group, 8 + np.arange(500))))


def test_cells_are_split_again_and_again(spark, monkeypatch):
    for name, value in (("MEMBERS", 60), ("CENTRES", 4), ("BLOCK", 300)):
        monkeypatch.setattr(embedding_dedup, name, value)
    x, group = grouped([400, 90, 90, 30, 10], 200)
    same = np.random.default_rng(9).normal(size=x.shape[1]) * np.arange(1, 401)[:, None]  # one direction, many lengths
    check_groups(spark, np.concatenate((x, same)), np.concatenate((group, np.full(400, group.max() + 1))))


def test_audit_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (2, [0.0, 1.0]), (None, [1.0]), (3, None), (4, [])], "vec_id long, embedding array<float>")
    assert audit_recall(df) == 1.0 and audit_recall(df.limit(0)) == 1.0
