import random

import numpy as np
import pytest

from quillcast.llm import toxicity
from quillcast.llm.queries import op3_toxicity
from quillcast.llm.toxicity import _margin, drop_toxic, fit, text_terms, toxicity_scores, train


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    x, w, v = rng.integers(0, 2, (6, 5)).astype(float), rng.normal(size=5), rng.normal(size=(5, 3))
    plain = [0.3 + sum(w[i] * r[i] for i in range(5)) + sum(v[i] @ v[j] * r[i] * r[j] for i in range(5) for j in range(i)) for r in x]
    assert np.allclose(_margin(x, 0.3, w, v), plain)


def test_learns_an_interaction():
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 50, float)
    y = (x.sum(1) == 2).astype(float)
    machine = fit(np.arange(2), x, y, steps=400)
    assert ((machine.scores([set(np.flatnonzero(r)) for r in x]) >= 0.5) == y).all()


def pair_texts(seed, n):
    """Texts of which those are toxic that hold an insult and a group's mention: two insults, or two groups, are not."""
    rng = random.Random(seed)
    words, insults, groups = [f"w{i}" for i in range(400)], [f"insult{c}" for c in "abcd"], [f"group{c}" for c in "abcd"]
    rows = []
    for i in range(n):
        own = rng.choice([[], rng.sample(insults, 1), rng.sample(insults, 2), rng.sample(groups, 1), rng.sample(groups, 2), *[[rng.choice(insults), rng.choice(groups)]] * 3])
        text = rng.choices(words, k=rng.randint(20, 60)) + own
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(len({w[:5] for w in own}) == 2)))
    return rows


def test_a_pair_alone_is_learnt_from_whole_texts(spark):
    rows = pair_texts(1, 3000)
    machine = train(spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    new = pair_texts(2, 1000)
    y = np.array([r[2] for r in new])
    found = [machine.features(r[1]) for r in new]
    got = machine.scores(found) >= 0.5
    assert (got == y).mean() > 0.95
    machine.factors = machine.factors * 0
    alone = machine.scores(found) >= 0.5
    assert (alone != got).mean() > 0.1 and (alone == y).mean() < 0.9


def test_factors_decide_on_the_labelled_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    found = [machine.features(r.text or "") for r in docs.select("text").collect()]
    scores = machine.scores(found)
    machine.factors = machine.factors * 0
    assert ((scores >= 0.5) != (machine.scores(found) >= 0.5)).any()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op3_toxicity(spark, sf).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_rows_of_one_id_and_long_texts_stay_within_the_bounds(spark, monkeypatch):
    held = []
    monkeypatch.setattr(toxicity, "fit", lambda terms, x, y: held.append((len(y), len(x.cols))) or fit(terms, x, y, steps=1))
    docs = spark.range(100_000).selectExpr("0L AS doc_id", "concat('vile w', id % 50) AS text")
    docs = docs.unionByName(spark.range(1, 200).selectExpr("id AS doc_id", "concat('plain ', array_join(transform(sequence(1, 300), x -> concat('t', x)), ' ')) AS text"))
    labels = spark.range(200).selectExpr("id AS doc_id", "int(id = 0) AS toxic")
    train(docs, labels, folds=10**9)
    rows, size = held[-1]
    assert rows == 200 and size >= 199 * 301
    train(docs, labels, folds=10**9, size=5_000)
    assert 0 < held[-1][0] < 200 and held[-1][1] <= 5_000
    train(docs, labels, folds=10**9, rows=10)
    assert held[-1][0] == 10


def test_rows_of_one_id_count_as_one(spark):
    rows = pair_texts(3, 300)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    whole = train(spark.createDataFrame(rows, "doc_id long, text string, y int"), labels)
    parts = [(i, part, y) for i, t, y in rows for part in (t[: t.index(" ")], t[t.index(" ") :], t)]
    split = train(spark.createDataFrame(parts, "doc_id long, text string, y int"), labels)
    assert (whole.terms == split.terms).all() and whole.bias == split.bias and (whole.weights == split.weights).all() and (whole.factors == split.factors).all()


def test_odd_rows(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=20)) + (" vile" if i % 3 == 0 else ""), 0) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)] + [(None, 1, 1), (1, None, 1), (5, 1, 0), (5, 0, 0)], "doc_id long, toxic int, text int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    machine = train(docs, labels)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "VILE!", 1), (3, "vile " + "x " * 100_000, 1)], docs.schema)
    got = sorted(((r.doc_id, r.predicted) for r in toxicity_scores(odd, machine).collect()), key=str)
    assert got == sorted([(None, 0), (1, 0), (1, 0), (2, 1), (3, 1)], key=str)
    assert sorted((r.doc_id for r in drop_toxic(odd, machine).collect()), key=str) == [1, 1, None]
    assert drop_toxic(odd, machine).columns == odd.columns
    assert toxicity_scores(docs.limit(0), machine).collect() == []
    prior = train(docs, labels.limit(0))
    assert toxicity_scores(odd, prior).first().score == pytest.approx(0.1)
    assert text_terms("") == set() and len(text_terms("idiots idiot!")) >= 2
