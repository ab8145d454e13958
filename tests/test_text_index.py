import random
import uuid

import pytest

from quillcast.operators.ordering import shared_folder
from quillcast.sources import TextIndex


def folder(spark):
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def table(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id long, text string")


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "id long")


def scan(docs, questions):
    """Every document against every question: those that hold all words, and how often each holds them in a row."""
    every, rows = set(), {}
    for q, text in questions.items():
        asked = text.lower().split()
        for i, held in docs.items():
            words = (held or "").lower().split()
            if asked and set(asked) <= set(words):
                every.add((q, i))
            n = sum(words[at : at + len(asked)] == asked for at in range(len(words) - len(asked) + 1)) if asked else 0
            if n:
                rows[q, i] = n
    return every, rows


def answers(index, asked):
    return {tuple(r) for r in index.all_of(asked).collect()}, {(r.q, r.id): r["count"] for r in index.phrase(asked).collect()}


def test_three_rounds_of_changes_equal_a_scan(spark):
    rng = random.Random(11)
    words = ["the"] * 12 + list("abcdefghij") + ["ab", "The"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
    docs = {i: text() for i in range(120)}
    questions = {q: " ".join(rng.choice(words) for _ in range(1 + q % 4)) for q in range(30)} | {90: "the the", 91: "absent", 92: "", 93: "the absent", 94: " A\tb\n"}
    asked = spark.createDataFrame(list(questions.items()), "q long, text string")
    index = TextIndex(spark, folder(spark), span=16, buckets=4)
    index.insert(table(spark, docs))
    for round_ in range(3):
        gone = rng.sample(sorted(docs), 15)
        index.delete(ids(spark, [*gone, 10_000]))
        docs = {i: t for i, t in docs.items() if i not in gone}
        new = {i: text() for i in rng.sample(sorted(docs), 10) + gone[:5] + [200 + 10 * round_ + k for k in range(10)]}
        index.insert(table(spark, new))
        docs |= new
        if round_:
            index.merge(2 if round_ == 1 else 1)
        assert answers(index, asked) == scan(docs, questions)
        assert {r.id for r in index.documents().collect()} == set(docs)
    assert len(index.parts()) == 1 and index.parts()[0].documents == len(docs)
    known = {t: sum(t in (d or "").lower().split() for d in docs.values()) for t in ("the", "a", "ab")}
    assert {r.term: r.df for r in index.counts(spark.createDataFrame([(1, t) for t in known], "q int, term string")).collect()} == known


def test_a_change_that_broke_off_leaves_no_trace_and_readers_keep_their_state(spark, monkeypatch):
    index = TextIndex(spark, folder(spark))
    index.insert(table(spark, {1: "one word", 2: "two words"}))
    asked = spark.createDataFrame([(1, "word"), (2, "words")], "q long, text string")
    reader = TextIndex(spark, index.path)
    assert {tuple(r) for r in reader.all_of(asked).collect()} == {(1, 1), (2, 2)}

    def broken(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(TextIndex, "_commit", broken)
        with pytest.raises(OSError):
            index.insert(table(spark, {1: "words", 3: "word"}))
        with pytest.raises(OSError):
            index.delete(ids(spark, [1]))
    assert {tuple(r) for r in index.refresh().all_of(asked).collect()} == {(1, 1), (2, 2)}
    index.insert(table(spark, {1: "words", 3: "word"}))
    assert {tuple(r) for r in reader.all_of(asked).collect()} == {(1, 1), (2, 2)}
    assert {tuple(r) for r in reader.refresh().all_of(asked).collect()} == {(2, 1), (1, 3), (2, 2)}


def test_odd_documents_and_empty_changes(spark):
    index = TextIndex(spark, folder(spark))
    asked = spark.createDataFrame([(1, "a")], "q long, text string")
    assert index.all_of(asked).collect() == [] and index.ranked(asked, 3).collect() == []
    index.delete(ids(spark, [4]))
    index.insert(spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a b"), (4, "a " * 50_000)], "id long, text string"))
    index.insert(spark.createDataFrame([], "id long, text string"))
    assert {(r.id, r.length) for r in index.documents().collect()} == {(1, 0), (2, 0), (3, 2), (4, 50_000)}
    assert {(r.id, r["count"]) for r in index.phrase(asked).collect()} == {(3, 1), (4, 50_000)}
    index.delete(ids(spark, [1, 2, 3, 4]))
    index.merge()
    assert index.all_of(asked).collect() == [] and index.documents().collect() == []


def test_only_folders_of_asked_terms_are_read(spark):
    index = TextIndex(spark, folder(spark), buckets=16)
    index.insert(table(spark, {i: f"w{i} w{i + 1}" for i in range(100)}))
    blocks = index._asked(spark.createDataFrame([(1, "w5")], "q int, term string"), ["term", "n"])
    assert {r.term for r in blocks.collect()} == {"w5"}
    files = lambda df: {f.split("bucket=")[1].split("/")[0] for f in df.inputFiles()}
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert len(files(spark.read.parquet(f"{index.path}/postings/{index.parts()[0].folder}"))) == 16
    assert "docs" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_ranked_equals_scores_of_all_documents(spark):
    from quillcast.functions.text import words
    from quillcast.operators.retrieval import bm25
    from pyspark.sql import functions as F

    rng = random.Random(4)
    # topics of their own words, so that ranges differ and most need not be opened
    docs = {i: " ".join(rng.choice(["the", f"t{i % 9}", f"u{i % 31}", f"r{i}"]) for _ in range(rng.randrange(1, 30))) for i in range(300)}
    asked = spark.createDataFrame([(q, f"the t{q % 9} u{q} r{q} r{q}") for q in range(12)], "q long, text string")
    index = TextIndex(spark, folder(spark), span=20, buckets=4)
    index.insert(table(spark, docs))
    plain = bm25(spark.createDataFrame(list(docs.items()), "doc long, text string").select("doc", words(F.lower("text")).alias("terms")), asked.select("q", words(F.lower("text")).alias("terms")), "q", 5)
    want = {(r.q, r["rank"], r.doc, round(r.score, 5)) for r in plain.collect()}
    for first in (1, 4, 1000):
        assert {(r.q, r["rank"], r.id, round(r.score, 5)) for r in index.ranked(asked, 5, first=first).collect()} == want
