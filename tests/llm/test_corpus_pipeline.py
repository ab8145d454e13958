"""Each stage against a plain version of its decision, on what the stage before it kept."""

import corpus_pipeline as pipeline
from quillcast.llm.decontaminate import find_contamination
from quillcast.llm.toxicity import train

from .test_line_dedup import plain
from .test_mixing import plain_targets
from .test_simhash_dedup import plain_similar


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
        if name != "mixing":
            assert docs.columns == columns
    start, clean, lined, single, safe, mixed = seen

    machine = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = machine.scores([machine.features(r.text or "") for r in start])
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r, s in zip(start, scores) if s < 0.5)

    expected = plain([(r.doc_id, r.text) for r in clean])
    assert {r.doc_id: (r.text, r.n_chars) for r in lined} == {i: (t, len(t)) for i, (_, _, t) in expected.items()}

    roots, pairs = plain_similar([(r.doc_id, r.text) for r in lined], pipeline.WORDS, pipeline.SHARE)
    left = {r.doc_id for r in single}
    assert all(any(roots[j] == roots[i] and j < i for j in left) for i in roots if i not in left)
    assert sum(a not in left or b not in left for a, b in pairs) >= 0.9 * len(pairs) > 0

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = {r.doc_id for r in find_contamination(spark.createDataFrame(single), benchmark).collect()}
    assert sorted(r.doc_id for r in safe) == sorted(r.doc_id for r in single if r.doc_id not in held)
    norm = lambda t: " ".join(t.split())
    passages = [norm(r.text) for r in benchmark.collect()]
    assert not any(p in norm(r.text) for r in safe for p in passages)

    sizes = {}
    for r in mixed:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = plain_targets(sizes)
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in safe)
    for s in sizes:
        assert sum(r.taken for r in mixed if r.source == s) == int(targets[s] + 1e-6)
    assert len(pipeline.run(spark, sf_dir).collect()) == len(mixed)


def test_empty_and_null_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "a", 0), (2, None, "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()), key=str) == [1, None]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_of_any_name(spark, tmp_path):
    names = ["kept", "k", "t", "lost", "fp", "rep", "wide", "component_id", "doc", "row", "score", "item_id", "n_lines", "__held", "size", "target"]
    line = "a line that several of the documents have in common"
    rows = [(i, f"{line}\nand one of its own, number {i} of all: {'w%d ' % i * 9}", "en", "a", 0, *range(len(names))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some question that none of these documents holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert {r.doc_id: tuple(r[n] for n in names) for r in got.collect()} == {i: tuple(range(len(names))) for i in range(5)}, name
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == set(range(5))
