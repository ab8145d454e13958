import hashlib
from collections import defaultdict

import numpy as np

from quillcast.llm import line_dedup
from quillcast.llm.perfect_hash import MinimalPerfectHash
from quillcast.llm.queries import op1_line_dedup


def plain(rows, min_docs=3, min_chars=20):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
        return k if len(k) >= min_chars else None

    held = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            held[k].append(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if keeper.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_perfect_hash_is_minimal_and_survives_bytes():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    mph = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
    assert len(mph) == len(keys)
    assert sorted(mph.lookup(keys)) == list(range(len(keys)))
    assert len(MinimalPerfectHash.build(keys[:0])) == 0


def test_documents_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in plain(rows).items()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op1_line_dedup(spark, sf_dir).collect()}
    assert got == expected
    assert sum(d for _, d, _ in got.values()) > 0


def test_shared_lines_hot_and_cold(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 8)
    common, rare = "a line that every document repeats", "  A RARE line of some documents\t"
    rows = [(i, "\n".join([common, f"own line of the document number {i}", *([rare] if i % 10 == 0 else [rare.lower()] if i % 15 == 0 else []), "short", common.upper()])) for i in range(60)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)


def test_odd_rows(spark):
    line = "x" * 20
    rows = [(1, None, "a"), (2, "", "b"), (None, line, "c"), (3, line, "d"), (5, f"{line}\n\n{line}", "e"), (5, f"{line}\n\n{line}", "e"), (6, "é" * 19, "f"), (7, "y\n" * 100_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, len(r.kept), r.h1) for r in line_dedup.dedup_lines(docs, keep=("h1",)).collect()), key=str)
    assert got == sorted([(1, 1, 0, 0, "a"), (2, 1, 0, 0, "b"), (None, 1, 1, 0, "c"), (3, 1, 1, 0, "d"), (5, 3, 0, 42, "e"), (5, 3, 0, 42, "e"), (6, 1, 0, 19, "f"), (7, 100_001, 0, 200_000, "g")], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []
