import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillcast.llm.ppm import PpmModel, grams, pairs_of, ppm_scores, shard_scores


class PlainPpm:
    """The same model written with dictionaries, a byte at a time."""

    def __init__(self, texts, order, least):
        counts = Counter()
        for t in texts:
            data = bytes(order) + t.replace(b"\0", b"\1") + b"\0"
            for i in range(order, len(data)):
                for j in range(order + 1):
                    counts[data[i - j : i + 1]] += 1
        self.order = order
        self.seen = defaultdict(dict)
        for s, n in counts.items():
            if n >= least:
                self.seen[s[:-1]][s[-1]] = n

    def log10(self, t):
        data, total = bytes(self.order) + t.replace(b"\0", b"\1") + b"\0", 0.0
        for i in range(self.order, len(data)):
            ruled, entered = set(), False
            for j in range(self.order, -1, -1):
                ctx = data[i - j : i]
                own = self.seen.get(ctx)
                if not own:
                    continue
                seen = max(sum(own.values()), self.seen.get(ctx[:-1], {}).get(ctx[-1], 0) if ctx else 0)
                left = sum(n for b, n in own.items() if b not in ruled)
                escape = seen - sum(own.values()) + len(own) - len(ruled)
                if entered:
                    escape = max(escape, 1)
                if data[i] in own:
                    total += math.log10(own[data[i]] / (left + escape))
                    break
                total += math.log10(escape / (left + escape))
                ruled, entered = set(own), True
            else:
                total -= math.log10(max(1, 256 - len(self.seen.get(b"", {}))))
        return total


TEXTS = [b"abracadabra abra", b"the cat sat on the mat", b"", b"aaaaaa\0b", "été à la mer".encode()]


@pytest.mark.parametrize("order,least", [(0, 1), (2, 1), (3, 2), (6, 1)])
def test_model_matches_plain_ppm(order, least):
    codes = grams(TEXTS, order)[0]
    model = PpmModel(order, pairs_of(*np.unique(codes, return_counts=True), order, least))
    plain = PlainPpm(TEXTS, order, least)
    for t in [*TEXTS, b"zebra", b"cat cat", bytes(range(256))]:
        assert model.log10(grams([t], order)[0]).sum() == pytest.approx(plain.log10(t))


@pytest.mark.parametrize("order", [2, 4, 6])
def test_shards_score_as_the_whole_trie(order):
    train = grams(TEXTS, order)[0]
    new = np.unique(np.concatenate((train, grams([b"zebra", b"cat cat", bytes(range(256))], order)[0])))
    codes, n = np.unique(train, return_counts=True)
    whole = PpmModel(order, pairs_of(codes, n, order, 1)).log10(new)
    counts = np.zeros(len(new), np.int64)
    counts[np.searchsorted(new, codes)] = n
    low = np.zeros((256, 256), np.int64)
    np.add.at(low, ((train >> np.uint64(8) & np.uint64(255)).astype(int), (train & np.uint64(255)).astype(int)), 1)
    shard = new >> np.uint64(8) & np.uint64(0xFFFF)
    for x in np.unique(shard):
        own = shard == x
        assert shard_scores(new[own], counts[own], order, low) == pytest.approx(whole[own])


def test_probabilities_add_up():
    codes = grams(TEXTS, 2)[0]
    model = PpmModel(2, pairs_of(*np.unique(codes, return_counts=True), 2, 1))
    for ctx in (b"\0\0", b"ab", b"zz", b"a "):
        code = int.from_bytes(ctx, "big") << 8
        assert sum(10 ** model.log10(np.arange(code, code + 256, dtype=np.uint64))) == pytest.approx(1)


def plain_base(rows, folds=7, held=2):
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds == held
    train = [words(t) for i, t in rows if not out(i)]
    counts = Counter(w for t in train for w in t)
    n, v, ends = sum(counts.values()) + len(train), len(counts) + bool(train), len(train)
    found = []
    for i, t in rows:
        cs = [counts[w] for w in words(t)] + [ends]
        found.append((i, out(i), len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 1) / (n + v + 1)) for c in cs)))
    return found


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {r[0]: r for r in plain_base(rows)}
    scores = []
    for cells in (1 << 20, 200):
        got = ppm_scores(docs, order=6, cells=cells, common=cells).collect()
        scores.append({r.doc_id: r.score for r in got})
        assert len(got) == len(rows)
        for r in got:
            e = expected[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[1:5]
            assert r.base_score == pytest.approx(e[5], rel=1e-9)
    texts = [b" ".join((t or "").encode().lower().split()) for i, t in rows if not expected[i][1]]
    assert scores[0] == pytest.approx(scores[1])
    plain = PlainPpm(texts, 6, 1)
    for r in got[:12]:
        text = b" ".join((dict(rows)[r.doc_id] or "").encode().lower().split())
        assert r.score == pytest.approx(plain.log10(text))


def test_odd_rows(spark):
    rows = [(None, None, 1), (3, "", 1), (4, " \n", 1), (5, "a b", 1), (5, "a b", 1), (6, "w " * 200_000, 1), (7, "nul \x00 x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    expected = plain_base([r[:2] for r in rows])
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in ppm_scores(docs).collect()]
    key = lambda r: str(r[:4])
    for g, e in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5])
    assert ppm_scores(docs.limit(0)).collect() == []
    lone = ppm_scores(docs.where("false").unionByName(docs.where("doc_id = 5").limit(1)), held=zlib.crc32(b"5") % 7).first()
    assert lone.n_known == 0 and lone.train_tokens == 0 and lone.score == pytest.approx(-4 * math.log10(256))
