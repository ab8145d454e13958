import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillcast.llm import queries as Q
from quillcast.llm.token_alignment import ByteLevel, Pieces, _packed, _unpacked, align


def files():
    return [open(f"{Q.TOKENIZERS}/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def sides():
    a, b = files()
    return ByteLevel(a), Pieces(b)


def plain(texts, sides):
    """Whole texts, token by token: the contract without pieces or tables."""
    a_file, b_file = files()
    whole, spm = Tokenizer.from_buffer(a_file), sentencepiece.SentencePieceProcessor(model_proto=b_file)
    whole.encode_special_tokens = True
    for s in sides:
        s.load()
    texts = [t or "" for t in texts]
    rows, count = [], Counter()
    for text in texts:
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, spm.encode(text)) if text else ([], [])
        if not text or any(b"".join(map(s.bytes_of, ids)) != (" " + text).encode() for s, ids in zip(sides, (a, b))):
            rows.append(None)
            continue
        ends = [np.cumsum([len(s.bytes_of(i)) for i in ids]) for s, ids in zip(sides, (a, b))]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            m, n = (int(np.searchsorted(e, cut, "right")) for e in ends)
            groups.append(f"{','.join(map(str, a[i:m]))}|{','.join(map(str, b[j:n]))}")
            i, j = m, n
        starts = [np.concatenate(([0], e[:-1])) for e in ends]
        links = [(a[x], b[y]) for x in range(len(a)) for y in range(int(np.searchsorted(ends[1], starts[0][x], "right")), int(np.searchsorted(starts[1], ends[0][x], "left")))]
        count.update(set(links))
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(count[p] == most[p[0]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_query_against_whole_texts(spark, sf_dir, sides):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for d, r in zip(docs, plain([d.text for d in docs], sides))}
    got = {r.doc_id: (*[r[c] for c in COLUMNS[:-1]], r.groups_sha256) for r in Q.op12_token_alignment(spark, sf_dir).collect()}
    assert got == want and sum(r[2] < r[0] for r in got.values()) > 100


def test_texts_that_try_every_cut(spark, sides):
    """White space of all kinds, control strings, marks that one side changes, scripts without spaces, and long runs."""
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "a", "B7", "don't", "I'LL", "x.y", "²:", "é", "é", "ß!", "日本語", "🙂", ".", ",;", ");\r", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "\x00", "_", "1,000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    texts += [None, "", " ", "   ", "\n", "▁", "a ▁b", "Ab" * 20_000, "ab. " * 20_000, "x" * 3000, "日本語" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align(docs, *sides, block=5000).collect()}
    assert got == dict(enumerate(plain(texts, sides)))
    assert got[605] == (0,) * 6 + ("",) and got[606] == got[605]


def test_rules_follow_the_vocabulary(sides):
    assert sides[0].rules == sides[1].rules == {0, 1, 2}
    with pytest.raises(ValueError):
        ByteLevel(b'{"model": {}, "pre_tokenizer": {"type": "Whitespace"}}')


def test_no_place_to_cut_gives_the_same(spark, sides, monkeypatch):
    texts = ["one piece of text, whatever.\nIt holds", "a  b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(sides[0], "rules", set())
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align(docs, *sides).collect()} == dict(enumerate(plain(texts, sides)))


def test_odd_rows(spark, sides):
    rows = [(1, "same text", 1), (1, "same text", 2), (None, "same", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int")
    got = sorted(((r.doc_id, *[r[c] for c in COLUMNS]) for r in align(docs, *sides).collect()), key=str)
    assert got == sorted(((d[0], *r) for d, r in zip(rows, plain([d[1] for d in rows], sides))), key=str)
    assert align(docs.limit(0), *sides).collect() == []


def test_pieces_go_to_their_blocks_packed(spark, sides):
    """In under half of the bytes that rows of their own take, with the same results however often a task packs."""
    rows = [pa.record_batch({"of": [i % 3 for i in range(at, at + 6000)], "no": pa.array([i // 3 for i in range(at, at + 6000)], pa.int32()), "groups": [None if i % 50 == 0 else f"{i % 97},{i % 89}|{i % 83}" for i in range(at, at + 6000)]}) for at in (6000, 0)]
    packed = pa.Table.from_batches(_packed(iter(rows), 1 << 30))
    assert packed.column("of").to_pylist() == [0, 1, 2] and packed.nbytes < sum(r.nbytes for r in rows) / 2
    back = _unpacked(packed.slice(1, 1), rows[0].schema).to_pydict()
    assert back["no"] == list(range(4000)) and back["groups"] == [None if i % 50 == 0 else f"{i % 97},{i % 89}|{i % 83}" for i in range(1, 12000, 3)]
    texts = [f"word{i} and word{i * i}, once\nmore {i}" for i in range(300)] + ["", None, "▁"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align(docs, *sides, block=500, pack=2000).collect()}
    assert got == dict(enumerate(plain(texts, sides)))
