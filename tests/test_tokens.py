import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillcast import plans
from quillcast.operators import tokens as T
from quillcast.plans.articles import byte_tokens


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_buffer(byte_tokens())
    t.encode_special_tokens = True
    return t


def plain(whole, text, size=512, overlap=64):
    """Windows of one text, as a loop over starts."""
    ids, out, start = whole.encode(text or "", add_special_tokens=False).ids, [], 0
    if len(ids) <= size:
        return [(0, len(ids), text)] if ids else []
    while True:
        piece = whole.decode(ids[start : start + size], skip_special_tokens=True)
        if piece.strip():
            out.append((start, len(ids[start : start + size]), piece))
        if start + size >= len(ids):
            return out
        start += size - overlap


def test_windows_of_whole_documents(spark, sf_dir, whole):
    want = {(r.doc_id, *w) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for w in plain(whole, r.text)}
    got = [tuple(r) for r in plans.QUERIES["x20b_token_windows"](spark, sf_dir).collect()]
    assert set(got) == want and len(got) == len(want) and any(start for _, start, _, _ in got)


def test_prompts_within_tokens(spark, sf_dir, whole):
    chats = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        chats.setdefault(r.conv_id, []).append(f"{r.role or ''}: {r.text or ''}")
    want = {i: "\n".join(t) for i, t in chats.items() if len(whole.encode("\n".join(t), add_special_tokens=False).ids) <= 256}
    got = {r.conv_id: r.prompt for r in plans.QUERIES["p27b_prompts_within_tokens"](spark, sf_dir).collect()}
    assert got == want and 0 < len(want) < len(chats)


@pytest.mark.parametrize("size, overlap", [(4, 1), (3, 2), (7, 0)])
def test_windows_at_every_length(spark, whole, size, overlap):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(12)] + ["\n" * 9 + "end", "日本語のテキスト" * 3, "<|endoftext|> as text", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in T.token_windows(df, "doc_id", "text", byte_tokens(), size, overlap).collect()}
    assert got == {(i, *w) for i, t in enumerate(texts) for w in plain(whole, t, size, overlap)}
    with pytest.raises(ValueError):
        T.token_windows(df, "doc_id", "text", b"", 4, 4)


def test_counts_and_short_texts(spark, whole):
    texts = ["", None, "one", "one two three four", "é" * 5, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    sizes = {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.i: r.n for r in df.select("i", T.token_count(F.col("text"), byte_tokens()).alias("n")).collect()} == sizes
    for most in (0, 1, 4, 7):
        assert {r.i for r in T.within_tokens(df, F.col("text"), byte_tokens(), most).collect()} == {i for i, n in sizes.items() if n <= most}
