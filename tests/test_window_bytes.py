from tokenizers import Tokenizer

from quillcast.operators import tokens as T
from quillcast.plans.articles import byte_tokens


def test_pieces_are_cut_from_bytes_as_decoding_gives_them(monkeypatch):
    file = byte_tokens()
    whole = Tokenizer.from_buffer(file)
    whole.encode_special_tokens = True
    loaded = T._loaded(file)

    class Undecoded:
        def __getattr__(self, name):
            assert name != "decode_batch"
            return getattr(loaded, name)

    for text in ("日本語🙂é <|endoftext|> \r\n\x00 naïve " * 9, "plain words, " * 40):
        ids = whole.encode(text, add_special_tokens=False).ids
        spans = [(s, min(s + 5, len(ids))) for s in range(0, len(ids), 3)]
        want = [whole.decode(ids[a:b], skip_special_tokens=True) for a, b in spans]
        monkeypatch.setattr(T, "_loaded", lambda file: Undecoded())
        assert T._pieces(text, ids, spans, file) == want
    assert any("�" in w for w in [whole.decode(whole.encode("🙂🙃日", add_special_tokens=False).ids[:1])])
