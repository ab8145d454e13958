"""Lengths and windows in the tokens of a given tokenizer, whose JSON file travels with the job."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Texts that are tokenised at once.
_AT_ONCE = 256


@lru_cache(maxsize=4)
def _loaded(file: bytes) -> Tokenizer:
    """Strings of special tokens inside a text are text."""
    tokenizer = Tokenizer.from_buffer(file)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _byte_lengths(file: bytes) -> np.ndarray | None:
    """How many bytes of the text each token is; None for a tokenizer that changes texts or whose tokens are not bytes."""
    spec = json.loads(file)
    own, decoder = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    if own.get("type") != "ByteLevel" or own.get("add_prefix_space") or decoder.get("type") != "ByteLevel" or spec.get("normalizer") or not all(t["special"] for t in spec.get("added_tokens") or []):
        return None
    tokens = _loaded(file).get_vocab(with_added_tokens=False)
    sizes = np.zeros(max(tokens.values(), default=-1) + 1, np.int64)
    for token, i in tokens.items():
        sizes[i] = len(token)
    return sizes


def _pieces(text: str, ids: list[int], spans: list[tuple[int, int]], file: bytes) -> list[str]:
    """The text of each span of tokens: where tokens are bytes, cut from the text's bytes, else decoded."""
    sizes = _byte_lengths(file)
    if sizes is not None and max(ids) < len(sizes):
        at, raw = np.concatenate(([0], np.cumsum(sizes[ids]))), text.encode()
        if at[-1] == len(raw):
            return [raw[at[a] : at[b]].decode("utf-8", "replace") for a, b in spans]
    return _loaded(file).decode_batch([ids[a:b] for a, b in spans], skip_special_tokens=True)


def _ids(texts: list[str], file: bytes) -> Iterator[list[int]]:
    for at in range(0, len(texts), _AT_ONCE):
        for e in _loaded(file).encode_batch_fast(texts[at : at + _AT_ONCE], add_special_tokens=False):
            yield e.ids


def token_count(text: Column, file: bytes) -> Column:
    """How many tokens the whole text has, without special ones; null and empty texts have none."""

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) for ids in _ids(texts.fillna("").tolist(), file)], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def within_tokens(df: DataFrame, text: Column, file: bytes, most: int) -> DataFrame:
    """The rows whose text has at most so many tokens. Texts with no more bytes than that are not tokenised, as a token has a byte at least."""
    short = F.coalesce(F.octet_length(text), F.lit(0)) <= most
    name = "__tokens"
    sure, others = df.where(short), df.where(~short)
    return sure.unionByName(others.withColumn(name, token_count(text, file)).where(F.col(name) <= most).drop(name))


def _windows(batches: Iterator[pa.RecordBatch], file: bytes, size: int, step: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for at in range(0, len(texts), _AT_ONCE):
            part, rows, starts, counts, pieces = texts[at : at + _AT_ONCE], [], [], [], []
            for i, (text, ids) in enumerate(zip(part, _ids(part, file))):
                last = max(0, -(-(len(ids) - size) // step))
                spans = [(s * step, min(s * step + size, len(ids))) for s in range(last + 1)] if ids else []
                found = [text] if len(spans) == 1 else _pieces(text, ids, spans, file) if spans else []
                for (start, end), piece in zip(spans, found):
                    if len(spans) == 1 or piece.strip():
                        rows.append(at + i), starts.append(start), counts.append(end - start), pieces.append(piece)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(pieces, pa.string())], ["key", "start", "tokens", "piece"])


def token_windows(df: DataFrame, key: str, text: str, file: bytes, size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, start, tokens, piece): each text in windows of so many tokens, of which neighbours share the overlap, from their first token on.

    A text that fits is one window, unchanged. Other windows are cut from the text's
    bytes, or decoded where tokens are not bytes; those that are blank are left out. Texts without tokens have no window. A window's
    end may cut a character, which is then decoded as U+FFFD.
    """
    if overlap >= size:
        raise ValueError("windows must be longer than what they share")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(partial(_windows, file=file, size=size, step=size - overlap), f"key {kind}, start long, tokens long, piece string")
    return out.withColumnRenamed("key", key)
