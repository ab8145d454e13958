"""Alignment of two tokenizers' tokens, relational: where both end they cut the text into groups, and where their bytes overlap they link.

Texts are made of few pieces that repeat: words with the white space before
them, and punctuation. At such places no token of either tokenizer can cross,
which is read off the vocabulary and the rule by which it splits (`_RULES`), so a
text's tokens are its pieces' tokens one after the other. Each distinct piece
is tokenised and aligned once, as tables:

tokens of a piece with their positions, exploded; their ends by a windowed
running sum of byte lengths; an outer equi-join of both sides on (piece, end),
written as a grouping, which needs no shuffle beyond the one by piece; cuts are
the ends that both have, groups are running counts of cuts, and every end is one
link, between the tokens of either side that run up to it or across it. A window
finds those in one pass, so that a long group costs its length, not its square.

Texts meet their pieces again by blocks of about BLOCK characters: a block holds
each distinct piece once and its texts as packed numbers of pieces, so that neither
tokens of all texts nor a table of all pieces are ever sent anywhere. What a task
knows of a block's pieces goes there as one compressed stream of columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tables import stash, text_bytes

#: Characters of texts in a block; a longer text is a block of its own.
BLOCK = 1 << 23
#: Bytes of pieces that a task holds before it packs them by block.
PACK = 1 << 26
#: Places to cut a text, and what a token would have to hold to cross such a place.
_RULES = (
    (r"(?<=\S)(?=[ \t\n])", r"\S[ \t\n]"),
    (r"(?<=\S[\t\n])(?=\S)", r"[\t\n]\S"),
    (r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?])", r"[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?]"),
)


class ByteLevel:
    """A byte-level BPE from the text of its JSON file. Where it splits by the usual pattern of words with one space before them, all rules hold."""

    def __init__(self, file: bytes):
        self.file, spec = file, json.loads(file)
        own = spec.get("pre_tokenizer") or {}
        if own.get("type") != "ByteLevel" or own.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("not a byte-level tokenizer that leaves texts as they are")
        self.rules = set(range(len(_RULES))) if own.get("use_regex", True) else set()

    def load(self) -> None:
        self._t = Tokenizer.from_buffer(self.file)
        self._t.encode_special_tokens = True
        given = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in given} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in given)}
        self._bytes = {i: bytes(byte[c] for c in token) for token, i in self._t.get_vocab(with_added_tokens=False).items() if all(c in byte for c in token)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._t.encode_batch(texts, add_special_tokens=False)]

    def bytes_of(self, token: int) -> bytes:
        return self._bytes.get(token, b"")


class Pieces:
    """A BPE of pieces with byte fallback from its model file. It adds a space before a text; texts here bring it along, behind a line end that no piece holds."""

    def __init__(self, file: bytes):
        self.file = file
        self.load()
        names = [p.replace("▁", " ") for p in self._names]
        self.rules = {i for i, (_, across) in enumerate(_RULES) if not any(re.search(across, n) for n in names if n != self.byte_name(n))}
        if any("\n" in n and len(n) > 1 for n in names):
            raise ValueError("a piece holds a line end")

    @staticmethod
    def byte_name(name: str) -> str | None:
        return name if re.fullmatch(r"<0x[0-9A-F]{2}>", name) else None

    def load(self) -> None:
        self._s = sentencepiece.SentencePieceProcessor(model_proto=self.file)
        self._names = [self._s.id_to_piece(i) for i in range(self._s.get_piece_size())]
        self._skip = len(self._s.encode("\n"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids[self._skip :] for ids in self._s.encode(["\n" + t for t in texts], num_threads=1)]

    def bytes_of(self, token: int) -> bytes:
        if self._s.is_byte(token):
            return bytes([int(self._names[token][3:5], 16)])
        return b"" if self._s.is_control(token) or self._s.is_unknown(token) else self._names[token].replace("▁", " ").encode()

    def __getstate__(self) -> dict:
        return {"file": self.file, "rules": self.rules}


class _Numbers(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _shrunk(numbers: np.ndarray) -> bytes:
    """Numbers of pieces by planes of bytes, as most of the high ones are 0."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _numbers(shrunk: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(shrunk), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _lists(shrunk: bytes, sizes: list[int]) -> list[np.ndarray]:
    return np.split(_numbers(shrunk), np.cumsum(sizes)[:-1]) if sizes else []


_TEXTS = "block long, docs array<{kind}>, sizes array<int>, own binary, kinds array<int>, used binary, pieces array<string>"


def _block(number: int, docs: list, own: list[np.ndarray], pieces: _Numbers, kind: pa.DataType) -> pa.RecordBatch:
    """One row: the texts' ids, the numbers of their pieces in order, the steps between those that each text uses, and the pieces."""
    used = [np.diff(np.unique(x), prepend=np.uint32(0)) for x in own]
    columns = [pa.array([number], pa.int64()), pa.array([docs], pa.list_(kind))]
    for lists in (own, used):
        columns += [pa.array([list(map(len, lists))], pa.list_(pa.int32())), pa.array([_shrunk(np.concatenate(lists))], pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([list(pieces)], pa.list_(pa.string()))], ["block", "docs", "sizes", "own", "kinds", "used", "pieces"])


def _blocks(batches: Iterator[pa.RecordBatch], rule: str | None, block: int) -> Iterator[pa.RecordBatch]:
    cut = re.compile(rule) if rule else None
    number, chars = TaskContext.get().partitionId() << 33, 0
    docs, own, pieces, kind = [], [], _Numbers(), pa.null()
    for batch in batches:
        kind = batch.column(0).type
        for doc, held in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = held.as_py().decode("utf-8", "replace")
            if docs and chars + len(text) > block:
                yield _block(number, docs, own, pieces, kind)
                number, chars, docs, own, pieces = number + 1, 0, [], [], _Numbers()
            parts = (cut.split(" " + text) if cut else [" " + text]) if text else []
            docs.append(doc)
            own.append(np.fromiter(map(pieces.__getitem__, parts), np.uint32, len(parts)))
            chars += len(text)
    if docs:
        yield _block(number, docs, own, pieces, kind)


def _encode(batches: Iterator[pa.RecordBatch], sides: tuple) -> Iterator[pa.RecordBatch]:
    """Ids and byte lengths of each piece's tokens on both sides; none where the tokens' bytes are not the piece's."""
    for side in sides:
        side.load()
    known: tuple[dict, dict] = ({}, {})
    for batch in batches:
        texts = batch.column(0).to_pylist()
        both = [side.encode(texts) for side in sides]
        for held, side, found in zip(known, sides, both):
            held.update({i: side.bytes_of(i) for i in {i for ids in found for i in ids} - held.keys()})
        exact = [all(b"".join([held[i] for i in ids]) == text.encode() for held, ids in zip(known, pair)) for text, *pair in zip(texts, *both)]
        columns = [batch.column(0)]
        for held, found in zip(known, both):
            kept = [ids if ok else None for ids, ok in zip(found, exact)]
            columns += [pa.array(kept, pa.list_(pa.int32())), pa.array([None if ids is None else [len(held[i]) for i in ids] for ids in kept], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "a", "a_bytes", "b", "b_bytes"])


def align_pieces(tokens: DataFrame) -> DataFrame:
    """tokens (piece, a, a_bytes, b, b_bytes), by piece the ids and byte lengths of two sides that cover the same bytes: piece, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and links (a << 32 | b for each)."""
    token = lambda side: F.transform(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_bytes").alias("n")), lambda t, i: F.struct(F.lit(side == "a").alias("first"), i.alias("pos"), t["id"].alias("id"), t["n"].alias("n")))
    dealt = tokens.where("a is not null").repartition("piece").select("piece", F.explode(F.concat(token("a"), token("b"))).alias("t")).select("piece", "t.*")
    ends = dealt.select("piece", "first", "id", F.sum("n").over(W.partitionBy("piece", "first").orderBy("pos")).alias("end"))
    met = ends.groupBy("piece", "end").agg(F.max(F.when(F.col("first"), F.col("id"))).alias("a"), F.max(F.when(~F.col("first"), F.col("id"))).alias("b"))
    back = W.partitionBy("piece").orderBy(F.desc("end"))  # from the end on: what covers a place ends there or, last seen, behind it
    over = lambda c: F.last(c, True).over(back).cast("long")
    group = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).over(back)
    rows = met.select("piece", "end", "a", "b", group.alias("g"), F.shiftleft(over("a"), 32).bitwiseOR(over("b")).alias("link"))
    ids = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", c)))), lambda t: t[c].cast("string")), ",")
    grouped = rows.groupBy("piece", "g").agg(F.concat(ids("a"), F.lit("|"), ids("b")).alias("t"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.collect_list("link").alias("links"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "t")), False), lambda x: x["t"]), ";")
    sums = [F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.sum(F.size("links")).cast("long").alias("n_links")]
    return grouped.groupBy("piece").agg(*sums, text.alias("groups"), F.flatten(F.collect_list("links")).alias("links"))


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of pieces by block (of), each block's as one compressed stream; several where a task holds more than so many bytes."""
    option = pa.ipc.IpcWriteOptions(compression="zstd")

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by([("of", "ascending"), ("no", "ascending")]).combine_chunks()
        of, streams = rows.column("of").to_numpy(), []
        at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        rows = rows.drop_columns("of")
        for start, end in zip(at.tolist(), [*at[1:].tolist(), len(of)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=option) as out:
                out.write_table(rows.slice(start, end - start))
            streams.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(of[at], pa.int64()), pa.array(streams, pa.binary())], ["of", "rows"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def _unpacked(packed: pa.Table, empty: pa.Schema) -> pa.Table:
    """A block's pieces in order; an empty table where its texts have none."""
    found = [pa.ipc.open_stream(rows).read_all() for rows in packed.column("rows").to_pylist()]
    return pa.concat_tables(found).sort_by("no") if found else empty.empty_table()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each row's start, with the end of the last; null counts as empty."""
    size = np.nan_to_num(column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))


def _pairs_of(key: tuple, docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """How many of a block's texts hold each link."""
    pieces = _unpacked(pieces, pa.schema([("no", pa.int32()), ("links", pa.list_(pa.int64()))]))
    links, at = _flat(pieces.column("links"))
    exact = pieces.column("links").is_valid().to_numpy()
    names, links = np.unique(links, return_inverse=True)
    count = np.zeros(len(names), np.int64)
    row = docs.to_pylist()[0]
    for steps in _lists(row["used"], row["kinds"]):
        used = np.cumsum(steps, dtype=np.int64)
        if exact[used].all():
            sizes = at[used + 1] - at[used]
            where = np.repeat(at[used] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            count[np.unique(links[where])] += 1
    return pa.table({"link": pa.array(names, pa.int64()), "n": pa.array(count)}).filter(pa.array(count > 0))


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _texts_of(key: tuple, docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """Sums over each text's pieces, and their groups in order. Of a piece only what its groups do not tell is given; every end is a link, and those of both sides are one."""
    pieces = _unpacked(pieces, pa.schema([("no", pa.int32()), ("groups", pa.string()), ("both", pa.int64()), ("count_sum", pa.int64())]))
    exact, groups = pieces.column("groups").is_valid().to_numpy(), pieces.column("groups").fill_null("").to_pylist()
    count = lambda mark: np.fromiter((g.count(mark) for g in groups), np.int64, len(groups))
    both, n_groups = pieces.column("both").fill_null(0).to_numpy(), count("|")
    n_a, n_best = both >> 32, both & 0xFFFFFFFF
    n_b = count(",") + 2 * n_groups - n_a
    values = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, pieces.column("count_sum").fill_null(0).to_numpy()])
    row, texts = docs.to_pylist()[0], []
    sums = np.zeros((len(_SUMS), len(row["docs"])), np.int64)
    for k, at in enumerate(_lists(row["own"], row["sizes"])):
        if exact[at].all():
            sums[:, k] = values[:, at].sum(1)
            texts.append(";".join([groups[x] for x in at.tolist()]))
        else:
            texts.append("")
    return pa.table({"doc": docs.column("docs").combine_chunks().flatten(), **dict(zip(_SUMS, map(pa.array, sums))), "groups": pa.array(texts, pa.string())})


def align(docs: DataFrame, first: ByteLevel, second: Pieces, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """Per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of their first token's), count_sum (counts over links) and groups, `a1,a2|b1;a3|b2,b3`.

    Both sides encode a space and the text. A link's count is the number of
    rows whose text holds it. Null and empty texts, and texts whose bytes a
    side does not give back, have no tokens: zeros and empty groups. Repeated
    ids and null ids are rows like others. A text without any place to cut is
    one piece. Empty table: empty result. Other columns are ignored, whatever
    their names.
    """
    rules = sorted(first.rules & second.rules)
    rule = "|".join(_RULES[i][0] for i in rules) or None
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), text_bytes(text).alias("t"))
    cut = stash(rows.mapInArrow(partial(_blocks, rule=rule, block=block), _TEXTS.format(kind=kind)), "texts", "zstd")
    held = cut.select(F.col("block").alias("of"), F.posexplode("pieces").alias("no", "piece"))
    tokens = held.select("piece").distinct().mapInArrow(partial(_encode, sides=(first, second)), "piece string, a array<int>, a_bytes array<int>, b array<int>, b_bytes array<int>")
    known = align_pieces(tokens).select(F.monotonically_increasing_id().alias("s"), "piece", "n_a", "groups", "links")
    known = stash(known, "pieces", "zstd")  # the exact ones
    packed = lambda of: held.join(of, "piece", "left").drop("piece").mapInArrow(partial(_packed, most=pack), "of long, rows binary")
    meet = lambda of, *columns: cut.select("block", *columns).groupBy("block").cogroup(packed(of).groupBy("of"))
    parts = meet(known.select("piece", "links"), "kinds", "used").applyInArrow(_pairs_of, "link long, n long")
    counts = stash(parts.groupBy("link").agg(F.sum("n").alias("n")), "links")
    side = F.shiftright("link", 32)
    counts = counts.join(counts.groupBy(side.alias("a")).agg(F.max("n").alias("most")), F.col("a") == side)
    each = known.select("s", F.explode("links").alias("link")).join(counts.select("link", "n", (F.col("n") == F.col("most")).alias("best")), "link")
    sums = each.groupBy("s").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    both = F.shiftleft("n_a", 32).bitwiseOR(F.col("n_best")).alias("both")
    full = stash(known.join(sums, "s").select("piece", "groups", both, "count_sum"), "sums", "zstd")
    out = meet(full, "docs", "sizes", "own").applyInArrow(_texts_of, f"doc {kind}, {', '.join(f'{c} long' for c in _SUMS)}, groups string")
    return out.withColumnRenamed("doc", doc_id)
