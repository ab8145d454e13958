"""Line dedup: lines that many documents share stay in one of them only.

Plan. Each document's distinct line keys are hashed to 128 bits where the text
is read, and only the hashes move. One aggregation (combined before its
shuffle) counts the documents of each hash and finds the largest id. Hashes of
enough documents are dealt to shards; each shard gets a minimal perfect hash
that indexes an array of 64-bit fingerprints, one of counts and one of keepers.
The documents' hashes then visit their shard's arrays as a stream, one Arrow
batch at a time, after the arrays: no line is joined and no group is gathered.
What a document loses returns to it as a list no longer than the document.

Skew. A line of a large share of all documents would send that share to one
shard. Lines of at least 1/HOT of all (line, document) pairs number HOT at
most, so their arrays have a proven size (24 bytes each), are sent to every
task, and their occurrences never reach a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfect_hash import MinimalPerfectHash, mix
from .tables import NO_ID, id_key, stash, text_bytes

#: Entries of one shard's arrays, and the bound on lines that every task knows.
SHARD, HOT = 1 << 18, 4096
_SPACE = b" \t\n\x0b\x0c\r"
_SEED = 7


def _keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """A key for each line, None for lines too short to count."""
    found: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower changes A-Z only
        key = line.strip(_SPACE)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        found.append(key if long else None)
    return found


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, h1, h2 = batch.column(0).to_numpy(), [], [], []
        for text in batch.column(1):
            own = set(_keys(text.as_py(), min_chars)) - {None}
            counts.append(len(own))
            for key in own:
                h1.append(xxhash.xxh64_intdigest(key, 42))
                h2.append(xxhash.xxh64_intdigest(key, _SEED))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(_signed(h1)), pa.array(_signed(h2))], ["k", "h1", "h2"])


def _slot(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1.view(np.uint64) ^ mix(h2.view(np.uint64), 0)


class LineIndex:
    """Fingerprints, counts and keepers behind a minimal perfect hash."""

    def __init__(self, mph: MinimalPerfectHash, marks: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.mph, self.marks, self.counts, self.keepers = mph, marks, counts, keepers

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> "LineIndex":
        mph = MinimalPerfectHash.build(_slot(h1, h2))
        at, n = mph.lookup(_slot(h1, h2)), len(mph)
        arrays = [np.zeros(n, np.int64) for _ in range(3)]
        for to, values in zip(arrays, (h2, counts, keepers)):
            to[at] = values
        return cls(mph, arrays[0], arrays[1].astype(np.uint32), arrays[2])

    def keeper(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is in the index, and the id of the document that keeps it."""
        if not len(self.marks):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        at = self.mph.lookup(_slot(h1, h2))
        known = (at >= 0) & (self.marks[at] == h2)
        return known, self.keepers[at]

    def to_bytes(self) -> bytes:
        mph = self.mph.to_bytes()
        return len(mph).to_bytes(8, "little") + mph + self.marks.tobytes() + self.keepers.tobytes() + self.counts.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "LineIndex":
        size = int.from_bytes(blob[:8], "little")
        mph = MinimalPerfectHash.from_bytes(blob[8 : 8 + size])
        n, at = len(mph), 8 + size
        marks, keepers = (np.frombuffer(blob, np.int64, n, at + 8 * n * i) for i in range(2))
        return cls(mph, marks, np.frombuffer(blob, np.uint32, n, at + 16 * n), keepers)


def _build(pdf):
    index = LineIndex.build(*(pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "n", "keeper")))
    return pdf.iloc[:1][["shard"]].assign(blob=index.to_bytes())


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, each shard's arrays before its lines."""
    shard, index = None, None
    for batch in batches:
        shards, blobs = batch.column(0).to_numpy(), batch.column(1)
        ids, h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        starts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            if shards[a] != shard:
                shard, index = shards[a], None
            if blobs[a].is_valid:
                index, a = LineIndex.from_bytes(blobs[a].as_py()), a + 1
            if index is None or a == b:
                continue
            own = [x[a:b].astype(np.int64) for x in (h1, h2, ids)]
            known, keeper = index.keeper(own[0], own[1])
            lost = known & (keeper != own[2])
            yield pa.RecordBatch.from_arrays([pa.array(own[2][lost]), pa.array(own[0][lost])], ["k", "h1"])


def _rewrite(batches: Iterator[pa.RecordBatch], min_chars: int, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The last two columns become n_lines, n_dropped and kept; those before them pass through."""
    for batch in batches:
        ids, out = batch.column(0).to_pylist(), []
        for k, text, lost in zip(ids, batch.column(1), batch.column(2)):
            lost = set(lost.as_py() or ())
            text = text.as_py()
            lines, stay = text.split(b"\n"), []
            for line, key in zip(lines, _keys(text, min_chars)):
                if key is not None:
                    h = xxhash.xxh64_intdigest(key, 42)
                    h -= (h >> 63) << 64
                    if h in lost or hot.get(h, k) != k:
                        continue
                stay.append(line)
            out.append((len(lines), len(lines) - len(stay), b"\n".join(stay).decode("utf-8", "replace")))
        n, dropped, kept = zip(*out) if out else ((), (), ())
        new = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
        rest = [batch.column(i) for i in range(3, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*new, *rest], ["n_lines", "n_dropped", "kept", *batch.schema.names[3:]])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Drop every line whose key is in min_docs documents or more from all but the largest id holding it.

    A key is the line without white space at its ends and with A-Z lower-cased;
    keys under min_chars code points never count. Returns n_lines, n_dropped,
    kept (the text that stays), then doc_id and the columns named in keep.

    Null or empty text: one empty line, which stays. A null id is smaller than
    all others. Rows that share an id count one by one, and all of them keep
    what their id keeps. A document that keeps a line keeps all copies of it. Empty table: empty result. Other columns of
    docs are ignored, whatever their names. Lines are
    counted by 128 bits of hashes; which of its lines a document loses is told
    by the first 64.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key(doc_id).alias("k"), text_bytes(text).alias("t"), *dict.fromkeys([doc_id, *keep]))
    held = stash(rows.select("k", "t").mapInArrow(partial(_hashes, min_chars=min_chars), "k long, h1 long, h2 long"), "line-keys")
    lines = stash(held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("k").alias("keeper")).where(F.col("n") >= min_docs), "shared-lines")
    pairs, entries = held.count(), lines.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // SHARD))
    is_hot = F.col("n") >= max(min_docs, -(-pairs // HOT))
    hot_rows = lines.where(is_hot)  # HOT rows at most, as each stands for pairs / HOT pairs
    hot = {r.h1: r.keeper for r in hot_rows.select("h1", "keeper").collect()}
    shard = F.pmod(F.col("h2"), F.lit(shards)).cast("int").alias("shard")
    nothing = [F.lit(0).cast("long").alias(c) for c in ("k", "h1", "h2")]
    arrays = lines.where(~is_hot).select(shard, "h1", "h2", "n", "keeper").groupBy("shard").applyInPandas(_build, "shard int, blob binary")
    cold = held.join(F.broadcast(hot_rows.select("h1", "h2")), ["h1", "h2"], "left_anti")
    visits = arrays.select("shard", "blob", *nothing).unionByName(cold.select(shard, F.lit(None).cast("binary").alias("blob"), "k", "h1", "h2"))
    lost = visits.repartition("shard").sortWithinPartitions("shard", F.col("blob").isNull()).mapInArrow(_probe, "k long, h1 long")
    lost = lost.groupBy("k").agg(F.collect_set("h1").alias("lost"))
    joined = rows.join(lost, "k", "left").select("k", "t", "lost", *dict.fromkeys([doc_id, *keep]))
    schema = "n_lines long, n_dropped long, kept string, " + ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in dict.fromkeys([doc_id, *keep]))
    return joined.mapInArrow(partial(_rewrite, min_chars=min_chars, hot=hot), schema)

