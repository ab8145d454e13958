"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words, and the first letters of longer ones, hashed
to BUCKETS. The machine learns, from the labelled training ids (at most
TRAIN_ROWS of them and TRAIN_TERMS terms of theirs, in the order of a hash of
their ids), a weight for each term that SUPPORT of them hold, and a short vector whose products with the
other terms' vectors add what a pair says beyond its two parts: an insult with
the mention of a group, say. No term is judged alone before the machine sees it,
so a pair may count whose parts say nothing. Scoring visits every whole text in
place; nothing is shuffled for it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import fold_of, stash, text_bytes

#: Of the fit: labelled ids at most, distinct terms of all of them at most, hash buckets, ids that hold a term at least, and the vectors' length.
TRAIN_ROWS, TRAIN_TERMS, BUCKETS, SUPPORT, FACTORS = 10_000, 8_000_000, 1 << 20, 5, 4
#: What a unit of a weight, and of a vector's length, must take off the mean loss.
PRICE = (3e-4, 5e-3)
_EDGES = string.punctuation + "«»“”‘’„…–—¡¿"
_CACHE = 300_000


def word_terms(word: str) -> list[int]:
    core = word.strip(_EDGES)
    if not core:
        return []
    names = [core] + [f"{core[:n]}*" for n in (5, 7) if len(core) > n]
    return [xxhash.xxh32_intdigest(n.encode("utf-8", "replace"), 7) % BUCKETS for n in names]


def text_terms(text: str) -> set[int]:
    return {t for w in set(text.lower().split()) for t in word_terms(w)}


@dataclass
class FactorizationMachine:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        self.feature = {int(t): i for i, t in enumerate(self.terms)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def features(self, text: str) -> set[int]:
        found: set[int] = set()
        if len(self.cache) > _CACHE:
            self.cache.clear()
        for w in set(text.lower().split()):
            own = self.cache.get(w)
            if own is None:
                own = self.cache[w] = tuple(self.feature[t] for t in word_terms(w) if t in self.feature)
            found.update(own)
        return found

    def scores(self, rows: list[set[int]]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-_Rows.of(rows).margin(self.bias, self.weights, self.factors).astype(np.float64)))


class _Rows:
    """Rows of ones, as the columns of each, by row and by column."""

    def __init__(self, size: np.ndarray, cols: np.ndarray):
        self.size, self.cols = size, cols
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)

    @classmethod
    def of(cls, rows) -> "_Rows":
        """rows: for each row its columns."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        return cls(size, np.fromiter((c for r in rows for c in sorted(r)), np.int32, int(size.sum())))

    def turn(self, columns: int) -> None:
        self.count = np.bincount(self.cols, minlength=columns)
        self.rows_by_col = self.row[np.argsort(self.cols, kind="stable")]

    def only(self, kept: np.ndarray) -> "_Rows":
        """The kept columns, numbered anew."""
        at = kept[self.cols]
        made = _Rows(np.bincount(self.row[at], minlength=len(self.size)), (np.cumsum(kept, dtype=np.int32) - 1)[self.cols[at]])
        made.turn(int(kept.sum()))
        return made

    @staticmethod
    def _sums(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each group of so many places, the sum of the values there; one factor at a time, as that is contiguous."""
        if values.ndim == 2:
            return np.stack([_Rows._sums(np.ascontiguousarray(v), at, size) for v in values.T], 1)
        out, some = np.zeros(len(size), values.dtype), size > 0
        if some.any():
            out[some] = np.add.reduceat(values[at], (np.cumsum(size) - size)[some])
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """x @ values."""
        return self._sums(values, self.cols, self.size)

    def back(self, values: np.ndarray) -> np.ndarray:
        """x.T @ values."""
        return self._sums(values, self.rows_by_col, self.count)

    def margin(self, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return bias + self.sums(w) + 0.5 * ((self.sums(v) ** 2).sum(1) - self.sums((v**2).sum(1)))


def _margin(x: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _Rows.of([np.flatnonzero(r) for r in x]).margin(bias, w, v)


def fit(terms: np.ndarray, x, y: np.ndarray, steps: int = 100, rate: float = 0.05, price: tuple[float, float] = PRICE) -> FactorizationMachine:
    """Logistic loss over all rows of ones at once; the seed is fixed, so equal rows give equal machines.

    x: the rows, or a matrix. Steps are Adam's, each followed by
    the proximal step of its metric: a weight, and a vector by its length, that
    does not earn its price becomes zero. Columns with both at zero leave the fit.
    """
    rng = np.random.default_rng(7)
    n, k = len(y), len(terms)
    rows = x if isinstance(x, _Rows) else _Rows.of([np.flatnonzero(r) for r in x])
    rows.turn(k)
    base = (y.sum() + 0.1) / (n + 1)  # without labels: not toxic
    params = [np.array([np.log(base / (1 - base))]), np.zeros(k, np.float32), rng.normal(0, 0.02, (k, FACTORS)).astype(np.float32)]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, (steps if n and k else 0) + 1):
        b, w, v = params
        xv = rows.sums(v)
        margin = b[0] + rows.sums(w) + 0.5 * ((xv**2).sum(1) - rows.sums((v**2).sum(1)))
        g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        g = g.astype(np.float32)
        of = rows.back(g)
        for i, grad in enumerate((np.array([g.sum()]), of, rows.back(g[:, None] * xv) - of[:, None] * v)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.99 * s[i] + 0.01 * (grad**2 if i < 2 else (grad**2).mean(1, keepdims=True))
            size = rate / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
            to = params[i] - size * (m[i] / (1 - 0.9**step))
            if i:
                length = np.abs(to) if i == 1 else np.linalg.norm(to, axis=1, keepdims=True)
                to = to * np.maximum(0, 1 - size * price[i - 1] / np.maximum(length, 1e-12))
            params[i] = to
        if step % 2 == 0:
            kept = (params[1] != 0) | (params[2] != 0).any(1)
            if not kept.all():
                terms, rows = terms[kept], rows.only(kept)
                params[1:], m[1:], s[1:] = ([p[kept] for p in group[1:]] for group in (params, m, s))
            if not len(terms):
                break
    return FactorizationMachine(terms, float(params[0][0]), params[1], params[2])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(text_terms(t.as_py().decode("utf-8", "replace"))) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc", "y", "terms"])


def _packed(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The terms of each id as places in the sorted terms, in 4 bytes each."""
    for batch in batches:
        own = [np.sort(np.searchsorted(terms, np.asarray(row, np.int64))).astype("<i4").tobytes() for row in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["doc", "y", "own"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, rows: int = TRAIN_ROWS, size: int = TRAIN_TERMS, support: int = SUPPORT) -> FactorizationMachine:
    """Learn from labelled ids whose crc32(id) modulo folds is not 0.

    An id with several labels counts as 1 if any is; null ids and labels are
    ignored. The rows of one id count together, as one that holds the terms of
    all. In the order of a hash of their ids, rows ids at most take part, and
    those up to which the distinct terms that support ids hold add up to size;
    so what reaches the driver is bounded whatever the tables hold. Without
    usable rows the machine gives the prior alone.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(label).alias("y"))
    known = known.where(fold_of("doc", folds) != 0).groupBy("doc").agg((F.max("y") > 0).cast("int").alias("y"))
    known = stash(known.orderBy(F.xxhash64("doc"), "doc").limit(rows), "labels")
    own = docs.select(F.col(doc_id).alias("doc"), text_bytes(text).alias("t")).join(F.broadcast(known), "doc")  # rows labels at most
    kind = docs.schema[doc_id].dataType.simpleString()
    seen = own.select("doc", "y", "t").mapInArrow(_terms, f"doc {kind}, y int, terms array<int>")
    held = stash(seen.select("doc", "y", F.explode_outer("terms").alias("term")).distinct(), "terms")
    counts = held.where("term is not null").groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    counts = stash(counts.select("term"), "supported")  # BUCKETS at most
    some = held.join(F.broadcast(counts.withColumn("there", F.lit(True))), "term", "left").withColumn("term", F.when(F.col("there"), F.col("term")))
    sets = stash(some.groupBy("doc", "y").agg(F.collect_list("term").alias("terms")), "sets")  # rows ids of BUCKETS terms at most
    order = Window.orderBy(F.xxhash64("doc"), "doc").rowsBetween(Window.unboundedPreceding, 0)
    within = sets.select("doc", F.size("terms").alias("n")).withColumn("sum", F.sum("n").over(order)).where(F.col("sum") <= size).select("doc")  # rows numbers at most
    terms = np.sort(counts.toArrow().column(0).to_numpy().astype(np.int64))
    data = sets.join(F.broadcast(within), "doc", "left_semi").mapInArrow(partial(_packed, terms=terms), f"doc {kind}, y int, own binary").toArrow()
    data = data.sort_by("doc")
    own = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(v.as_buffer(), "<i4") for v in data.column("own"))])
    lengths = np.fromiter((len(v.as_buffer()) // 4 for v in data.column("own")), np.int64, data.num_rows)
    return fit(terms, _Rows(lengths, own), data.column("y").to_numpy().astype(np.float64))


def _scores(texts: list[bytes], machine: FactorizationMachine) -> np.ndarray:
    found = [machine.scores([machine.features(t.decode("utf-8", "replace")) for t in texts[at : at + 1000]]) for at in range(0, len(texts), 1000)]
    return np.concatenate(found) if found else np.zeros(0)


def _scored(batches: Iterator[pa.RecordBatch], machine: FactorizationMachine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = _scores(batch.column(2).to_pylist(), machine)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc", "held_out", "score", "predicted"])


def _clean(batches: Iterator[pa.RecordBatch], machine: FactorizationMachine, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
        yield batch.filter(pa.array(_scores(texts, machine) < threshold))


def toxicity_scores(docs: DataFrame, machine: FactorizationMachine, doc_id: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) for every row.

    Null or empty text: the score without any feature. A null id has the empty
    text's fold. Repeated rows are scored alike. Empty table: empty result.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), (fold_of(doc_id, folds) == 0).alias("held_out"), text_bytes(text).alias("t"))
    schema = f"doc {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(partial(_scored, machine=machine), schema).withColumnRenamed("doc", doc_id)


def drop_toxic(docs: DataFrame, machine: FactorizationMachine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    return docs.mapInArrow(partial(_clean, machine=machine, at=docs.columns.index(text), threshold=threshold), docs.schema)
