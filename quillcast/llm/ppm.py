"""Language-model scoring by prediction by partial matching over bytes, with a unigram base score.

Model. Contexts of 0 to ORDER bytes and the bytes seen after them are counted
over all training texts; nothing is pruned, so the trie grows with the corpus. A
byte is coded in the longest known context; if it was never seen there, an
escape is coded and the next shorter context tried, where bytes already ruled
out by the longer one are excluded from the counts. Escapes get as much weight
as the context saw different bytes. The last resort is a uniform choice.

Scale. A byte's probability depends on it and the ORDER bytes before it alone,
so each such gram of the corpus is scored once. Counting is combined in each
task and again before the shuffle. The trie is sharded by the last two bytes of
the context: a shard has all longer contexts of its grams, and the orders below
are 65,536 pairs at most, which every task gets. The most frequent grams, GRAMS
at most, are then looked up in each task; only the rest, by their number in each
text, are joined with the scored grams. So are words: those of a share of at
least 1/CELLS of all tokens (CELLS at most) are looked up, the rest joined. The
bounds decide where a value is found, never which.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfect_hash import mix
from .tables import fold_of, stash, text_bytes

#: Beyond five bytes of context text is hardly coded shorter (Cleary and Teahan 1997), while the trie grows threefold with each.
ORDER = 5
#: Bounds on the words and on the grams whose values every task knows.
CELLS, GRAMS = 1 << 20, 1 << 21
_CHUNK = 2 << 20
_FLUSH = 400_000


def normal_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every byte with the order bytes before it, the end byte 0 included, and the text each belongs to.

    Texts start after order zero bytes. A zero byte within a text counts as byte 1.
    """
    pad = bytes(order)
    data = np.frombuffer(pad + b"".join(t.replace(b"\0", b"\1") + (pad or b"\0") for t in texts), np.uint8).astype(np.uint64)
    n = len(data) - order
    codes = np.zeros(n, np.uint64)
    for j in range(order + 1):
        codes |= data[j : j + n] << np.uint64(8 * (order - j))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    step = max(order, 1)
    ends = np.cumsum(sizes + step) - step
    keep = np.ones(n, bool)
    for j in range(1, step):
        at = ends + j
        keep[at[at < n]] = False
    return codes[keep], np.repeat(np.arange(len(texts)), sizes + 1)


def chunks(texts: list[bytes], size: int = _CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    at, held, total = 0, [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= size:
            yield at, held
            at, held, total = at + len(held), [], 0
    if held:
        yield at, held


class _Table:
    """64-bit keys to row numbers, by open addressing at a load of a quarter to a half."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.at = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(1 << bits, np.uint64)
        slot, left = self._home(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.at[slot[left]] < 0
            put = left[free]
            self.at[slot[put]] = put
            won = self.at[slot[left]] == left
            self.keys[slot[left[won]]] = keys[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (len(self.at) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys ^ (keys >> np.uint64(29))
            return ((x * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        row = self.at[slot]
        out = np.where(self.keys[slot] == keys, row, -1)
        open_ = np.flatnonzero((row >= 0) & (self.keys[slot] != keys))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.at) - 1)
            s = slot[open_]
            hit = self.keys[s] == keys[open_]
            out[open_] = np.where(hit, self.at[s], -1)
            open_ = open_[~hit & (self.at[s] >= 0)]
        return out


def _tag(codes: np.ndarray, length: int) -> np.ndarray:
    """Strings of up to 7 bytes as keys that differ by length too."""
    return codes | np.uint64(length << 56)


class PpmModel:
    """Log10 probabilities of bytes after contexts, from counts of (order + 1)-grams."""

    def __init__(self, order: int, pairs: list[tuple[np.ndarray, np.ndarray]]):
        """pairs: for each order from 0, codes of context and byte, and their counts."""
        self.order = order
        byte = np.uint64(255)
        pairs = [(c[np.argsort(c)], n[np.argsort(c)]) for c, n in pairs]
        contexts, first, size, kept, total = [], [], [], [], []
        for j, (codes, counts) in enumerate(pairs):
            ctx, at, of = np.unique(codes >> np.uint64(8), return_index=True, return_counts=True)
            own = np.add.reduceat(counts, at) if len(at) else counts
            seen = own.astype(np.float64)
            if j and len(ctx):
                above, n = pairs[j - 1]
                i = np.minimum(np.searchsorted(above, ctx), max(0, len(above) - 1))
                seen = np.where(above[i] == ctx, np.maximum(seen, n[i]), seen) if len(above) else seen
            contexts.append(ctx), first.append(at), size.append(of), kept.append(own.astype(np.float64)), total.append(seen)
        start = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
        self.pair_key = np.concatenate([_tag(c, j + 1) for j, (c, _) in enumerate(pairs)])
        node_key = np.concatenate([_tag(c, j) for j, c in enumerate(contexts)])
        self.pairs, self.nodes = _Table(self.pair_key), _Table(node_key)
        whole = [t - k + s for t, k, s in zip(total, kept, size)]
        self.log_total = np.concatenate([np.log10(t + s) for t, s in zip(total, size)])
        self.log_escape = np.concatenate([np.log10(w / (t + s)) for w, t, s in zip(whole, total, size)])
        self.down_total, self.down_escape = np.zeros(len(node_key)), np.zeros(len(node_key))
        for j in range(1, len(pairs)):
            codes, _ = pairs[j]
            low, counts = pairs[j - 1]
            suffix = contexts[j] & np.uint64((1 << (8 * (j - 1))) - 1)
            up = np.searchsorted(contexts[j - 1], suffix)
            same = codes & np.uint64((1 << (8 * j)) - 1)
            ruled = counts[np.searchsorted(low, same)].astype(np.float64)
            ruled = np.add.reduceat(ruled, first[j]) if len(first[j]) else ruled
            left = np.maximum(kept[j - 1][up] - ruled, 0)
            escape = np.maximum(total[j - 1][up] - kept[j - 1][up] + size[j - 1][up] - size[j], 1)
            at = slice(start[j], start[j + 1])
            self.down_total[at], self.down_escape[at] = np.log10(left + escape), np.log10(escape / (left + escape))
        self.log_count = np.concatenate([np.log10(n) for _, n in pairs]) if len(self.pair_key) else np.zeros(0)
        self.floor = -np.log10(max(1, 256 - (int(size[0][0]) if len(size[0]) else 0)))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        left, child = np.arange(len(codes)), np.full(len(codes), -1, np.int64)
        for j in range(self.order, -1, -1):
            own = codes[left] if j == self.order else codes[left] & np.uint64((1 << (8 * (j + 1))) - 1)
            pair = self.pairs.find(_tag(own, j + 1))
            node = self.nodes.find(_tag(own >> np.uint64(8), j)).astype(np.int64)
            hit, inside = pair >= 0, child >= 0
            base = np.where(inside, self.down_total[child], self.log_total[node]) if len(self.log_total) else np.zeros(len(left))
            cost = np.where(inside, self.down_escape[child], np.where(node >= 0, self.log_escape[node], 0)) if len(self.log_total) else np.zeros(len(left))
            gain = np.where(hit, (self.log_count[pair] if len(self.log_count) else 0) - base, cost)
            out[left] += gain
            left, child = left[~hit], node[~hit]
        out[left] += self.floor
        return out


def pairs_of(codes: np.ndarray, counts: np.ndarray, order: int, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every order's pairs of at least the given count, from the longest grams."""
    found = []
    for j in range(order + 1):
        u, at = np.unique(codes & np.uint64((1 << (8 * (j + 1))) - 1), return_inverse=True)
        n = np.bincount(at, counts, len(u)).astype(np.int64)
        found.append((u[n >= least], n[n >= least]))
    return found


def shard_scores(codes: np.ndarray, counts: np.ndarray, order: int, low: np.ndarray) -> np.ndarray:
    """Log10 probabilities of grams that share the last two bytes of their context. low: counts of all pairs of bytes."""
    seen = counts > 0
    pairs = pairs_of(codes[seen], counts[seen], order)
    own = int(codes[0]) >> 8 & 255
    for j, n, first in ((0, low.sum(0), 0), (1, low[own], own << 8)):
        if j <= order:
            at = np.flatnonzero(n)
            pairs[j] = (at.astype(np.uint64) + np.uint64(first), n[at])
    return PpmModel(order, pairs).log10(codes)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _hash_words(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 a gram's code, 1 a word's hash, 2 the texts; n counts training texts alone. Sums within a task are flushed when large."""
    words: Counter = Counter()
    texts = 0

    def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), _signed(keys), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    def flush() -> pa.RecordBatch:
        made = out(1, _hash_words(words.keys()), np.fromiter(words.values(), np.int64, len(words)))
        words.clear()
        return made

    for batch in batches:
        left_out = batch.column(1).to_pylist()
        for learnt in (True, False):
            held = [t for t, h in zip(batch.column(0).to_pylist(), left_out) if h != learnt]
            texts += len(held) * learnt
            for _, part in chunks(held):
                split = [normal_words(t) for t in part]
                codes, n = np.unique(grams([b" ".join(w) for w in split], order)[0], return_counts=True)
                yield out(0, codes, n * learnt)
                for w in split if learnt else ():
                    words.update(w)
                    if len(words) > _FLUSH:
                        yield flush()
    yield flush()
    yield out(2, np.zeros(1, np.uint64), np.array([texts]))


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Kind 0: a text's tokens, known ones, sum of log counts and score, without its rarer words and grams; kinds 1 and 2: those."""
    order, common, values, heavy, heavy_n, end_n = shared.value
    table = _Table(common)
    names = ["kind", "row", "h", "tf", "n_known", "log_sum", "score"]
    rest = lambda kind, rows, h, tf: pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), pa.array(rows), _signed(h), pa.array(tf), *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.float64(), pa.float64()))], names)
    for batch in batches:
        rows, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for at, part in chunks(texts):
            own = rows[at : at + len(part)]
            split = [normal_words(t) for t in part]
            codes, of = grams([b" ".join(w) for w in split], order)
            found = table.find(codes)
            hit = found >= 0
            score = np.bincount(of[hit], values[found[hit]], len(part)).astype(np.float64)  # of nothing, bincount gives integers
            codes, of = codes[~hit], of[~hit]
            by = np.lexsort((codes, of))
            codes, of = codes[by], of[by]
            new = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])))) if len(codes) else np.zeros(0, np.int64)
            counts = [Counter(w) for w in split]
            doc = np.repeat(np.arange(len(part)), [len(c) for c in counts])
            h = np.concatenate([_hash_words(c.keys()) for c in counts])
            tf = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts])
            i = np.minimum(np.searchsorted(heavy, h), max(0, len(heavy) - 1))
            known = heavy[i] == h if len(heavy) else np.zeros(len(h), bool)
            c = heavy_n[i[known]]
            n_known = np.bincount(doc[known], tf[known], len(part)).astype(np.int64) + (end_n > 0)
            log_sum = np.bincount(doc[known], tf[known] * np.log10(c + 1.0), len(part)) + np.log10(end_n + 1.0)
            tokens = np.fromiter((len(w) + 1 for w in split), np.int64, len(split))
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(own), pa.nulls(n, pa.int64()), pa.array(tokens), pa.array(n_known), pa.array(log_sum), pa.array(score)], names)
            yield rest(1, own[doc[~known]], h[~known], tf[~known])
            yield rest(2, own[of[new]], codes[new], np.diff(np.append(new, len(codes))))


def ppm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, order: int = ORDER, cells: int = CELLS, common: int = GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for every row.

    Learns from rows whose crc32(id) modulo folds is not held. A-Z is
    lower-cased; tokens are the words and one end. The model codes the words,
    joined by one space, and an end byte.

    Null, empty and blank texts: the end alone. A null id has the empty text's
    fold. Repeated rows count, and are scored, one by one. No training text:
    the base knows nothing and the model is uniform over bytes. Empty table:
    empty result. Other columns are ignored. Words are told apart by 64 bits of
    hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc"), (fold_of(doc_id, folds) == held).alias("held_out"), text_bytes(text).alias("t"))
    counted = rows.select("t", "held_out").mapInArrow(partial(_counted, order=order), "kind tinyint, key long, n long")
    counts = stash(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    sums = {r.kind: (r.n or 0, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).collect()}
    texts = sums.get(2, (0, 0))[0]
    n, v = sums.get(1, (0, 0))[0] + texts, sums.get(1, (0, 0))[1] + (texts > 0)
    grams_ = counts.where("kind = 0").select("key", "n")
    low = np.zeros((256, 256), np.int64)
    for r in grams_.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        low[r.pair >> 8, r.pair & 255] = r.n

    def score_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["key", "n"]].assign(value=shard_scores(pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64), order, low))

    shard = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    scored = stash(grams_.groupBy(shard.alias("shard")).applyInPandas(score_shard, "key long, n long, value double"), "lm-grams")
    rung = F.when(F.col("n") > 0, F.floor(4 * F.log2(F.col("n")))).otherwise(-1)
    often, total = 1 << 10, 0
    for r in sorted(scored.groupBy(rung.alias("rung")).count().collect(), key=lambda r: -r.rung):  # four rungs for each doubling of a count
        total += r["count"]
        if total > common:
            break
        often = r.rung
    known = scored.where(rung >= often).select("key", "value").toArrow()  # common rows at most
    gram_keys, gram_values = known.column("key").to_numpy().view(np.uint64), known.column("value").to_numpy()
    frequent = max(2, -(-n // cells))
    heavy = counts.where((F.col("kind") == 1) & (F.col("n") >= frequent)).select("key", "n").toArrow()  # cells rows at most
    keys = heavy.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    shared = spark.sparkContext.broadcast((order, gram_keys, gram_values, keys[by], heavy.column("n").to_numpy()[by].astype(np.float64), texts))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    made = numbered.select("row", "t", "doc", "held_out").mapInArrow(partial(_with_ids, shared=shared), f"kind tinyint, row long, h long, tf long, n_known long, log_sum double, score double, doc {docs.schema[doc_id].dataType.simpleString()}, held_out boolean")
    made = stash(made, "lm-scores")
    rare = counts.where((F.col("kind") == 1) & (F.col("n") < frequent)).select("kind", F.col("key").alias("h"), F.log10(F.col("n") + 1.0).alias("value"))
    rare = rare.unionByName(scored.where(rung < often).select(F.lit(2).cast("tinyint").alias("kind"), F.col("key").alias("h"), "value"))
    word, value = F.col("kind") == 1, F.col("tf") * F.col("value")
    more = made.where("kind > 0").select("kind", "row", "h", "tf").join(rare, ["kind", "h"]).groupBy("row")
    more = more.agg(F.sum(F.when(word, F.col("tf"))).alias("more_known"), F.sum(F.when(word, value)).alias("more_log"), F.sum(F.when(~word, value)).alias("more_score"))
    whole = made.where("kind = 0").drop("kind", "h").join(more, "row", "left")
    base = F.col("log_sum") + F.coalesce("more_log", F.lit(0.0)) - F.col("tf") * F.log10(F.lit(float(n + v + 1)))
    return whole.select(
        F.col("doc").alias(doc_id), "held_out", F.col("tf").alias("n_tokens"), (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def _with_ids(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """_scored, with the id and fold beside each row of kind 0."""
    for batch in batches:
        done = 0
        for made in _scored(iter([batch.select([0, 1])]), shared):
            if len(made) and made.column(0)[0].as_py() == 0:
                ids = [batch.column(i).slice(done, len(made)) for i in (2, 3)]
                done += len(made)
            else:
                ids = [pa.nulls(len(made), batch.column(i).type) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([*made.columns, *ids], [*made.schema.names, "doc", "held_out"])
