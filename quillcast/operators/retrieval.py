"""Ranked retrieval: BM25 over term postings and exact nearest neighbours in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import materialise


@dataclass
class _Asked:
    """Questions of one window: the places of their own terms among all that are asked for, by question these terms' weights, and the window's mean length."""

    low: int | None
    high: int | None
    mean: float
    names: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    present: np.ndarray


def _best_of(batches: Iterator[pa.RecordBatch], terms: pa.Array, asked: list[_Asked], k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            doc, day = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place = pc.index_in(pc.list_flatten(batch.column(2)), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(doc)), size)[place >= 0]
            tf = np.bincount(row * len(terms) + place[place >= 0], minlength=len(doc) * len(terms)).reshape(len(doc), -1).astype(np.float64)
            for w in asked:
                own = np.flatnonzero((size > 0) & ((day >= w.low) & (day <= w.high) if w.low is not None else True))
                if not len(own):
                    continue
                t = tf[np.ix_(own, w.places)]
                s = np.round(t * (k1 + 1) / (t + k1 * (1 - b + b * size[own, None] / w.mean)) @ w.weights, 6) + 0.0
                s[(t > 0).astype(np.float32) @ w.present == 0] = -np.inf
                s, d = s.T, doc[own]
                top = np.lexsort((np.broadcast_to(d, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, top, 1)
                keep = np.isfinite(best).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(w.names, top.shape[1])[keep]), pa.array(d[top].ravel()[keep]), pa.array(best.ravel()[keep])], ["q", "doc", "score"])


def bm25(docs: DataFrame, questions: DataFrame, question: str, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, days: int | None = None, block: int = 256) -> DataFrame:
    """(question, doc, score, rank): the k best documents of each question that share a term with it, ties by document.

    docs (doc long, terms), questions (question long, terms). With days, docs
    have a date day and questions a date cut: each question meets an index of
    the documents from so many days before its cut to the cut, whose document
    frequencies, mean length and mean idf count. A negative idf becomes epsilon
    times the mean idf of the index's terms.

    Frequencies of terms and lengths are counted by day in one pass, and added
    up for each window where the counts of a term lie: windows that overlap send
    no term twice, as the mean idf needs only how many terms have a frequency.
    A window's scores are products of its own terms. Questions go through in blocks of a fixed size, their
    terms with them; documents are scored where they are read, and only the k
    best of each batch move.
    """
    spark = docs.sparkSession
    day = F.datediff(F.col("day"), F.lit("1970-01-01")).cast("int") if days is not None else F.lit(0)
    docs = docs.select("doc", day.alias("day"), "terms").where("day is not null")
    cut = F.datediff(F.col("cut"), F.lit("1970-01-01")).cast("int") if days is not None else F.lit(0)
    questions = questions.select(F.col(question).alias("q"), cut.alias("cut"), "terms").where("cut is not null and q is not null")
    cuts = questions.select("cut").distinct()
    reach = F.explode(F.sequence(F.col("cut") - (days or 0), F.col("cut"))).alias("day")
    windows = cuts.select("cut", reach)
    first = F.col("pos") == 0  # once for each document with terms
    held = docs.select("day", F.size("terms").alias("dl"), F.posexplode(F.array_distinct("terms")).alias("pos", "term")).groupBy("day", "term")
    held = materialise(held.agg(F.count("*").alias("df"), F.count_if(first).alias("n"), F.sum(F.when(first, F.col("dl"))).alias("dl")))
    sizes = held.groupBy("day").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    sizes = materialise(windows.join(sizes, "day").groupBy("cut").agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("mean")))
    added = lambda rows: rows.select("day", "term", "df").repartition("term").join(F.broadcast(windows), "day").groupBy("cut", "term").agg(F.sum("df").alias("df"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    counts = added(held).groupBy("cut", "df").agg(F.count("*").alias("m")).join(sizes, "cut")  # how many terms have a frequency
    floor = counts.groupBy("cut").agg((F.sum(F.col("m") * idf) / F.sum("m") * epsilon).alias("floor"))
    asked = questions.select("q", "cut", F.explode("terms").alias("term")).groupBy("q", "cut", "term").agg(F.count("*").alias("m"))
    raw = added(held.join(asked.select("term").distinct(), "term", "left_semi")).join(sizes, "cut").select("cut", "term", "mean", idf.alias("idf"))
    idf = F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))
    asked = materialise(asked.join(raw, ["cut", "term"]).join(floor, "cut").select("q", "cut", "term", "mean", (F.col("m") * idf).alias("weight")))
    blocks = max(1, -(-questions.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    found = []
    for i in range(blocks):
        rows = asked.where(F.col("block") == i).toPandas()  # a block of questions
        terms = np.unique(rows["term"].to_numpy().astype(object)) if len(rows) else []
        place = {t: j for j, t in enumerate(terms)}
        windows_of = []
        for c, own in rows.groupby("cut"):
            names = np.sort(own["q"].unique()).astype(np.int64)
            places, at = np.unique(own["term"].map(place), return_inverse=True)
            at = at, np.searchsorted(names, own["q"])
            weights = np.zeros((len(places), len(names)))
            weights[at] = own["weight"]
            present = np.zeros(weights.shape, np.float32)
            present[at] = 1
            windows_of.append(_Asked(int(c) - days if days is not None else None, int(c) if days is not None else None, float(own["mean"].iloc[0]), names, places, weights, present))
        if windows_of:
            found.append(docs.mapInArrow(partial(_best_of, terms=pa.array(list(terms), pa.string()), asked=windows_of, k=k, k1=k1, b=b), "q long, doc long, score double"))
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "q long, doc long, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("q", question)


#: Products of queries and vectors that a task holds at once.
_PRODUCTS = 1 << 20


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of length 1. What has no direction becomes NaN."""
    lists = column.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if (size != size[0]).any():
        raise ValueError("vectors differ in length")
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    with np.errstate(invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_of_rows(s: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest finite scores of each row, greatest first, ties by d: only what reaches a row's kth score is sorted."""
    least = np.partition(s, -k, axis=1)[:, -k, None] if k < s.shape[1] else -np.inf
    row, column = np.nonzero((s >= least) & np.isfinite(s))
    order = np.lexsort((d[column], -s[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _nearest_of(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest of one part's vectors for each query of one block, a few queries at a time."""
    found = [pa.table({"q": pa.array([], pa.int64()), "d": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})]
    if len(left) and len(right):
        (q, a), (d, b) = ((x.column(c).to_numpy().astype(np.int64), _units(x.column("v"))) for x, c in ((left, "q"), (right, "d")))
        step = max(1, _PRODUCTS // len(d))
        for at in range(0, len(q), step):
            names = q[at : at + step]
            s = np.round(a[at : at + step] @ b.T, 6)
            s[(names[:, None] == d[None, :]) | np.isnan(s)] = -np.inf
            row, column = best_of_rows(s, d, k)
            found.append(pa.table({"q": names[row], "d": d[column], "s": s[row, column]}))
    return pa.concat_tables(found)


def knn(queries: DataFrame, vectors: DataFrame, vec_id: str, embedding: str, k: int, block: int = 4096, part: int = 20_000) -> DataFrame:
    """(q, d, s): for each query its k nearest other vectors by cosine, ties by id. Null vectors neither ask nor answer.

    Queries are dealt to blocks and vectors to parts, each of about a fixed
    size, and every block meets every part in a task of its own, whatever the
    number of either. Only k rows a query and part move on, and a task holds the
    products of a few queries at a time.
    """
    own = lambda df, names: df.select(*[F.col(c).alias(n) for c, n in zip((vec_id, embedding), names)]).where(F.col(names[1]).isNotNull())
    asked, held = own(queries, ("q", "v")), own(vectors, ("d", "v"))
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((asked, block), (held, part)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = asked.select("q", F.col("v").cast("array<double>"), dealt("q", blocks).alias("block"), every(parts).alias("part"))
    held = held.select("d", F.col("v").cast("array<double>"), dealt("d", parts).alias("part"), every(blocks).alias("block"))

    out = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(partial(_nearest_of, k=k), "q long, d long, s double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "d"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def knn_as_of(near: DataFrame, passages: DataFrame, docs: DataFrame, cutoffs: DataFrame, days: int, k: int) -> DataFrame:
    """(q, doc, rank, s): the neighbours near (q, d, s) as documents dated strictly before their question's cutoff less days.

    passages (d, doc), docs (doc, date in seconds), cutoffs (q, cutoff). The date
    is tested after the search, so fewer than k documents may remain. A document
    counts once, by its best passage; passages without a document are left out.
    """
    joined = near.join(passages, "d").join(docs, "doc").join(cutoffs, "q").where(F.col("date") < F.col("cutoff") - days * 86400)
    best = joined.groupBy("q", "doc").agg(F.min(F.struct((-F.col("s")).alias("s"), "d")).alias("b"))
    rank = F.row_number().over(W.partitionBy("q").orderBy("b.s", "b.d"))
    return best.select("q", "doc", rank.alias("rank"), (-F.col("b.s")).alias("s")).where(F.col("rank") <= k)


def yes_share(yes: Column, no: Column, missing: float = -10.0) -> Column:
    """exp(yes) / (exp(yes) + exp(no)) of two logits; a missing one counts as -10."""
    return 1 / (1 + F.exp(F.coalesce(no, F.lit(missing)) - F.coalesce(yes, F.lit(missing))))


def verdict_probability(log_yes: Column, log_no: Column) -> Column:
    """p1 / (p1 + p0) from log probabilities, to three places; an absent side counts as 0."""
    one, zero = F.coalesce(F.exp(log_yes), F.lit(0.0)), F.coalesce(F.exp(log_no), F.lit(0.0))
    return F.round(one / F.nullif(one + zero, F.lit(0.0)), 3)


def fresh_cutoffs(questions: DataFrame, cutoff: str, days: int) -> DataFrame:
    """Adds index_cutoff: the first day of the fixed bucket of so many days, shared by the questions that may use one index.

    With 0 days each cutoff stands for itself. Buckets depend on the date alone, not on the order of questions.
    """
    day = F.datediff(F.to_date(cutoff), F.lit("1970-01-01"))
    start = F.to_date(cutoff) if days == 0 else F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(day / days) * days).cast("int"))
    return questions.withColumn("index_cutoff", start)


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """first (q, u, a) and second (q, u, b), ranks of items: overlap, items of one side alone and the mean shift of common ranks (0 without any)."""
    both = first.join(second, ["q", "u"], "full")
    a, b = F.col("a"), F.col("b")
    return both.groupBy("q").agg(
        F.count_if(a.isNotNull() & b.isNotNull()).alias("overlap"), F.count_if(b.isNull()).alias("only_first"), F.count_if(a.isNull()).alias("only_second"),
        F.coalesce(F.avg(F.abs(a - b)), F.lit(0.0)).alias("shift"),
    )
