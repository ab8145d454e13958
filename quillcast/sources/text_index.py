"""A full-text index in a folder, kept up to date by small segments.

A segment holds the documents of one change. Its postings are Parquet, in folders by
a hash of the term and sorted by term; one row is the posting block of a term
over one range of about SPAN documents of the segment: how many documents hold
the term there, the highest count in one of them, the shortest of their lengths,
and each document with its length and the term's positions. What a question
reads is the folders of its terms, the rows of these terms and, where the
documents are not needed, not the documents.

A change writes a segment, or a list of deleted ids, and then one row for each
part that is now live into the manifest, as one file: that is when the change
takes effect, and a change that broke off before leaves no trace. An id that is
deleted, or written again, is dead in every older segment. ``merge`` rewrites
small segments as one without what is dead in them. There is one writer at a
time; readers keep the state that they opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ordering import keep_last, materialise

#: Documents in a range, and folders of terms.
SPAN, BUCKETS = 4096, 32
#: Bytes of text in a range, about, at most.
BYTES = 1 << 26
#: Rows of asked terms that are sent to every task at most; more are joined by shuffles.
FEW = 100_000
#: Dead documents that are sent to every task at most.
FEW_DEAD = 1_000_000

_MANIFEST = "version long, at long, kind string, folder string, documents long"
_DOCS = "id long, length long, r int"
_POSTINGS = "term string, r int, n long, most long, least long, docs array<struct<id:bigint,length:bigint,positions:array<int>>>, bucket int"


def terms_of(text: Column) -> Column:
    """Lower-cased words, in order."""
    return X.words(F.lower(text))


def _blocks(table: pa.Table) -> pa.Table:
    """The posting blocks of one range's documents (r, id, terms)."""
    table = table.sort_by("id")
    lists = table["terms"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy()
    words, ids = lists.flatten().dictionary_encode(), table["id"].to_numpy()
    starts = np.cumsum(size) - size
    order = np.argsort(words.indices.to_numpy(), kind="stable")
    term = words.indices.to_numpy()[order]
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), size)[order]
    first = np.ones(len(term), bool)
    first[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    entry = np.flatnonzero(first)  # where a term's next document begins
    own, held = term[entry], doc[entry]
    count = np.diff(np.append(entry, len(term)))
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])  # where the next term begins
    length = size[held].astype(np.int64)
    positions = pa.ListArray.from_arrays(pa.array(np.append(entry, len(term)).astype(np.int32)), pa.array((order - starts[doc]).astype(np.int32)))
    docs = pa.StructArray.from_arrays([pa.array(ids[held]), pa.array(length), positions], ["id", "length", "positions"])
    empty = np.zeros(0, np.int64)
    columns = {
        "term": words.dictionary.take(pa.array(own[head])), "r": pa.array(np.full(len(head), table["r"][0].as_py(), np.int32)), "n": pa.array(np.diff(np.append(head, len(own)))),
        "most": pa.array(np.maximum.reduceat(count, head) if len(head) else empty), "least": pa.array(np.minimum.reduceat(length, head) if len(head) else empty),
        "docs": pa.ListArray.from_arrays(pa.array(np.append(head, len(own)).astype(np.int32)), docs),
    }
    return pa.Table.from_batches(pa.table(columns).to_batches(max_chunksize=4096), pa.table(columns).schema)


def _part(tf: np.ndarray, length: np.ndarray, k1: float, b: float, mean: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _best(asks: pd.DataFrame, held: pd.DataFrame, k: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.DataFrame:
    """The k best documents of each question (q, term, weight) among those of one range's blocks (term, ids, tf, lengths); a block without a term lists the dead ones."""
    named = held["term"].notna().to_numpy()
    blocks = held[named]
    if not len(asks) or not len(blocks):
        return pd.DataFrame({"q": asks["q"].iloc[:0], "id": np.zeros(0, np.int64), "score": np.zeros(0)})
    every = np.unique(np.concatenate(blocks["ids"].to_list()))
    alive = ~np.isin(every, np.concatenate(held["ids"][~named].to_list() or [np.zeros(0, np.int64)]))
    of = {t: (np.searchsorted(every, i), part(tf.astype(np.float64), n)) for t, i, tf, n in zip(blocks["term"], blocks["ids"], blocks["tf"], blocks["lengths"])}
    found = []
    for q, own in asks.groupby("q"):
        score, met = np.zeros(len(every)), np.zeros(len(every), bool)
        for term, weight in zip(own["term"], own["weight"]):
            if term in of:
                at, value = of[term]
                score[at] += weight * value
                met[at] = True
        rows = np.flatnonzero(met & alive)
        s = np.round(score[rows], 6) + 0.0
        top = np.lexsort((every[rows], -s))[:k]
        found.append(pd.DataFrame({"q": q, "id": every[rows][top], "score": s[top]}))
    return pd.concat(found)


class TextIndex:
    """Documents are rows (id long, text). A null text is a document without words; rows without an id are left out; of several rows with one id in one change, the one with the greatest text counts."""

    def __init__(self, spark: SparkSession, path: str, span: int = SPAN, buckets: int = BUCKETS):
        self.spark, self.path, self.span, self.buckets = spark, path, span, buckets
        self._open: list | None = None
        self._gone: DataFrame | None = None

    # -- the manifest

    def parts(self) -> list:
        """The live parts, oldest first: segments and lists of deleted ids. They are read once, and again after a change or refresh."""
        if self._open is None:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest") if self._exists() else self.spark.createDataFrame([], _MANIFEST)
            last = rows.agg(F.max("version").alias("version"))
            self._open = rows.join(F.broadcast(last), "version").orderBy("at", "kind").collect()  # few: merge keeps them so
        return self._open

    def refresh(self) -> TextIndex:
        """See what others have changed since."""
        self._open = self._gone = None
        return self

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _commit(self, version: int, parts: list[tuple]) -> None:
        rows = [f"({version}L, {at}L, '{kind}', '{folder}', {count}L)" for at, kind, folder, count in parts or [(version, "none", "", 0)]]
        self.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(version, at, kind, folder, documents)").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._open = self._gone = None

    def _state(self) -> tuple[int, list[tuple]]:
        parts = self.parts()
        return max((p.version for p in parts), default=0) + 1, [(p.at, p.kind, p.folder, p.documents) for p in parts if p.kind != "none"]

    # -- changes

    def insert(self, docs: DataFrame) -> None:
        """Add documents; one whose id is there already replaces it."""
        version, parts = self._state()
        rows = docs.select(F.col("id").cast("long").alias("id"), "text").where("id is not null")
        count, different, size = rows.agg(F.count("*"), F.count_distinct("id"), F.sum(F.octet_length("text"))).first()
        if count > different:
            rows, count = materialise(keep_last(rows, "id", "text")), different
        ranges = max(1, -(-count // self.span), -(-(size or 0) // BYTES))
        dealt = rows.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
        # texts are moved to their range once, and its blocks are made where they are
        terms = dealt.repartition(ranges, "r").select("r", "id", terms_of(F.col("text")).alias("terms"))
        blocks = terms.groupBy("r").applyInArrow(_blocks, _POSTINGS.rsplit(",", 1)[0])
        folder = f"{version}-{uuid.uuid4().hex}"
        self._write(blocks, folder)
        dealt.select("id", F.size(terms_of(F.col("text"))).cast("long").alias("length"), "r").write.parquet(f"{self.path}/docs/{folder}")
        self._commit(version, [*parts, (version, "docs", folder, count)])

    def _write(self, blocks: DataFrame, folder: str) -> None:
        placed = blocks.withColumn("bucket", self._bucket(F.col("term")))
        placed.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/postings/{folder}")

    def _grouped(self, held: DataFrame) -> DataFrame:
        """Blocks of rows (r, term, id, length, positions) that are dealt by r."""
        size = F.size("positions").cast("long")
        return held.groupBy("term", "r").agg(
            F.count("*").alias("n"), F.max(size).alias("most"), F.min("length").alias("least"), F.sort_array(F.collect_list(F.struct("id", "length", "positions"))).alias("docs")
        )

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def delete(self, ids: DataFrame) -> None:
        """Ids (id) that are not there are ignored."""
        version, parts = self._state()
        gone, folder = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct(), f"{version}-{uuid.uuid4().hex}"
        gone.write.parquet(f"{self.path}/deleted/{folder}")
        self._commit(version, [*parts, (version, "deleted", folder, 0)])

    def merge(self, most: int = 1) -> None:
        """Rewrite the smallest segments as one, so that at most so many remain."""
        version, parts = self._state()
        segments = sorted((p for p in parts if p[1] == "docs"), key=lambda p: p[3])
        old = segments[: len(segments) - most + 1] if len(segments) > most or most == 1 and any(p[1] == "deleted" for p in parts) else []
        if not old:
            return
        docs = materialise(self.documents(old).select("at", "id", "length"))
        count, folder = docs.count(), f"{version}-{uuid.uuid4().hex}"
        ranges = max(1, -(-count // self.span))
        new = F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int").alias("r")
        rows = self._alive(self._postings(old).select("at", "term", F.explode("docs").alias("d")).select("at", "term", "d.*"))
        self._write(self._grouped(rows.select(new, "term", "id", "length", "positions").repartition(ranges, "r")), folder)
        docs.select("id", "length", new).write.parquet(f"{self.path}/docs/{folder}")
        rest = [p for p in parts if p not in old]
        oldest = min((p[0] for p in rest if p[1] == "docs"), default=version)
        self._commit(version, [p for p in rest if p[1] == "docs" or p[0] > oldest] + [(version, "docs", folder, count)])

    # -- what is live

    def _read(self, what: str, parts: list[tuple], schema: str) -> DataFrame:
        found = [self.spark.read.schema(schema).parquet(f"{self.path}/{what}/{folder}").withColumn("at", F.lit(at)) for at, _, folder, _ in parts]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{schema}, at long")

    def _postings(self, parts: list[tuple]) -> DataFrame:
        return self._read("postings", parts, _POSTINGS)

    def documents(self, of: list[tuple] | None = None) -> DataFrame:
        """(at, id, length, r) of all live documents, at being the version of their segment."""
        _, parts = self._state()
        docs = self._read("docs", [p for p in parts if p[1] == "docs"], _DOCS)
        gone = self._read("deleted", [p for p in parts if p[1] == "deleted"], "id long")
        last = docs.select("id", F.col("at").alias("live"), F.lit(None).cast("long").alias("dead")).unionByName(gone.select("id", F.lit(None).cast("long").alias("live"), F.col("at").alias("dead")))
        last = last.groupBy("id").agg(F.max("live").alias("live"), F.max("dead").alias("dead")).where("live is not null and (dead is null or dead < live)").select("id", F.col("live").alias("at"))
        if of is not None:
            docs = docs.where(F.col("at").isin([p[0] for p in of]))
        return docs.join(last, ["id", "at"]).select("at", "id", "length", "r")

    def _dead(self) -> DataFrame:
        """(at, id) of the documents in segments that are live no more, written once and then read."""
        if self._gone is None:
            docs = self._read("docs", [p for p in self._state()[1] if p[1] == "docs"], _DOCS).select("at", "id")
            self._gone = materialise(docs.join(self.documents().select("at", "id"), ["at", "id"], "left_anti"))
        return self._gone

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (at, id, ...) of live documents: a few dead ones are sent to every task, rows that many could be among are joined by shuffles."""
        dead = self._dead()
        count = dead.count()
        return rows.join(F.broadcast(dead) if count <= FEW_DEAD else dead, ["at", "id"], "left_anti") if count else rows

    def _asked(self, asked: DataFrame, columns: list[str]) -> DataFrame:
        """Posting blocks, in the given columns, of the asked terms (q, term, ...): from their folders alone, if they are few."""
        blocks = self._postings([p for p in self._state()[1] if p[1] == "docs"])
        names = asked.select("term").distinct()
        count = names.count()
        if count <= FEW:
            held = [r[0] for r in names.select(self._bucket(F.col("term")).alias("b")).distinct().collect()]  # as many as there are folders
            blocks, names = blocks.where(F.col("bucket").isin(held)), F.broadcast(names)
        return blocks.join(names, "term", "left_semi").select(*columns)

    # -- questions

    def counts(self, asked: DataFrame) -> DataFrame:
        """(term, df): the live documents that hold each asked term (q, term)."""
        ids = self._asked(asked, ["term", "at", "docs"]).select("term", "at", F.explode("docs.id").alias("id"))
        return self._alive(ids).groupBy("term").agg(F.count("*").alias("df"))

    def _all(self, asked: DataFrame) -> DataFrame:
        """(q, at, id, term, positions) of the live documents that hold all of a question's terms: those of its rarest one, tried against the others' blocks of the same range."""
        asked = materialise(asked.select("q", "term").distinct())
        heads = self._asked(asked, ["term", "n"]).groupBy("term").agg(F.sum("n").alias("n"))
        known = asked.join(heads, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        first = known.groupBy("q").agg(F.min(F.struct("n", "term")).alias("f"), F.count("*").alias("m")).select("q", "m", F.col("f.term").alias("term"))
        rare = self._asked(first, ["term", "at", "r", "docs"]).select("term", "at", "r", F.explode("docs.id").alias("id"))
        open_ = materialise(first.join(self._alive(rare), "term").select("q", "m", "at", "r", "id"))
        wanted = open_.select("q", "at", "r").distinct().join(asked, "q").select("term", "at", "r").distinct()
        met = self._asked(asked, ["term", "at", "r", "docs"]).join(wanted, ["term", "at", "r"], "left_semi")
        held = met.select("term", "at", F.explode("docs").alias("d")).select("term", "at", "d.id", "d.positions")
        tried = open_.select("at", "id").distinct()
        held = held.join(F.broadcast(tried) if tried.count() <= FEW_DEAD else tried, ["at", "id"], "left_semi")
        found = open_.join(asked, "q").join(held, ["term", "at", "id"])
        whole = found.groupBy("q", "at", "id", "m").agg(F.collect_list(F.struct("term", "positions")).alias("t")).where(F.size("t") == F.col("m"))
        return whole.select("q", "at", "id", F.explode("t").alias("t")).select("q", "at", "id", "t.term", "t.positions")

    def all_of(self, questions: DataFrame) -> DataFrame:
        """(q, id): the documents that hold every word of a question (q, text). A question without words finds nothing."""
        asked = questions.select("q", F.explode(terms_of(F.col("text"))).alias("term"))
        return self._all(asked).select("q", "id").distinct()

    def phrase(self, questions: DataFrame) -> DataFrame:
        """(q, id, count): the documents that hold a question's words one after the other, and how often."""
        placed = materialise(questions.select("q", F.posexplode(terms_of(F.col("text"))).alias("i", "term")))
        size = placed.groupBy("q").agg(F.count("*").alias("words"))
        starts = self._all(placed).join(placed, ["q", "term"]).select("q", "id", F.explode("positions").alias("p"), "i").select("q", "id", (F.col("p") - F.col("i")).alias("start"))
        hits = starts.groupBy("q", "id", "start").agg(F.count("*").alias("n")).join(size, "q").where("n = words")
        return hits.groupBy("q", "id").agg(F.count("*").alias("count"))

    def ranked(self, questions: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, first: int = 1) -> DataFrame:
        """(q, id, score, rank): the k best documents by BM25 among those that hold a word of the question, ties by id.

        A range's blocks bound what a document in it can score. The documents
        of a question's ``first`` best bounded ranges are scored, and then those of the
        ranges alone whose bound reaches the kth score found. Negative idf
        become epsilon times the mean idf of the index's terms.
        """
        asked = materialise(questions.select("q", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("m")))
        live = materialise(self.documents())
        n, mean = live.where("length > 0").agg(F.count("*"), F.avg("length")).first()
        if not n:
            return self.spark.createDataFrame([], f"q {questions.schema['q'].dataType.simpleString()}, id long, score double, rank int")
        idf = lambda df: F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)
        touched = [r[0] for r in self._dead().select("at").distinct().collect()]  # segments
        blocks = self._postings([p for p in self._state()[1] if p[1] == "docs"])
        every = blocks.where(~F.col("at").isin(touched)).select("term", "n")
        if touched:
            old = blocks.where(F.col("at").isin(touched)).select("term", "at", F.explode("docs.id").alias("id"))
            every = every.unionByName(self._alive(old).select("term", F.lit(1).cast("long").alias("n")))
        every = every.groupBy("term").agg(F.sum("n").alias("df"))
        every = materialise(every.select("term", idf(F.col("df")).alias("idf")))
        floor = (every.agg(F.avg("idf")).first()[0] or 0.0) * epsilon
        weighed = materialise(asked.join(every, "term").select("q", "term", (F.col("m") * F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf"))).alias("weight")))
        part = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(float(mean))))
        heads = self._asked(weighed, ["term", "at", "r", "most", "least"])
        # a term of negative weight adds nothing to a bound
        bounds = weighed.join(heads, "term").groupBy("q", "at", "r").agg(F.sum(F.greatest(F.lit(0.0), F.col("weight") * part(F.col("most"), F.col("least")))).alias("bound"))
        place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound"), "at", "r"))
        bounds = materialise(bounds.withColumn("place", place))
        schema = f"q {weighed.schema['q'].dataType.simpleString()}, id long, score double"
        compact = F.struct(F.col("docs.id").alias("ids"), F.transform("docs", lambda d: F.size(d["positions"])).alias("tf"), F.col("docs.length").alias("lengths"))
        blocks = self._asked(weighed, ["term", "at", "r", compact.alias("c")]).select("term", "at", "r", "c.*")
        best = partial(_best, k=k, part=partial(_part, k1=k1, b=b, mean=float(mean)))
        dead = self._dead().join(self._read("docs", [p for p in self._state()[1] if p[1] == "docs"], _DOCS), ["at", "id"]).groupBy("at", "r").agg(F.collect_list("id").alias("dead")) if touched else None

        def scored(ranges: DataFrame) -> DataFrame:
            """The k best of each question and range; all blocks of a range meet in one task, each once whatever the number of questions."""
            asks = ranges.select("q", "at", "r").join(weighed, "q").select("at", "r", "q", "term", "weight")
            held = blocks.select("at", "r", "term", "ids", "tf", "lengths")
            if dead is not None:
                held = held.unionByName(dead.select("at", "r", F.col("dead").alias("ids")), allowMissingColumns=True)
            return asks.groupBy("at", "r").cogroup(held.groupBy("at", "r")).applyInPandas(lambda a, h: best(a, h), schema)

        top = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        early = materialise(top(scored(bounds.where(F.col("place") <= first))))
        kth = early.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
        rest = bounds.where(F.col("place") > first).join(kth, "q", "left").where("kth is null or bound >= kth - 0.000001")
        return top(early.drop("rank").unionByName(scored(rest))).select("q", "id", "score", "rank")
