"""A stored index of vectors for top-k search by cosine: codes in folders by cell, and exact vectors beside them.

Cells are the nearest of some centroids; within a cell the difference from the
centroid is cut into parts, and each part is stored as the number of its nearest
codeword. A search reads the folders of the cells nearest to its queries, sums
up distances from tables of query part by codeword, and ranks the best of
these by the exact vectors. Centroids and codewords are fitted on SAMPLE rows
at most; every row is indexed. A cell of more than PART rows is cut into parts.

Cells, or parts of them, are searched in about BUNDLES bundles of up to MOST rows,
and queries in blocks of about BLOCK. Each block meets each bundle in a group of its
own, from which only a pool for each query leaves, however many cells it probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import materialise
from ..operators.retrieval import best_of_rows, knn

#: Rows that the fit sees at most, rows of a cell's part, cells at most, and codewords of a part.
SAMPLE, PART, CELLS, WORDS = 65_536, 50_000, 4096, 256
#: Queries in a block, bundles, rows of a bundle at least and at most (more rows make more bundles), and products that a task holds at once.
BLOCK, BUNDLES, LEAST, MOST, PRODUCTS = 1024, 4, 2048, 200_000, 1 << 21
#: Queries whose exact neighbours an audit looks up, at most.
AUDIT = 200


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k distinct rows; a centre that loses all its rows stays."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(x[at : at + 4096] @ centres.T - half, 1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Codebook:
    """Centroids of cells, and for each part of the dimensions its codewords."""

    centroids: np.ndarray
    bounds: list[int]
    words: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, parts: int, rounds: int = 12) -> Codebook:
        centroids = _means(x, cells, rounds, 1)
        rest = x - centroids[nearest(x, centroids)]
        bounds = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int).tolist()
        return cls(centroids, bounds, [_means(rest[:, a:b], WORDS, rounds, 2 + a) for a, b in zip(bounds, bounds[1:])])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        return cell, np.stack([nearest(rest[:, a:b], w) for a, b, w in zip(self.bounds, self.bounds[1:], self.words)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part, the products of every query's part with the codewords."""
        return [q[:, a:b] @ w.T for a, b, w in zip(self.bounds, self.bounds[1:], self.words)]


def _unit(column: pa.Array) -> np.ndarray:
    x = np.stack(column.to_pylist()).astype(np.float64) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(batches: Iterator[pa.RecordBatch], book: Codebook) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _unit(batch.column(1))
            cell, code = book.encode(x)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(x), pa.list_(pa.float64()))], ["cell", "id", "code", "v"])


def _probes(batches: Iterator[pa.RecordBatch], book: Codebook, probes: int) -> Iterator[pa.RecordBatch]:
    """The cells nearest to each query, by the product with their centroid, nearest first."""
    for batch in batches:
        if batch.num_rows:
            x = _unit(batch.column(1))
            cells = np.argsort(-(x @ book.centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))], ["q", "v", "cells"])


def _pooled(left: pa.Table, right: pa.Table, book: Codebook, pool: int) -> pa.Table:
    """The pool best by codes of one bundle's vectors for each query of one block, among the cells that the query probes; ties by id."""
    found = [pa.table({"q": pa.array([], pa.int64()), "d": pa.array([], pa.int64()), "cell": pa.array([], pa.int32()), "near": pa.array([], pa.float64())})]
    if len(left) and len(right):
        right = right.select(["cell", "id", "code"]).sort_by("cell")
        cell, d = right.column("cell").to_numpy(), right.column("id").to_numpy()
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(right), -1)
        held, starts = np.unique(cell, return_index=True)
        spans = list(zip(held, starts, [*starts[1:], len(cell)]))
        q, v, cells = left.column("q").to_numpy(), left.column("v").combine_chunks().flatten().to_numpy().reshape(len(left), -1), left.column("cells").combine_chunks()
        probed = np.zeros((len(q), len(book.centroids)), bool)
        probed[np.repeat(np.arange(len(q)), pc.list_value_length(cells).to_numpy()), cells.flatten().to_numpy()] = True
        step = max(1, PRODUCTS // len(d))
        for at in range(0, len(q), step):
            names, x = q[at : at + step], v[at : at + step]
            tables, near = book.tables(x), np.full((len(names), len(d)), -np.inf)
            for c, a, b in spans:
                asking = np.flatnonzero(probed[at : at + step, c])
                if len(asking):
                    s = np.repeat((x[asking] @ book.centroids[c])[:, None], b - a, 1)
                    for i, table in enumerate(tables):
                        s += np.take(table[asking], code[a:b, i], axis=1)
                    near[asking, a:b] = s
            near[names[:, None] == d[None, :]] = -np.inf
            row, column = best_of_rows(near, d, pool)
            found.append(pa.table({"q": names[row], "d": d[column], "cell": cell[column], "near": near[row, column]}))
    return pa.concat_tables(found)


def _bundled(cells: list, most: int) -> list[tuple[int, int, int]]:
    """(cell, part, bundle): parts of cells, each with its share of the cell's rows, one after the other in bundles of ``most`` rows at most, or one part."""
    size = min(most, max(LEAST, sum(c.rows for c in cells) // BUNDLES))
    placed, bundle, rows = [], 0, 0.0
    for c in cells:
        for i in range(c.parts):
            if rows and rows + c.rows / c.parts > size:
                bundle, rows = bundle + 1, 0.0
            placed.append((c.cell, i, bundle))
            rows += c.rows / c.parts
    return placed


def _usable(df: DataFrame, key: str, embedding: str) -> DataFrame:
    """Rows with an id and a vector that has a direction: no null, no value that is not finite, not all zeros."""
    v = F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & whole)


class VectorIndex:
    """The index of one table in a folder. Vectors without a direction, and rows without an id, are not in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cells: int | None = None, parts: int = 16, sample: int = SAMPLE) -> VectorIndex:
        """Fit and write. cells: the root of the rows, CELLS at most, if not given. All vectors have one length; others are an error."""
        rows = _usable(vectors, vec_id, embedding)
        n = rows.count()
        cells = cells or max(1, min(CELLS, round(n**0.5)))
        seen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column(0)  # sample rows at most
        if not n:
            self.spark.createDataFrame([], "cell int, centroid array<double>").write.parquet(f"{self.path}/cells")
            return self
        book = Codebook.fit(_unit(seen), cells, parts)
        coded = materialise(rows.mapInArrow(partial(_coded, book=book), "cell int, id long, code binary, v array<double>"))
        sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("rows"))
        placed = materialise(coded.join(F.broadcast(sizes.drop("rows")), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))  # a row for each cell
        for name, column in (("codes", "code"), ("vectors", "v")):
            placed.select("cell", "part", "id", column).repartition("cell", "part").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{self.path}/{name}")
        centres = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(book.centroids)], "cell int, centroid array<double>")
        centres.join(sizes, "cell", "left").coalesce(1).write.parquet(f"{self.path}/cells")
        words = [(i, book.bounds[i], book.bounds[i + 1], w.tolist()) for i, w in enumerate(book.words)]
        self.spark.createDataFrame(words, "i int, start int, stop int, words array<array<double>>").coalesce(1).write.parquet(f"{self.path}/words")
        return self

    def book(self) -> Codebook | None:
        centres = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # CELLS at most
        if not centres:
            return None
        words = self.spark.read.parquet(f"{self.path}/words").orderBy("i").collect()
        return Codebook(np.array([c.centroid for c in centres]), [words[0].start] + [w.stop for w in words], [np.array(w.words) for w in words])

    def search(self, queries: DataFrame, k: int, probes: int, pool: int = 200, query_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
        """(q, d, s, rank): for each query up to k other vectors of the ``probes`` nearest cells, by cosine to six places, ties by id.

        The ``pool`` best of each query by codes are ranked by their exact
        vectors. Queries without a direction or an id get none.
        """
        book = self.book()
        if book is None:
            return self.spark.createDataFrame([], "q long, d long, s double, rank int")
        near = materialise(_usable(queries, query_id, embedding).mapInArrow(partial(_probes, book=book, probes=probes), "q long, v array<double>, cells array<int>"))
        cells = [r[0] for r in near.select(F.explode("cells")).distinct().collect()]  # CELLS at most
        sizes = self.spark.read.parquet(f"{self.path}/cells").where(F.col("parts").isNotNull() & F.col("cell").isin(cells))
        pieces = _bundled(sizes.orderBy("cell").collect(), MOST)  # CELLS, and one for PART rows, at most
        placed = self.spark.createDataFrame(pieces, "cell int, part int, bundle int")
        bundles = self.spark.createDataFrame([(b, sorted({piece[0] for piece in group})) for b, group in groupby(pieces, lambda piece: piece[2])], "bundle int, held array<int>")
        blocks = max(1, -(-near.count() // BLOCK))
        groups = blocks * (pieces[-1][2] + 1 if pieces else 1)
        block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")
        asked = near.crossJoin(F.broadcast(bundles)).select("bundle", block, "q", "v", F.array_intersect("cells", "held").alias("cells")).where(F.size("cells") > 0)
        only = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("cell").isin(cells))
        codes = only("codes", "part int, id long, code binary, cell int").join(F.broadcast(placed), ["cell", "part"])
        codes = codes.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cell", "id", "code")
        # as many partitions as groups, so that few groups share a task
        asked, codes = (x.repartition(groups, "bundle", "block").groupBy("bundle", "block") for x in (asked, codes))
        found = asked.cogroup(codes).applyInArrow(partial(_pooled, book=book, pool=pool), "q long, d long, cell int, near double")
        place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("near"), "d"))
        kept = materialise(found.withColumn("place", place).where(F.col("place") <= pool).select("q", "d", "cell"))
        exact = only("vectors", "id long, v array<double>, cell int").select("cell", F.col("id").alias("d"), F.col("v").alias("w"))
        rows = kept.join(exact, ["cell", "d"]).join(near.select("q", "v").dropDuplicates(["q"]), "q")
        s = F.round(F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b), 6) + 0.0
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "d"))
        return rows.select("q", "d", s.alias("s")).withColumn("rank", rank).where(F.col("rank") <= k)

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.95, query_id: str = "vec_id", embedding: str = "embedding") -> int:
        """The fewest cells to probe that hold the target part of the exact k nearest of AUDIT queries, in the order of a hash, at most."""
        book = self.book()
        if book is None:
            return 1
        asked = _usable(queries, query_id, embedding).orderBy(F.xxhash64("id"), "id").limit(AUDIT)
        held = self.spark.read.schema("id long, v array<double>, cell int").parquet(f"{self.path}/vectors")
        exact = knn(asked, held, "id", "v", k).join(held.select(F.col("id").alias("d"), "cell"), "d").select("q", "cell")
        order = asked.mapInArrow(partial(_probes, book=book, probes=len(book.centroids)), "q long, v array<double>, cells array<int>")
        order = order.select("q", F.posexplode("cells").alias("place", "cell")).withColumn("place", F.col("place") + 1)
        ranks = exact.join(order, ["q", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # CELLS at most
        total, found = sum(r.n for r in ranks), 0
        for r in ranks:
            found += r.n
            if found >= target * total:
                return r.place
        return len(book.centroids)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of the exact pairs (q, d) that was found."""
    return found.join(exact.select("q", "d"), ["q", "d"], "left_semi").count() / max(1, exact.count())
