"""Exact search by inner product: ball trees over shards of vectors, searched by branch and bound.

Vectors are dealt to shards of about SHARD rows by a hash, and each shard's
tree is packed into one row: halves along the direction in which a node is
longest, down to LEAF rows; a node keeps its centre, its radius and its smallest
id. No vector of a node can have a greater inner product with q than
q . centre + |q| * radius.

Queries travel in blocks. Each block first searches one shard; what stands
kth there goes with the block to every other shard, and a task that meets a
block in several shards carries on what it has found so far. Within a shard
the nodes that may still hold one of the k best are opened level by level, the
leaves that remain are read in order of their bound, and every better find
closes more of them. Only finds that enter a block's k best leave a task.

Every block meets every shard once, in rows of bounded size: that product is
what the search against all rows is. Nothing goes through the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import NO_ID, stash

#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD, BLOCK, LEAF = 4096, 4096, 64
#: Ends of a long; components and scores beyond them count as the end.
_LEAST, _MOST = -(2**63), 2**63 - 1


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: in doubles where no sum can exceed 2**53, else in Python's integers, cut at the ends of a long."""
    size = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if size(a) * size(b) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)


@dataclass
class BallTree:
    """A balanced tree in the order of levels: node i has the rows starts[i] to stops[i], and the nodes 2i+1 and 2i+2 below it unless it is a leaf."""

    rows: np.ndarray
    ids: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    least: np.ndarray
    depth: int

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> BallTree:
        depth = int(max(0, np.ceil(np.log2(max(1, len(rows)) / leaf))))
        order, exact = np.arange(len(rows)), points.astype(np.float64)
        spans = [(0, len(rows))]
        for i in range(2**depth - 1):
            a, b = spans[i]
            own = exact[order[a:b]]
            if len(own):
                far = own[np.argmax(((own - own[0]) ** 2).sum(1))]
                along = own @ (own[np.argmax(((own - far) ** 2).sum(1))] - far)
                order[a:b] = order[a:b][np.lexsort((ids[order[a:b]], along))]
            spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
        exact, ids = exact[order], ids[order]
        starts, stops = np.array(spans, np.int64).T
        centres, radii, least = np.zeros((len(spans), points.shape[1])), np.zeros(len(spans)), np.zeros(len(spans), np.int64)
        for i, (a, b) in enumerate(spans):
            if b > a:
                same = (exact[a:b] == exact[a]).all()
                centres[i] = exact[a] if same else exact[a:b].mean(0)
                radii[i] = 0 if same else np.sqrt(((exact[a:b] - centres[i]) ** 2).sum(1).max())
                least[i] = ids[a:b].min()
        return cls(rows[order], ids, points[order], starts, stops, centres, radii, least, depth)


class Found:
    """The k best (score, id) of each query so far; what is no better than the kth never enters."""

    def __init__(self, asked: np.ndarray, k: int):
        self.k, self.least = k, np.full(asked, _LEAST, np.int64)
        self.tie, self.full = np.full(asked, _MOST, np.int64), np.zeros(asked, bool)
        self.q, self.ids, self.rows, self.scores = (np.zeros(0, np.int64) for _ in range(4))

    def may(self, q: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether nodes of these bounds and smallest ids may hold one of the k best of the queries q."""
        kth = self.least[q].astype(np.float64)
        return ~self.full[q] | (bound > kth) | (bound == kth) & (least < self.tie[q])

    def add(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        better = ~self.full[q] | (scores > self.least[q]) | (scores == self.least[q]) & (ids < self.tie[q])
        if not better.any():
            return
        q, ids, rows, scores = (np.concatenate((old, x[better])) for old, x in zip((self.q, self.ids, self.rows, self.scores), (q, ids, rows, scores)))
        order = np.lexsort((rows, ids, ~scores, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q = order[place < self.k], q[place < self.k]
        self.q, self.ids, self.rows, self.scores = q, ids[order], rows[order], scores[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[q[last]], self.tie[q[last]], self.full[q[last]] = self.scores[last], self.ids[last], True


def search(tree: BallTree, rows: np.ndarray, points: np.ndarray, found: Found) -> None:
    """Enter the tree's vectors that are among a query's k best; a query's own row is none. Components beyond the shorter length do not count."""
    wide = min(points.shape[1], tree.points.shape[1])
    asked = points[:, :wide].astype(np.float64)
    # the whole centre and query bound the product from above, however far a sum in doubles is off
    length = np.sqrt((asked**2).sum(1))
    q, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    bound = np.full(len(rows), np.inf)

    def bounds(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for at in range(0, len(q), 1 << 17):
            part = slice(at, at + (1 << 17))
            centre = tree.centres[node[part], :wide]
            exact = np.einsum("ij,ij->i", asked[q[part]], centre)
            out[part] = exact + length[q[part]] * tree.radii[node[part]] * (1 + 1e-9)
            out[part] += np.where((tree.radii[node[part]] > 0) | (np.abs(exact) >= 2**52), 1 + 1e-9 * length[q[part]] * np.sqrt((centre**2).sum(1)), 0)
        return out

    for _ in range(tree.depth):
        q, node = np.repeat(q, 2), (2 * node[:, None] + [1, 2]).ravel()
        bound = np.minimum(np.repeat(bound, 2), bounds(q, node))
        keep = (tree.stops[node] > tree.starts[node]) & found.may(q, bound, tree.least[node])
        q, node, bound = q[keep], node[keep], bound[keep]
    order = np.lexsort((-bound, q))
    q, node, bound = q[order], node[order], bound[order]
    place, upto = np.arange(len(q)) - np.searchsorted(q, q), 1
    while len(q):
        now = (place < upto) & found.may(q, bound, tree.least[node])
        for leaf in np.unique(node[now]).tolist():
            own, held = q[now & (node == leaf)], slice(tree.starts[leaf], tree.stops[leaf])
            scores = dot(points[own, :wide], tree.points[held, :wide])
            i, j = np.nonzero((scores >= found.least[own][:, None]) & (tree.rows[held][None, :] != rows[own][:, None]))
            found.add(own[i], tree.ids[held][j], tree.rows[held][j], scores[i, j])
        later = (place >= upto) & found.may(q, bound, tree.least[node])
        q, node, bound, place = q[later], node[later], bound[later], place[later]
        upto *= 2


_PACKED = "rows binary, ids binary, points binary, wide int"


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table, name: str) -> pa.Table:
    """The rows (row, id, x) of one group as bytes."""
    size = np.array([len(v) for v in table.column("x")], np.int64)
    points = np.zeros((len(table), int(size.max(initial=0))), np.int64)
    points[np.arange(points.shape[1])[None, :] < size[:, None]] = table.column("x").combine_chunks().flatten().to_numpy()
    packed = [[x.tobytes()] for x in (table.column("row").to_numpy(), table.column("id").to_numpy(), points)]
    return pa.table({name: pa.array([key[0].as_py()], pa.int32()), **dict(zip(("rows", "ids", "points"), (pa.array(p, pa.binary()) for p in packed))), "wide": pa.array([points.shape[1]], pa.int32())})


def _read(rows: bytes, ids: bytes, points: bytes, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
    return rows, ids, np.frombuffer(points, np.int64).reshape(len(rows), wide)


def _planted(key: tuple[pa.Scalar, ...], table: pa.Table, leaf: int) -> pa.Table:
    """One shard's tree as a row."""
    packed = _pack(key, table, "shard").to_pylist()[0]
    tree = BallTree.build(*_read(*(packed[c] for c in ("rows", "ids", "points", "wide"))), leaf)
    arrays = {"rows": tree.rows, "ids": tree.ids, "points": tree.points, "starts": tree.starts, "stops": tree.stops, "centres": tree.centres, "radii": tree.radii, "least": tree.least}
    return pa.table({"shard": pa.array([packed["shard"]], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in arrays.items()}, "wide": pa.array([packed["wide"]], pa.int32()), "depth": pa.array([tree.depth], pa.int32())})


_TREE = "shard int, rows binary, ids binary, points binary, starts binary, stops binary, centres binary, radii binary, least binary, wide int, depth int"
_FOUND = "block int, q long, id long, row long, score long"


def _tree(row: dict) -> BallTree:
    rows, ids, points = _read(row["rows"], row["ids"], row["points"], row["wide"])
    longs, doubles = (lambda c: np.frombuffer(row[c], np.int64)), (lambda c: np.frombuffer(row[c], np.float64))
    return BallTree(rows, ids, points, longs("starts"), longs("stops"), doubles("centres").reshape(-1, row["wide"]), doubles("radii"), longs("least"), row["depth"])


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a tree and a block of queries, with what the block has found before. A block's finds go on to the task's next row if that is of the same block."""
    held, asked, found = None, None, None

    def out() -> pa.RecordBatch:
        n = len(found.q)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, held, np.int32)), pa.array(found.q), *map(pa.array, (found.ids, found.rows, found.scores))], ["block", "q", "id", "row", "score"])

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["block"] != held:
                if found is not None:
                    yield out()
                held, asked = row["block"], _read(row["q_rows"], row["q_ids"], row["q_points"], row["q_wide"])
                found = Found(len(asked[0]), k)
                if row["found"]:
                    seed = np.frombuffer(row["found"], np.int64).reshape(4, -1)
                    found.add(*seed)
            search(_tree(row), asked[0], asked[2], found)
    if found is not None:
        yield out()


def _seeds(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    columns = np.stack([table.column(c).to_numpy() for c in ("q", "id", "row", "score")])
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "found": pa.array([columns.tobytes()], pa.binary())})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): of each row of queries the k rows of vectors with the greatest inner product, ties to the smaller id.

    Both have (row, id, x): row names the row and is the same for one row on
    either side, so that a row does not find itself; x array<long>, without
    nulls. Fewer rows than k: all. Rows that share an id are rows like others.
    A null id sorts below every other. Vectors of unequal length meet over the
    components that both have. Components and scores beyond a long count as its
    end. Empty tables: empty result.
    """

    def planted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _planted(key, table, leaf)

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _pack(key, table, "block")

    id_of = F.coalesce("id", F.lit(NO_ID)).alias("id")
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, shard), (queries, block)))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    trees = vectors.select("row", id_of, "x", deal(shards).alias("shard")).groupBy("shard").applyInArrow(planted, _TREE)
    trees = stash(trees, "trees")
    asked = queries.select("row", id_of, "x", deal(blocks).alias("block")).groupBy("block").applyInArrow(packed, f"block int, {_PACKED}")
    asked = stash(asked.select("block", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "points", "wide")]), "queries")
    first = F.pmod(F.col("block"), F.lit(shards))
    meet = lambda left, right: left.join(right, ["shard", "block"]).mapInArrow(partial(_met, k=k), _FOUND)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = trees.select("*", every(blocks, "block"))
    seeds = stash(meet(asked.select("*", first.alias("shard"), F.lit(None).cast("binary").alias("found")), dealt), "seeds")
    held = asked.join(seeds.groupBy("block").applyInArrow(_seeds, "block int, found binary"), "block", "left")
    others = held.select("*", every(shards, "shard")).where(F.col("shard") != first)
    found = meet(others, dealt).unionByName(seeds)
    # a task passes on what it was given: the same find may come from several
    names = asked.mapInArrow(_named, "block int, q long, query_id long")
    each = found.groupBy("block", "q", "id", "row").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("block", "q").orderBy(F.desc("score"), "id", "row"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k).join(names, ["block", "q"])
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return best.select(real("query_id").alias("query_id"), "rank", real("id").alias("vec_id"), "score")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a block's queries by their number in it."""
    for batch in batches:
        for row in batch.select(["block", "q_ids"]).to_pylist():
            ids = np.frombuffer(row["q_ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"], np.int32)), pa.array(np.arange(len(ids))), pa.array(ids)], ["block", "q", "query_id"])


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int, offset: int = 0) -> DataFrame:
    """(row, id, x): the vectors without null or non-finite components, each component c as floor(scale * c) + offset, c as double, and scale * c beyond 2**62 either way as that; row numbers the table's rows. Ids are whole numbers. Written once, so that a row keeps its number."""
    c = F.col(embedding).cast("array<double>")
    finite = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = lambda v: F.least(F.greatest(v * F.lit(float(scale)), F.lit(-(2.0**62))), F.lit(2.0**62))
    x = F.transform(c, lambda v: F.floor(held(v)) + F.lit(offset))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.when(finite, x).alias("x")).where("x is not null")
    return stash(rows.select(F.monotonically_increasing_id().alias("row"), "id", "x"), "vectors")
