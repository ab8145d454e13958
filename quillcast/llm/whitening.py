"""Whitening of vectors by a covariance that is computed in tiles.

Dimensions are cut into column blocks of TILE; a tile is a pair of column
blocks. Rows are read in blocks of ROWS; a row block sends each of its column
blocks, centred, to the tiles that need it, keyed by row block and tile. One
task multiplies the two column blocks of its key, the products of a tile are
summed over row blocks, and only the finished tiles, as many numbers as the
covariance has, reach the driver, which assembles them and takes the
eigenvectors. Means are exact sums taken before, and rows are centred before
they are multiplied: a large common offset costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stash

#: Dimensions in a column block, and rows in a row block.
TILE, ROWS = 32, 8192
#: A component with less than this part of the first one's variance has none.
NONE = 1e-12


def _rows(batches: Iterator[pa.RecordBatch], wide: int, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of so many rows at most, with the matrix of their last column, in its own type."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            yield batch, batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(len(batch), wide)


def _sums(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """Each batch's sums by dimension, in two halves of which neither can overflow: value = high * 2**32 + low."""
    for _, x in _rows(batches, wide):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide, dtype=np.int32)), pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0))], ["dim", "high", "low"])


def moments(x: DataFrame, column: str, wide: int) -> tuple[int, list[int]]:
    """How many rows of longs there are, and their exact sums by dimension: a number for each dimension reaches the driver."""
    parts = x.select(column).mapInArrow(partial(_sums, wide=wide), "dim int, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = {r.dim: int(r.high) * 2**32 + int(r.low) for r in parts.groupBy("dim").agg(exact("high"), exact("low")).collect()}
    return x.count(), [sums.get(i, 0) for i in range(wide)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums of longs, exact: longs where they suffice, else Python's integers."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), 1)
    if 2 * n * most + max(map(abs, sums), default=0) < 2**63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _column_blocks(batches: Iterator[pa.RecordBatch], wide: int, tile: int, n: int, sums: list[int] | None, means: list[float] | None) -> Iterator[pa.RecordBatch]:
    """Each row block's column blocks, once for each tile that holds them. Longs are centred by exact sums, doubles by means."""
    part, number = TaskContext.get().partitionId() << 33, 0
    blocks = -(-wide // tile)
    for _, x in _rows(batches, wide):
        y = (centred(x, n, sums) / n).astype(np.float64) if sums is not None else x - np.array(means)
        for b in range(blocks):
            own = np.ascontiguousarray(y[:, b * tile : (b + 1) * tile]).tobytes()
            keys = [(min(b, o), max(b, o)) for o in range(blocks)]
            columns = [pa.array([part + number] * blocks, pa.int64()), pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([b] * blocks, pa.int32()), pa.array([len(y)] * blocks, pa.int32()), pa.array([own] * blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rows", "i", "j", "b", "n", "y"])
        number += 1


def _product(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row block's part of one tile."""
    _, i, j = (k.as_py() for k in key)
    held = {r["b"]: np.frombuffer(r["y"], np.float64).reshape(r["n"], -1) for r in table.select(["b", "n", "y"]).to_pylist()}
    made = held[i].T @ held[j]
    return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "products": pa.array([made.ravel()], pa.list_(pa.float64()))})


def covariance(x: DataFrame, column: str, wide: int, n: int, sums: list[int] | None = None, means: list[float] | None = None, tile: int = TILE) -> np.ndarray:
    """The covariance, divisor n, of n vectors of one length: longs with their exact sums, or doubles with their means."""
    blocks = x.select(column).mapInArrow(partial(_column_blocks, wide=wide, tile=tile, n=n, sums=sums, means=means), "rows long, i int, j int, b int, n int, y binary")
    parts = blocks.groupBy("rows", "i", "j").applyInArrow(_product, "i int, j int, products array<double>")
    tiles = parts.select("i", "j", F.posexplode("products").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    made = tiles.toArrow()  # as many numbers as half the covariance has, whatever the rows
    i, j, at, v = (made.column(c).to_numpy() for c in ("i", "j", "at", "v"))
    out = np.zeros((wide, wide))
    width = np.minimum(tile, wide - j * tile)
    r, c = i * tile + at // width, j * tile + at % width
    out[r, c] = out[c, r] = v / n
    return (out + out.T) / 2


@dataclass
class Whitener:
    """What a fit keeps: the count, exact sums, components as columns, their variances, falling, and the sum of all variances."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float


def fit(x: DataFrame, column: str, wide: int, components: int, tile: int = TILE) -> Whitener:
    """The first components of all rows of longs of one length."""
    n, sums = moments(x, column, wide)
    v = covariance(x, column, wide, n, sums, tile=tile) if n and wide else np.zeros((wide, wide))
    e, axes = np.linalg.eigh(v) if wide else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-e, kind="stable")[:components]
    return Whitener(n, sums, axes[:, order], e[order], float(np.trace(v)))


def _whitened(batches: Iterator[pa.RecordBatch], wide: int, w: Whitener) -> Iterator[pa.RecordBatch]:
    some = w.variances > NONE * max(w.variances.max(initial=0), 0)
    scale = np.where(some, 1 / np.sqrt(np.where(some, w.variances, 1)), 0)
    for batch, x in _rows(batches, wide):
        y = centred(x, w.n, w.sums)
        size = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))
        if y.dtype != object and size * size * max(1, wide) >= 2**63:
            y = y.astype(object)
        total = (y * y).sum(1)
        total = [int(t) if t < 2**63 else None for t in total.tolist()]
        found = (y / w.n).astype(np.float64) @ w.axes * scale
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(list(found), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])


def whiten(vectors: DataFrame, components: int = 8, tile: int = TILE) -> DataFrame:
    """Per vector and component, both in long form: vec_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    vectors (row, id, x array<long>) without nulls. Those whose length is not
    the most frequent one (of equally frequent ones the longest) are left out.
    deviation, the sum of (n*x-S)^2, is exact, and null where a long cannot
    hold it. A component without variance, as with fewer vectors than
    dimensions, whitens to 0 and does not count in identity_error, the greatest
    absolute entry of the whitened vectors' covariance minus the identity, which
    is computed from the whitened rows by the same tiles. Repeated rows and ids
    and null ids are rows like others. Vectors of length 0, or an empty table:
    empty result.
    """
    lengths = vectors.groupBy(F.size("x").alias("wide")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("wide")).first()
    wide = lengths["wide"] if lengths else 0
    own = vectors.where(F.size("x") == wide).select("id", "x")
    w = fit(own, "x", wide, components, tile)
    k = len(w.variances)
    made = stash(own.mapInArrow(partial(_whitened, wide=wide, w=w), "id long, deviation long, whitened array<double>"), "whitened") if k else None
    error = 0.0
    if w.n and k:
        means = [float(m) for m in made.agg(*[F.avg(F.element_at("whitened", i + 1)) for i in range(k)]).first()]
        some = w.variances > NONE * max(w.variances.max(initial=0), 0)
        error = float(np.abs((covariance(made, "whitened", k, w.n, means=means, tile=tile) - np.eye(k))[np.ix_(some, some)]).max(initial=0))
    share = F.array(*[F.lit(float(v / w.trace) if w.trace else 0.0) for v in w.variances])
    names = [F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).cast("double").alias("explained"), F.lit(error).alias("identity_error")]
    if made is None:
        return vectors.limit(0).select(F.col("id").alias("vec_id"), *[F.lit(0).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    return made.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(*names)
