"""Embedding near-dedup by search in a robust-pruned flat graph (after Subramanya et al. 2019).

Plan. Vectors of one direction become one class with a count. Classes are dealt to cells of
about MEMBERS: first by at most CENTRES centres, fitted on at most SAMPLE
classes, each class to its OVERLAP nearest; then any cell beyond four times MEMBERS
by centres of its own, again fitted on a bounded sample, until none is left. So
the number of centres grows with the table. A class has its home in its nearest
cell at every level, and is a guest in the others.

Every cell links its members to DEGREE others each: from the nearest POOL,
those that no kept neighbour already leads to (robust pruning), and back. The
lists of a class from all its cells are united; an edge holds the other end's
home and the cosine. Each class then searches the united graph, from itself,
from its cell's medoid and from one member of every part of the cell that the
medoid's edges do not lead to: greedily with a beam, then through all neighbours
of what is within WIDE of the range, until no more are found. An edge out of a
cell is followed if, by the angles on both sides, its end may be in range: the
search goes on in that cell from there, round after round, until no search is
left. Links are verified by cosine in doubles.

Each class is counted in its home alone, so no link counts twice. Only counts
and a spanning forest leave a cell, never its pairs. Searches that go on in one
cell are split by BLOCK, and a cell holds a bounded number of members, so no
task holds an unbounded group. Cosines are computed when a search asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import stash

SAMPLE, MEMBERS, CENTRES, OVERLAP, BLOCK = 20_000, 700, 1024, 3, 2000
DEGREE, POOL, BEAM, ALPHA, WIDE = 16, 48, 32, 1.2, 0.05
#: Points from which a search goes on in another cell, beside that cell's own starts.
ENTRIES = 8
_CHUNK = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the start is every n-th row."""
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for i in range(len(c)):
            if (own == i).any():
                mean = x[own == i].mean(0)
                c[i] = mean / (np.linalg.norm(mean) or 1)
    return c


class Cosines:
    """Of queries with nodes, both of length one: computed for the rows, or the pairs, that are asked for."""

    def __init__(self, nodes: np.ndarray, queries: np.ndarray | None = None):
        self.nodes, self.queries = nodes, nodes if queries is None else queries

    def __len__(self) -> int:
        return len(self.queries)

    def __getitem__(self, at) -> np.ndarray:
        if isinstance(at, tuple):
            q, n = np.broadcast_arrays(*at)
            return np.einsum("...i,...i->...", self.queries[q], self.nodes[n])
        return self.queries[at] @ self.nodes.T


def pruned_graph(sims) -> list[np.ndarray]:
    """For each member, up to DEGREE others that robust pruning keeps of its POOL nearest."""
    m = len(sims)
    pool = min(POOL, m - 1)
    if pool <= 0:
        return [np.zeros(0, np.int64)] * m
    edges: list[np.ndarray] = []
    for at in range(0, m, _CHUNK):
        own = np.arange(at, min(m, at + _CHUNK))
        s = np.array(sims[own])
        s[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        far = 1 - np.take_along_axis(s, near, 1)
        kept, alive, each = np.zeros(near.shape, bool), np.ones(near.shape, bool), np.arange(len(own))
        for _ in range(DEGREE):
            first = alive.argmax(1)
            some = alive[each, first]
            kept[each[some], first[some]] = True
            between = 1 - sims[near[each, first][:, None], near]
            alive &= ~((ALPHA * between <= far) & some[:, None])
            alive[each, first] = False
        edges += [n[k] for n, k in zip(near, kept)]
    return edges


def both_ways(edges: list[np.ndarray]) -> list[np.ndarray]:
    m, sizes = len(edges), list(map(len, edges))
    i, j = np.repeat(np.arange(m), sizes), np.concatenate([*edges, np.zeros(0, np.int64)]).astype(np.int64)
    both = np.unique(np.concatenate((i * m + j, j * m + i)))
    return np.split(both % m, np.searchsorted(both // m, np.arange(1, m))) if m else []


def starts_of(central: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The medoid, and the most central of the members not yet led to, until edges lead from these to every member."""
    led, starts = np.zeros(len(edges), bool), []
    for first in np.argsort(-central, kind="stable").tolist():
        if led[first]:
            continue
        starts.append(first)
        led[first], stack = True, [first]
        while stack:
            e = edges[stack.pop()]
            new = e[~led[e]]
            led[new] = True
            stack.extend(new.tolist())
    return np.array(starts, np.int64)


def search(sims, edges: tuple[np.ndarray, np.ndarray], queries: np.ndarray, seen: np.ndarray, least: float) -> np.ndarray:
    """score[i, j]: the cosine of the i-th query and node j if its search, from what it has seen, reached that node; else minus infinity.

    edges: where each node's list starts, and the lists. Every query takes in the lists of its BEAM nearest, and of all within WIDE of the range, until that shows nothing new.
    """
    first, lists = edges
    score, done = np.full(seen.shape, -np.inf), np.zeros(seen.shape, bool)
    new = seen.copy()
    while new.any():
        i, j = np.nonzero(new)
        score[i, j] = sims[queries[i], j]
        beam = np.partition(score, -BEAM, axis=1)[:, -BEAM] if score.shape[1] > BEAM else np.full(len(score), -np.inf)
        open_ = seen & ~done & (score >= np.minimum(beam, least - WIDE)[:, None])
        done |= open_
        i, j = np.nonzero(open_)
        size = first[j + 1] - first[j]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[j], size)
        new = np.zeros_like(seen)
        new[np.repeat(i, size), lists[at]] = True
        new &= ~seen
        seen |= new
    return score


def flat(edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([0], np.cumsum(list(map(len, edges))))).astype(np.int64), np.concatenate([*edges, np.zeros(0, np.int64)]).astype(np.int64)


def range_search(sims, edges: list[np.ndarray], least: float) -> np.ndarray:
    """found[i, j]: member i's search, from itself and the starts, reached j, and their cosine is at least least."""
    m = len(edges)
    central = np.concatenate([sims[np.arange(at, min(m, at + _CHUNK))].sum(1) for at in range(0, m, _CHUNK)])
    seen = np.eye(m, dtype=bool)
    seen[:, starts_of(central, edges)] = True
    return search(sims, flat(edges), np.arange(m), seen, least) >= least


def _vectors(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The OVERLAP nearest centres as cells, the nearest one first."""
    k = min(OVERLAP, len(centres))
    for batch in batches:
        if not len(batch):
            continue
        x = unit(_vectors(batch.column(2).to_pylist()))
        s = x @ centres.T
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(near.tolist(), pa.list_(pa.int64()))], ["rep", "n", "x", "cells"])


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A cell's own centres, from its sample. One that takes nearly all of the sample could not be split further: then there are none."""
    x, k = _vectors(pdf.sort_values("rep")["x"]), int(pdf["parts"].iloc[0])
    c = centroids_of(x, k)
    even = len(c) > 1 and np.bincount((x @ c.T).argmax(1)).max() <= 0.9 * len(x)
    return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "centres": [c.ravel().tolist() if even else []]})


def _split(key: tuple, rows: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
    """Members of a cell in its parts: at home in the nearest and guests in the next; guests go to the nearest alone."""
    if not len(rows):
        return pd.DataFrame({"rep": [], "n": [], "x": [], "cell": [], "home": []})
    x, parts, cell = _vectors(rows["x"]), int(rows["parts"].iloc[0]), int(rows["cell"].iloc[0])
    centres = np.asarray(fit["centres"].iloc[0]) if len(fit) else np.zeros(0)
    if len(centres):
        near = np.argsort(-(x @ centres.reshape(-1, x.shape[1]).T), axis=1, kind="stable")[:, :2]
    else:
        by = rows["rep"].to_numpy(np.int64) % parts
        near = np.stack((by, (by + 1) % parts), 1)
    out = [rows.assign(cell=(cell + 1) * CENTRES + near[:, 0])]
    if near.shape[1] > 1:
        out.append(rows.assign(cell=(cell + 1) * CENTRES + near[:, 1], home=False)[rows["home"].to_numpy(bool)])
    return pd.concat(out)[["rep", "n", "x", "cell", "home"]]


def _cells(dealt: DataFrame) -> DataFrame:
    """Split the cells (rep, n, x, cell, home) that hold more than four times MEMBERS until there are none."""
    shape = "rep long, n long, x array<double>, cell long, home boolean"
    done: list[DataFrame] = []
    while True:
        sizes = stash(dealt.groupBy("cell").agg(F.count("*").alias("size")), "cell-sizes")
        large = sizes.where(F.col("size") > 4 * MEMBERS).select("cell", F.least(F.lit(CENTRES), F.ceil(F.col("size") / MEMBERS)).cast("int").alias("parts"), "size")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, dealt])
        done.append(dealt.join(large, "cell", "left_anti"))
        rest = dealt.join(large, "cell")
        drawn = rest.where(F.pmod(F.xxhash64("rep", "cell"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("size") < SAMPLE)
        fit = stash(drawn.groupBy("cell").applyInPandas(_fitted, "cell long, centres array<double>"), "cell-centres")
        # as many rows of a cell at once as fit a task, each with the cell's centres
        salted = rest.withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / SAMPLE)).cast("int"))
        copies = fit.join(large, "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / SAMPLE).cast("int") - 1)).alias("salt"))
        dealt = stash(salted.groupBy("cell", "salt").cogroup(copies.groupBy("cell", "salt")).applyInPandas(_split, shape), "vector-cells")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each member's neighbours in this cell, with their homes and cosines."""
    pdf = pdf.sort_values("rep", ignore_index=True)
    x, ids, homes = _vectors(pdf["x"]), pdf["rep"].to_numpy(np.int64), pdf["own"].to_numpy(np.int64)
    sims = Cosines(x)
    first, lists = flat(both_ways(pruned_graph(sims)))
    cos = sims[np.repeat(np.arange(len(ids)), np.diff(first)), lists]
    cut = lambda v: np.split(v, first[1:-1])
    return pd.DataFrame({"rep": ids, "near": cut(ids[lists]), "homes": cut(homes[lists]), "cos": cut(cos)})


def _search(nodes: pd.DataFrame, queries: pd.DataFrame | None, cell: int, least: float) -> Iterator[pd.DataFrame]:
    """Kind 0: a query's links in this cell, and a link of the spanning forest of what is linked here. Kind 1: a cell in which the search goes on, and where."""
    nodes = nodes.sort_values("rep", ignore_index=True)
    ids, x, n = nodes["rep"].to_numpy(np.int64), _vectors(nodes["x"]), nodes["n"].to_numpy(np.int64)
    m, inner, out = len(ids), [], []
    for near, homes, cos in zip(nodes["near"], nodes["homes"], nodes["cos"]):
        near, at = np.unique(np.asarray(near, np.int64), return_index=True)
        homes, cos = np.asarray(homes, np.int64)[at], np.asarray(cos, np.float64)[at]
        here = homes == cell
        inner.append(np.searchsorted(ids, near[here]))
        out.append((near[~here], homes[~here], np.arccos(np.clip(cos[~here], -1, 1))))
    edges = both_ways(inner)
    starts = starts_of(x @ x.sum(0), edges)
    first, ends = flat([o[0] for o in out])
    homes, angles = np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])
    at_home = queries is None
    if at_home:
        queries, y = nodes, x
    else:
        queries = queries.sort_values("rep", ignore_index=True)
        y = _vectors(queries["x"])
    asks, entries = queries["rep"].to_numpy(np.int64), None if at_home else list(queries["entries"])
    sims, links, reach = Cosines(x, y), flat(edges), np.arccos(least)
    label, fresh = np.arange(m), m
    to_a: list[int] = []
    to_b: list[int] = []
    on: list[tuple[int, int, list[int]]] = []
    counts = np.zeros(len(asks), np.int64)
    for start in range(0, len(asks), _CHUNK):
        q = np.arange(start, min(len(asks), start + _CHUNK))
        seen = np.zeros((len(q), m), bool)
        seen[:, starts] = True
        if at_home:
            seen[np.arange(len(q)), q] = True
        else:
            for i, k in enumerate(q):
                seen[i, np.searchsorted(ids, np.asarray(entries[k], np.int64))] = True
        score = search(sims, links, q, seen, least)
        found = score >= least
        counts[q] = found @ n - (n[q] if at_home else 0)
        for i, k in enumerate(q):
            js = np.flatnonzero(found[i])
            if not len(js):
                continue
            own = label[k] if at_home else fresh
            parts, at = np.unique(label[js], return_index=True)
            other = parts != own
            if other.any():
                to_a += [int(asks[k])] * int(other.sum())
                to_b += ids[js[at[other]]].tolist()
                label[np.isin(label, parts)] = own
                fresh += not at_home
            size = first[js + 1] - first[js]
            if size.any():
                e = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[js], size)
                e = e[angles[e] <= np.repeat(np.arccos(np.minimum(1, score[i, js])), size) + reach]
                e = e[np.argsort(angles[e], kind="stable")]
                for h in np.unique(homes[e]).tolist():
                    on.append((int(asks[k]), h, list(dict.fromkeys(ends[e[homes[e] == h]].tolist()))[:ENTRIES]))
    none = lambda k: [[]] * k
    yield pd.DataFrame({"kind": 0, "rep": asks, "links": counts, "to": asks, "entries": none(len(asks))})
    yield pd.DataFrame({"kind": 0, "rep": to_a, "links": 0, "to": to_b, "entries": none(len(to_a))})
    yield pd.DataFrame({"kind": 1, "rep": [a for a, _, _ in on], "links": 0, "to": [h for _, h, _ in on], "entries": [e for _, _, e in on]})


_FOUND = "kind int, rep long, links long, to long, entries array<long>"


def _searches(graph: DataFrame, least: float) -> DataFrame:
    """(rep, links, to) of every class from its home, and from each cell that its search went on to."""

    def home(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_search(nodes, None, int(key[0]), least), ignore_index=True)

    def away(key: tuple, nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_search(nodes, queries, int(key[0]), least), ignore_index=True)

    made = stash(graph.groupBy("cell").applyInPandas(home, _FOUND), "vector-links")
    found, been = [made.where("kind = 0").select("rep", "links", "to")], graph.select("rep", "cell")
    vectors = graph.select("rep", "x")
    while True:
        on = made.where("kind = 1").select("rep", F.col("to").alias("cell"), "entries").join(been, ["rep", "cell"], "left_anti")
        on = stash(on.groupBy("rep", "cell").agg(F.array_distinct(F.flatten(F.collect_list("entries"))).alias("entries")), "vector-searches")
        if on.isEmpty():
            return reduce(DataFrame.unionByName, found)
        been = been.unionByName(on.select("rep", "cell"))
        salts = on.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
        asked = stash(on.join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).join(vectors, "rep").drop("salts"), "vector-searches")
        there = graph.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        made = stash(there.groupBy("cell", "salt").cogroup(asked.groupBy("cell", "salt")).applyInPandas(away, _FOUND), "vector-links")
        found.append(made.where("kind = 0").select("rep", "links", "to"))


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(id, v): v has the row's direction and length one; null where nothing can be linked. And the size of all v."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    size = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = rows.withColumn("v", F.when(F.size("v") < size, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))).otherwise(F.col("v")))
    # the direction to twelve places: vectors that differ in length alone are one class
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("v", F.transform("v", lambda x: F.round(x / norm, 12) + 0.0)), size


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    n_links: other rows within the cosine; component_id: the smallest id that
    links reach; kept: whether that is the row's own id. The search is
    approximate: a link may be missed, none is invented (tests hold its recall
    against brute force).

    Vectors that are null, empty or zero, or hold a null, NaN or infinity, link
    with nothing. So do rows with a null id, whose component is null and which
    are not kept. Rows that share an id are linked one by one, as are copies.
    Vectors of different lengths: shorter ones count as filled up with zeros.
    Empty table: empty result. Other columns are ignored.
    """
    rows, size = _usable(vectors, vec_id, embedding)
    rows = stash(rows, "vectors")
    classes = stash(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("rep", "n", "v", F.xxhash64("v").alias("h")), "vector-classes")
    # an id given to several vectors is the id of several classes: the class's own number tells them apart
    classes = stash(classes.withColumn("own", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()
    sample = classes.orderBy("h", "rep").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    centres = centroids_of(unit(_vectors(sample)), min(CENTRES, -(-total // MEMBERS))) if sample else np.ones((1, size))
    dealt = classes.select(F.col("own").alias("rep"), "n", "v").mapInArrow(partial(_assigned, centres=centres), "rep long, n long, x array<double>, cells array<long>")
    dealt = stash(dealt, "vector-cells").select("rep", "n", "x", F.posexplode("cells").alias("at", "cell"))
    dealt = stash(_cells(dealt.select("rep", "n", "x", "cell", (F.col("at") == 0).alias("home"))), "vector-cells")
    homes = stash(dealt.where("home").select("rep", F.col("cell").alias("own")), "vector-homes")
    built = dealt.join(homes, "rep").groupBy("cell").applyInPandas(_build, "rep long, near array<long>, homes array<long>, cos array<double>")
    union = [F.flatten(F.collect_list(c)).alias(c) for c in ("near", "homes", "cos")]  # a member's lists, from as many cells as it is in
    graph = stash(dealt.where("home").join(built.groupBy("rep").agg(*union), "rep"), "vector-graph")
    found = _searches(graph, least)
    names = classes.select(F.col("own").alias("rep"), F.col("rep").alias("id"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    pairs = found.where("rep <> to").select("rep", "to").distinct()
    a = pairs.join(names, "rep").select(F.col("id").alias("a"), F.col("to").alias("rep"))
    group = components(a.join(names, "rep").select("a", F.col("id").alias("b")))
    whole = classes.select("v", F.col("own").alias("rep"), "n", F.col("rep").alias("first")).join(counts, "rep", "left")
    whole = whole.join(group.withColumnRenamed("node", "first"), "first", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    usable = rows.where("v is not null").join(whole, "v").select("id", "n_links", "component_id")
    lone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = usable.unionByName(lone)
    return both.select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def audit_recall(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = 2000) -> float:
    """Share of the links of `sample` rows, found by brute force against all rows in blocks, that near_vectors counts.

    Rows that near_vectors links with nothing are left out; without links: 1.
    Of rows that share an id the one with most links counts.
    """
    counts = near_vectors(vectors, vec_id, embedding, least).groupBy(F.col(vec_id).alias("id")).agg(F.max("n_links").alias("got"))
    rows = _usable(vectors, vec_id, embedding)[0].where("v is not null")
    probes = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not probes:
        return 1.0
    x, ids = unit(_vectors([r.v for r in probes])), [r.id for r in probes]

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(batch):
                total += (x @ unit(_vectors(batch.column(0).to_pylist())).T >= least).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(total)], ["no", "id", "n"])

    true = rows.select("v").mapInArrow(brute, "no long, id long, n long").groupBy("no", "id").agg((F.sum("n") - 1).alias("true"))
    true = true.groupBy("id").agg(F.max("true").alias("true"))
    got, want = true.join(counts, "id").agg(F.sum(F.least("got", "true")), F.sum("true")).first()
    return got / want if want else 1.0
