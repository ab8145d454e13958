"""SimHash near-dedup by covering locality-sensitive hashing (Pagh 2016).

Fingerprints of 64 bits link when at most ``radius`` bits differ. Every bit
gets a vector of radius + 1 binary digits; for each non-zero vector v, the mask
keeps the bits whose vector has an odd scalar product with v. Any radius
differing bits miss at least one mask entirely, so each pair within the radius
agrees under some mask: no pair is lost, whatever the data. That holds whichever
vectors the bits get; they are chosen so that no mask is left with few bits.
A radius beyond PART is shared out among parts of the bits: if the parts' radii
and their number add up to more than the radius, one part is within its own.

Plan. Only distinct fingerprints are compared, each standing for its smallest
document id, so exact copies never multiply. Fingerprints are dealt by (mask,
masked bits) and streamed in that order; a bucket yields a spanning forest of
its links, not its pairs. A bucket beyond LIMIT is passed on instead and split
by a covering of the bits its mask left out, again and again: each level fixes
more bits, and of at most b bits left there are 2 ** b fingerprints. Links are
joined by alternating stars.

With ``least`` the fingerprints, then of distinct shingles, only find
candidates, by a second fingerprint of 64 bits beside the first; a candidate
links if the two texts share that part of their distinct shingles. Texts of one
fingerprint are verified like others, against one of them. Where a link of a
bucket's forest fails, what it was to connect is asked again by its other
candidates, until nothing is left to ask.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import stash, text_bytes

#: Fingerprints that one bucket compares at once; a larger bucket is split again.
LIMIT = 20_000
_SMALL, _DENSE = 32, 1024
#: With so few bits left, or no more than the radius, a bucket is compared whatever its size.
_FEW = 14
_CHUNK = 1 << 16
#: Radius that one part of the bits covers, and choices of vectors that are compared.
PART, _TRIES = 6, 64
#: Bits of both fingerprints that may differ for each bit of the radius.
WIDE = 27 / 13
#: Seeds of the first and the second fingerprint.
SEEDS = (42, 43)
#: Candidates of one row that a bucket asks for in a round after the first, and links that share one copy of a text's shingles.
NEXT, SHARED = 16, 500


def _shingles(text: bytes, width: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words, A-Z lower-cased, joined by spaces, and where its shingles start and stop."""
    words = text.lower().split()
    if not words:
        return b"", [], []
    count = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    return b" ".join(words), starts, ends[min(width, len(words)) - 1 :].tolist()


def _hashes(joined: bytes, starts: list[int], stops: list[int], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of the text's word shingles, A-Z lower-cased; 0 if there is no word."""
    return _majority(_hashes(*_shingles(text, width), SEEDS[0]))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _digest(own: np.ndarray) -> int:
    """Stands for a set of shingles, given as their sorted hashes."""
    return xxhash.xxh3_64_intdigest(own.tobytes())


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, distinct: bool) -> Iterator[pa.RecordBatch]:
    """fp, and 0 and 0; or for distinct shingles fp, wide and the set's digest."""
    for batch in batches:
        found = []
        for text in batch.column(1):
            parts = _shingles(text.as_py(), width)
            if distinct:
                own, other = (np.unique(_hashes(*parts, seed)) for seed in SEEDS)
                found.append((_majority(own), _majority(other), _digest(own)))
            else:
                found.append((_majority(_hashes(*parts, SEEDS[0])), 0, 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(_signed([f[k] for f in found]) for k in range(3))], ["doc", "fp", "wide", "content"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The hashes of each text's distinct shingles with their digest, one text at a time."""
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            own = np.unique(_hashes(*_shingles(text.as_py(), width), SEEDS[0]))
            yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), _signed([_digest(own)]), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["doc", "content", "own"])


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks over the bits: any radius of these bits are all missing from some mask."""
    vectors = 1 << (radius + 1)
    odd = np.bitwise_count(np.arange(1, vectors)[:, None] & np.arange(vectors)) & 1
    rng = np.random.default_rng(7)
    # in turn, where that is as good as any; else, or with fewer bits than vectors, spread over the whole space
    given = max((np.arange(len(bits)) % vectors, *(rng.permutation(np.arange(max(len(bits), vectors - 1)) % (vectors - 1) + 1)[: len(bits)] for _ in range(_TRIES))), key=lambda g: int(odd[:, g].sum(1).min()))
    return [sum(1 << b for b, kept in zip(bits, row) if kept) for row in odd[:, given].tolist()]


def masks_within(bits: list[int], radius: int) -> list[int]:
    """Masks over the bits, none of them empty: any radius of these bits, which are more, are all missing from some mask."""
    parts = -(-(radius + 1) // (PART + 1))
    found = []
    for i in range(parts):
        own = (radius + 1) // parts + (i < (radius + 1) % parts) - 1
        found += covering_masks(bits[i::parts], own)
    if not all(found):  # too few bits for their vectors: of radius + 1 parts one has no differing bit
        found = [sum(1 << b for b in bits[i :: radius + 1]) for i in range(radius + 1)]
    return list(dict.fromkeys(found))


def _candidates(fps: np.ndarray, wide: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Those of the pairs that are within the radius, and how many bits differ."""
    differ = np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64)
    near = np.flatnonzero(differ <= radius)
    i, j, differ = i[near], j[near], differ[near]
    differ += np.bitwise_count(wide[i] ^ wide[j])
    near = differ <= int(WIDE * radius)
    return i[near], j[near], differ[near]


def _spanning(i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of row numbers, those that span what they link, the nearest first."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for k in np.argsort(differ, kind="stable").tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            root[b] = a
            kept.append(k)
    return i[kept], j[kept]


def _spread(at: np.ndarray, fps: np.ndarray, wide: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the rows of one large bucket: each row found takes in all that are near it and still open."""
    while len(at):
        stack, at = [at[0]], at[1:]
        while stack and len(at):
            own = stack.pop()
            i, j, _ = _candidates(fps, wide, np.full(len(at), own), at, radius)
            if len(j):
                yield i, j
                at = at[~np.isin(at, j, assume_unique=True)]
                stack.extend(j.tolist())


def _forest(bucket: np.ndarray, fps: np.ndarray, wide: np.ndarray, reps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is linked within each run of equal bucket numbers."""
    n, close, found = len(fps), [], []
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate(([0], edges))
    sizes = np.diff(np.concatenate((starts, [n])))
    small = np.repeat(sizes <= _SMALL, sizes)
    for shift in range(1, int(min(_SMALL, sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-shift] & (bucket[shift:] == bucket[:-shift]))
        close.append(_candidates(fps, wide, i, i + shift, radius))
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        own = fps[start : start + size]
        if size <= _DENSE:
            i, j = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= radius, 1))
            if len(i) <= _SMALL * size:
                close.append(_candidates(fps, wide, i + start, j + start, radius))
                continue
        found += _spread(np.arange(start, start + size), fps, wide, radius)
    if close:
        found.append(_spanning(*(np.concatenate([c[k] for c in close]) for k in range(3))))
    if not found:
        return reps[:0], reps[:0]
    a, b = (reps[np.concatenate([f[k] for f in found])] for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


class _Mark(NamedTuple):
    """Of a row after the first round: its group so far, and rows that it was asked against in vain."""

    group: int
    refused: frozenset[int]


def _unlinked(bucket: np.ndarray, fps: np.ndarray, wide: np.ndarray, reps: np.ndarray, radius: int, marks: dict[int, _Mark]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a bucket its nearest candidates of other groups that were not refused, NEXT at most; the others wait for the next round."""
    found = [(reps[:0], reps[:0])]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(fps)]):
        own = [marks[r] for r in reps[start:stop].tolist()]
        group = np.array([m.group for m in own])
        if (group == group[0]).all():
            continue
        for k in range(stop - start - 1):
            at = start + k + 1 + np.flatnonzero(group[k + 1 :] != group[k])
            _, j, differ = _candidates(fps, wide, np.full(len(at), start + k), at, radius)
            me, kept = int(reps[start + k]), []
            for x in j[np.argsort(differ, kind="stable")].tolist():
                if int(reps[x]) not in own[k].refused and me not in own[x - start].refused:
                    kept.append(int(reps[x]))
                    if len(kept) == NEXT:
                        break
            found.append((np.full(len(kept), me), np.array(kept, np.int64)))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return np.minimum(a, b), np.maximum(a, b)


_OUT = "kind tinyint, a long, b long, mask long, wide long"


def _out(kind: int, a: np.ndarray, b: np.ndarray, mask: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *map(pa.array, (a, b, mask, wide))], ["kind", "a", "b", "mask", "wide"])


def _links(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, fp, wide, rep) in the order of mask and masked bits. Out: kind 0, a link of two ids; kind 1, (fp, rep, mask, wide) of a bucket too large.

    With a group and the refused as fifth and sixth column, links between groups alone.
    """
    held: np.ndarray | None = None
    marks: dict[int, _Mark] | None = None
    over: tuple[int, int] | None = None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
        if batch.num_columns > 4:
            still = {r: marks[r] for r in held[:, 3].tolist()} if marks and held is not None else {}
            marks = still | {r: _Mark(g, frozenset(no)) for r, g, no in zip(rows[:, 3].tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())}
        if over is not None:
            same = (rows[:, 0] == over[0]) & (rows[:, 0] & rows[:, 1] == over[1])
            if same.any():
                yield _out(1, rows[same, 1], rows[same, 3], rows[same, 0], rows[same, 2])
                rows = rows[~same]
            if not len(rows):
                continue
            over = None
        rows = rows if held is None else np.concatenate((held, rows))
        if not len(rows):
            continue
        new = np.flatnonzero(_starts(rows)) + 1
        last = int(new[-1]) if len(new) else 0
        yield from _whole(rows[:last], radius, limit, marks)
        held = rows[last:]
        if len(held) > limit and _splits(held[0, 0], radius):
            yield _out(1, held[:, 1], held[:, 3], held[:, 0], held[:, 2])
            over, held = (int(held[0, 0]), int(held[0, 0] & held[0, 1])), None
    if held is not None:
        yield from _whole(held, radius, limit, marks)


def _starts(rows: np.ndarray) -> np.ndarray:
    """Whether a row after the first starts a bucket."""
    mask, key = rows[:, 0], rows[:, 0] & rows[:, 1]
    return (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])


def _splits(mask: np.ndarray, radius: int) -> np.ndarray:
    """Whether a mask leaves bits enough to split its buckets again."""
    return 64 - np.bitwise_count(np.asarray(mask).view(np.uint64)) > max(_FEW, radius)


def _whole(rows: np.ndarray, radius: int, limit: int, marks: dict[int, _Mark] | None = None) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    bucket = np.cumsum(np.concatenate(([0], _starts(rows))))
    sizes = np.bincount(bucket)
    late = (sizes > limit)[bucket]
    if late.any():
        late &= _splits(rows[:, 0], radius)
        yield _out(1, rows[late, 1], rows[late, 3], rows[late, 0], rows[late, 2])
        rows, bucket = rows[~late], bucket[~late]
        sizes = np.bincount(bucket, minlength=1)
    keep = (sizes > 1)[bucket] if len(bucket) else np.zeros(0, bool)
    if keep.any():
        near = _forest if marks is None else partial(_unlinked, marks=marks)
        a, b = near(bucket[keep], np.ascontiguousarray(rows[keep, 1]).view(np.uint64), np.ascontiguousarray(rows[keep, 2]).view(np.uint64), rows[keep, 3], radius)
        none = np.zeros(len(a), np.int64)
        yield _out(0, a, b, none, none)


def _long(x: int) -> int:
    return x - ((x >> 63) << 64)


def _finer(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, fp, wide, rep) once for each mask that covers the bits left out so far, these bits added."""
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        mask, *others = (c.to_numpy().astype(np.int64) for c in batch.columns)
        for m in np.unique(mask).tolist():
            if m not in known:
                rest = masks_within([b for b in range(64) if not m >> b & 1], radius)
                known[m] = np.array([_long(x) for x in rest], np.int64) | m
            at, n = np.flatnonzero(mask == m), len(known[m])
            for start in range(0, len(at), _SMALL):
                part = at[start : start + _SMALL]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(known[m], len(part))), *(pa.array(np.repeat(x[part], n)) for x in others)], ["mask", "fp", "wide", "rep"])


def link_fingerprints(prints: DataFrame, radius: int = 4, limit: int = LIMIT, marks: DataFrame | None = None) -> DataFrame:
    """prints (fp, rep), fp distinct: links (a, b) of rep that span all pairs within the radius.

    If prints has a second fingerprint, wide, at most WIDE * radius bits of both
    may differ. marks (rep, group, refused): instead, of each row's pairs with
    rows of other groups that were not refused, the nearest.
    """
    if "wide" not in prints.columns:
        prints = prints.withColumn("wide", F.lit(0).cast("long"))
    masks = F.array(*[F.lit(_long(m)) for m in masks_within(list(range(64)), radius)])
    dealt = prints.select(F.explode(masks).alias("mask"), "fp", "wide", "rep")
    key = F.col("mask").bitwiseAND(F.col("fp"))
    found: list[DataFrame] = []
    while not found or not over.isEmpty():
        if marks is not None:
            dealt = dealt.join(marks, "rep").select("mask", "fp", "wide", "rep", "group", "refused")
        made = stash(dealt.repartition("mask", key).sortWithinPartitions("mask", key).mapInArrow(partial(_links, radius=radius, limit=limit), _OUT), "near")
        found.append(made.where("kind = 0").select("a", "b"))
        over = made.where("kind = 1").select("mask", F.col("a").alias("fp"), "wide", F.col("b").alias("rep"))
        dealt = over.mapInArrow(partial(_finer, radius=radius), "mask long, fp long, wide long, rep long")
    return reduce(DataFrame.unionByName, found)


def _at_copies(links: DataFrame, sets: DataFrame, end: str) -> DataFrame:
    """links with the shingles of one end; an end of very many links has several copies of its shingles, and each takes SHARED links or so."""
    copies = links.groupBy(end).agg(F.ceil(F.count("*") / SHARED).cast("int").alias("copies")).where("copies > 1")
    copies = stash(copies, "copies")  # read back, its size decides whether it is broadcast
    n = F.coalesce("copies", F.lit(1))
    other = F.xxhash64(*[c for c in ("a", "b") if c != end])
    spread = sets.select(F.col("doc").alias(end), F.col("own").alias(f"of_{end}")).join(copies, end, "left")
    spread = spread.select(end, f"of_{end}", F.explode(F.sequence(F.lit(0), n - 1)).alias("copy"))
    dealt = links.join(copies, end, "left").withColumn("copy", F.pmod(other, n).cast("int")).drop("copies")
    return dealt.join(spread, [end, "copy"]).drop("copy")


def shared_enough(links: DataFrame, docs: DataFrame, known: DataFrame, doc_id: str, text: str, width: int, least: float) -> DataFrame:
    """Those links (a, b) of ids whose texts have at least that share of their distinct shingles in common.

    known (rep, content): the contents that an id stands for.
    """
    ids = links.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), text_bytes(text).alias("t")).join(ids, "doc", "left_semi")
    sets = rows.mapInArrow(partial(_sets, width=width), "doc long, content long, own array<long>")
    sets = sets.join(known.select("content", F.col("rep").alias("doc")), ["content", "doc"], "left_semi")
    sets = stash(sets.groupBy("doc", "content").agg(F.first("own").alias("own")), "shingles")
    both = _at_copies(_at_copies(links, sets, "a"), sets, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common >= F.lit(least) * (F.size("of_a") + F.size("of_b") - common)).select("a", "b").distinct()


def _without(links: DataFrame, some: DataFrame) -> DataFrame:
    return links.join(some, ["a", "b"], "left_anti")


def _marks(good: DataFrame, bad: DataFrame, whole: DataFrame) -> DataFrame:
    """For each row that candidates connect with another group: rep, its group, and rows asked in vain.

    whole (node, component): what candidates connect. A refused pair is kept by
    the row that has fewer of them: of E such pairs no row keeps more than the root of 2 E.
    """
    group = components(good).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    state = stash(whole.withColumnRenamed("node", "rep").join(group, "rep", "left").select("rep", "component", F.coalesce("group", "rep").alias("group")), "state")
    several = state.groupBy("component").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select("component")
    degree = bad.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
    of = [degree.toDF(end, f"n_{end}") for end in ("a", "b")]
    by_a = F.col("n_a") <= F.col("n_b")
    kept = bad.join(of[0], "a").join(of[1], "b").select(F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("rep"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("other"))
    refused = kept.groupBy("rep").agg(F.collect_list("other").alias("refused"))
    none = F.array().cast("array<long>")
    return state.join(several, "component", "left_semi").join(refused, "rep", "left").select("rep", "group", F.coalesce("refused", none).alias("refused"))


def verified_links(contents: DataFrame, verify, radius: int, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that verify accepts, spanning all that it accepts among candidates.

    contents (fp, wide, content, rep): for each fingerprint its smallest rep
    leads; the others link with it if verify(links) keeps them, else the
    smallest of them leads the rest. Leaders are then searched for by their fingerprints.
    """
    first = F.min(F.struct("rep", "wide")).alias("first")
    rest, leaders, good = contents, [], []
    while not rest.isEmpty():
        own = stash(rest.groupBy("fp").agg(first).select("fp", F.col("first.rep").alias("lead"), F.col("first.wide").alias("wide")), "leaders")
        leaders.append(own.select("fp", "wide", F.col("lead").alias("rep")))
        others = rest.join(own.select("fp", "lead"), "fp").where("rep <> lead")
        good.append(stash(verify(others.select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()), "links"))
        rest = stash(others.join(good[-1].select(F.col("a").alias("rep"), F.col("b").alias("lead")), ["rep", "lead"], "left_anti").drop("lead"), "contents")
    if not leaders:
        return contents.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    classes = stash(reduce(DataFrame.unionByName, leaders), "classes")
    asked = stash(link_fingerprints(classes, radius, limit).distinct(), "candidates")
    whole, bad = None, None
    while not asked.isEmpty():
        good.append(stash(verify(asked), "links"))
        failed = stash(_without(asked, good[-1]), "refused")
        whole, bad = (components(asked), failed) if whole is None else (whole, bad.unionByName(failed))
        if bad.isEmpty():
            break
        marks = stash(_marks(reduce(DataFrame.unionByName, good), bad, whole), "marks")
        again = classes.join(marks.select("rep"), "rep", "left_semi")
        asked = stash(link_fingerprints(again, radius, limit, marks).distinct(), "candidates")
    return reduce(DataFrame.unionByName, good)


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, limit: int = LIMIT, least: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links, for every row.

    least: the share of common distinct shingles that links need; the
    fingerprints are then of distinct shingles, and equal ones are verified too.
    Without it the fingerprints, of all shingles, alone decide.

    Texts under width words have one shingle, all their words. Null, empty and
    blank texts have fingerprint zero and link like any other. A null id gets
    its fingerprint and a null component, and links nothing. Rows that share an
    id share links; each is returned with its own fingerprint, and all of an
    id's rows are in one component. Empty table: empty result. Other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), text_bytes(text).alias("t"))
    prints = stash(rows.mapInArrow(partial(_fingerprints, width=width, distinct=least is not None), "doc long, fp long, wide long, content long"), "prints")
    first = prints.where("doc is not null").groupBy("fp", "content").agg(F.min(F.struct("doc", "wide")).alias("first"))
    classes = stash(first.select("fp", "content", F.col("first.doc").alias("rep"), "first.wide"), "classes")
    known = prints.join(classes, ["fp", "content"], "left").select("doc", "fp", "content", "rep")
    # an id's rows may have several texts: its classes are linked through the id
    several = prints.where("doc is not null").select("doc", "fp", "content").distinct().groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    own = known.join(several, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    if least is None:
        links = link_fingerprints(classes, radius, limit)
    else:
        links = verified_links(classes, lambda found: shared_enough(found, docs, classes, doc_id, text, width, least), radius, limit)
    found = components(links.unionByName(own.where("a <> b")))
    whole = known.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return whole.select(F.col("doc").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
