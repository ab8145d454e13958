"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

A text's words are put in canonical form, placeholders included; words in a row
that form one name or number get one placeholder. Every window of WINDOW words
is hashed. Items that differ only in what fills their slots are one class and
are searched for once. A fixed bitmap of the benchmark's window
hashes (BITS bits, whatever the benchmark's size) goes to every task, so that
only windows that may match leave the document they are in; those are joined
with the benchmark's windows by hash. A document holds an item if, along one
alignment of the two, at least min_coverage of the item's windows match and the
slots agree: each number, name or unit of the item stands for one value in the
document throughout. So a question with other numbers is caught, and a text
that fills the same template at random is not. Windows that repeat within an
item also match each other crosswise; each takes its match nearest to the
alignment, and matches out of the item's order count for nothing.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stash, text_bytes

WINDOW = 5
#: Bits of the map that every task gets: 2 MiB.
BITS = 24
#: Alignments that differ by fewer words than this count together.
DRIFT = 16

# Words for numbers, and units of measure.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons "
    "second seconds sec minute minutes min hour hours hr day days week weeks month months year years dollar dollars euro euros cent cents percent % $ € £ mph kmh km/h degree degrees watt watts volt volts".split()
)
_EDGES = string.punctuation.replace("%", "").replace("$", "") + "«»“”‘’„…–—¡¿"
_CACHE = 300_000
_NUMBER, _NAME, _UNIT = "\0n", "\0p", "\0u"


def _hash(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode("utf-8", "replace"), 11) | 1  # 0 marks a token without a word


def _forms(token: str) -> tuple[int, int, bool]:
    """Hashes of a token at a sentence's start and within it (0: no word), and whether a sentence ends with it."""
    core = token.strip(_EDGES)
    ends = token[-1:] in ".!?:" or token[-2:-1] in ".!?" and token[-1:] in "\"')”’"
    low = core.lower()
    if not core:
        return 0, 0, ends
    if low in NUMBER_WORDS or not core.isalpha() and (any(map(str.isdigit, core)) or all(part in NUMBER_WORDS for part in low.split("-"))):
        return _SLOT["n"], _SLOT["n"], ends
    if low in UNITS:
        return _SLOT["u"], _SLOT["u"], ends
    plain = _hash(low)
    name = core[0].isupper() and (len(core) == 1 or not core[1:].isupper()) and core[0].isalpha()
    return plain, _SLOT["p"] if name else plain, ends


_SLOT = {s[1]: _hash(s) for s in (_NUMBER, _NAME, _UNIT)}
_SLOTS = {h: kind for kind, h in _SLOT.items()}
_SLOT_HASHES = np.array(sorted(_SLOTS), np.uint64)
_RUNS = np.array([_SLOT["n"], _SLOT["p"]], np.uint64)
_BREAKS = frozenset(".,;:!?)]}\"'”’»…")
_ODD = np.random.default_rng(5).integers(1, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Tokens:
    """What each word of a text was written as; joined only when asked for."""

    def __init__(self, tokens: list[str], at: np.ndarray, first: np.ndarray):
        self.tokens, self.at, self.first = tokens, at, first

    def __getitem__(self, i: int) -> str:
        return " ".join(self.tokens[k] for k in self.at[self.first[i] : self.first[i + 1]])


class Templates:
    """Canonical windows of texts; remembers the forms of tokens, up to a bound."""

    def __init__(self, window: int = WINDOW):
        self.window, self.known = window, {}
        self.hashes, self.flags = np.zeros((1 << 12, 2), np.uint64), np.zeros((1 << 12, 2), bool)

    def _learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        if not new:
            return
        first, inside, ends = zip(*map(_forms, new))
        at, to = len(self.known), len(self.known) + len(new)
        self.known.update(zip(new, range(at, to)))
        while to > len(self.hashes):
            self.hashes, self.flags = (np.concatenate((x, np.zeros_like(x))) for x in (self.hashes, self.flags))
        self.hashes[at:to, 0], self.hashes[at:to, 1] = np.array(first, np.uint64), np.array(inside, np.uint64)
        self.flags[at:to, 0], self.flags[at:to, 1] = ends, [t[-1] in _BREAKS for t in new]

    def words(self, text: str) -> tuple[np.ndarray, "_Tokens"]:
        """Hashes of the text's words, and the tokens that each of them stands for."""
        tokens = text.split()
        if not tokens:
            return np.zeros(0, np.uint64), _Tokens([], np.zeros(0, np.int64), np.zeros(1, np.int64))
        if len(self.known) > _CACHE:
            self.known.clear()
        self._learn(set(tokens))
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        ends, breaks = self.flags[ids].T
        start = np.concatenate(([True], ends[:-1]))
        h = np.where(start, self.hashes[ids, 0], self.hashes[ids, 1])
        at = np.flatnonzero(h)
        h, breaks = h[at], breaks[at]
        # a run of one kind goes on over any word that no punctuation ends
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | breaks[:-1] | ~((h[1:] == _RUNS[0]) | (h[1:] == _RUNS[1]))
        return h[new], _Tokens(tokens, at, np.append(np.flatnonzero(new), len(h)))

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows that hold at least one word that is no placeholder."""
        n = len(words) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        slot = (words == _SLOT_HASHES[0]) | (words == _SLOT_HASHES[1]) | (words == _SLOT_HASHES[2])
        h, literal = np.zeros(n, np.uint64), np.zeros(n, bool)
        with np.errstate(over="ignore"):
            for j in range(self.window):
                h += words[j : j + n] * _ODD[j]
                literal |= ~slot[j : j + n]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(literal)
        return at, h[at]

    def slots(self, words: np.ndarray, tokens, at: int) -> list[str]:
        return [kind + tokens[at + j].strip(_EDGES).lower() for j, w in enumerate(words[at : at + self.window].tolist()) if (kind := _SLOTS.get(w))]

    def numbered(self, words: np.ndarray, tokens) -> list[str]:
        """The tokens, but each slot's value by its number in the text: equal values share a number."""
        seen: dict[str, int] = {}
        slot = np.isin(words, _SLOT_HASHES).tolist()
        value = [f"{w}{tokens[i].strip(_EDGES).lower()}" if s else "" for i, (w, s) in enumerate(zip(words.tolist(), slot))]
        return [str(seen.setdefault(v, len(seen))) if s else tokens[i] for i, (v, s) in enumerate(zip(value, slot))]


def _windows(batches: Iterator[pa.RecordBatch], window: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(row, n, at, hash, slots) for each window, or each that the bitmap knows."""
    made = Templates(window)
    for batch in batches:
        out: list[tuple] = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words, tokens = made.words(text.as_py().decode("utf-8", "replace"))
            if bitmap is None:
                tokens = made.numbered(words, tokens)
            at, h = made.windows(words)
            n = len(at)
            if bitmap is not None:
                bucket = h >> np.uint64(64 - BITS)
                ok = bitmap[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1 == 1
                at, h = at[ok], h[ok]
            for i, x in zip(at.tolist(), h.view(np.int64).tolist()):
                out.append((row, n, i, x, made.slots(words, tokens, i)))
        cols = list(zip(*out)) if out else [()] * 5
        types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "n", "at", "hash", "slots"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, item, class, text): the class is the item's words and which of its slots are alike."""
    made = Templates()
    for batch in batches:
        found = []
        for text in batch.column(2):
            words, tokens = made.words(text.as_py().decode("utf-8", "replace"))
            slots = [t for t, s in zip(made.numbered(words, tokens), np.isin(words, _SLOT_HASHES).tolist()) if s]
            found.append(xxhash.xxh128_hexdigest(words.tobytes() + " ".join(slots).encode()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), batch.column(2)], ["no", "item", "class", "t"])


def aligned(by_at: dict[int, dict[int, tuple]], shift: int) -> dict[int, tuple]:
    """The match of each item window along the shift: there, or else nearest to it and in order with those before it and with those that are there."""
    ats = sorted(by_at)
    there = [at for at in ats if shift in by_at[at]]
    used, k, last = {}, 0, -1
    for at in ats:
        if k < len(there) and there[k] == at:
            k, s = k + 1, shift
        else:
            before = there[k] + shift if k < len(there) else float("inf")
            fit = [s for s in by_at[at] if last < at + s < before]
            if not fit:
                continue
            s = min(fit, key=lambda s: (abs(s - shift), s))
        used[at], last = by_at[at][s], at + s
    return used


def _agree(matches) -> bool:
    """Whether each slot of the item has one value throughout."""
    value: dict[str, str] = {}
    return all(value.setdefault(a, b) == b for mine, theirs in matches for a, b in zip(mine, theirs))


def coverage_of(met: list[dict], n: int, min_coverage: float) -> float | None:
    """The largest share of the item's windows along one alignment whose slots agree; None if below min_coverage."""
    by_at: dict[int, dict[int, tuple]] = {}
    for m in met:
        by_at.setdefault(m["at"], {})[m["shift"]] = (m["slots"], m["doc_slots"])
    best = None
    for shift in {m["shift"] for m in met}:
        used = aligned(by_at, shift)
        share = len(used) / n
        if share >= min_coverage and (best is None or share > best) and _agree(used.values()):
            best = share
    return best


def _agreeing(batches: Iterator[pa.RecordBatch], min_coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair = batch.column(0)
        found = [coverage_of(met.as_py(), n, min_coverage) for n, met in zip(batch.column(1).to_pylist(), batch.column(2))]
        made = pa.RecordBatch.from_arrays([pair.field(0), pair.field(1), pa.array(found, pa.float64())], ["doc", "no", "coverage"])
        yield made.filter(made.column(2).is_valid())


def _held(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, min_coverage: float) -> tuple[DataFrame, DataFrame]:
    """(doc, no, coverage) for the classes of items that documents hold, and (no, item): the items of each class."""
    kind = docs.schema[doc_id].dataType.simpleString()
    items = benchmark.select(F.monotonically_increasing_id().alias("no"), F.col(item_id).alias("item"), text_bytes(item_text).alias("t"))
    items = stash(items.mapInArrow(_classes, f"no long, item {benchmark.schema[item_id].dataType.simpleString()}, class string, t binary"), "items")
    firsts = stash(items.groupBy("class").agg(F.min("no").alias("no"), F.first("t").alias("t")), "item-classes")
    members = items.select("class", "item").distinct().join(firsts.select("class", "no"), "class").select("no", "item")
    theirs = firsts.select("no", "t").mapInArrow(partial(_windows, window=window, bitmap=None), "row long, n long, at long, hash long, slots array<string>")
    theirs = stash(theirs.withColumnRenamed("row", "no"), "item-windows")
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    bucket = F.shiftrightunsigned("hash", 64 - BITS)
    byte = theirs.select(F.shiftright(bucket, 3).alias("byte"), F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(bucket, F.lit(8)).cast("int") + 1).alias("bit"))
    for r in byte.groupBy("byte").agg(F.bit_or("bit").alias("bits")).collect():  # at most the bitmap's bytes
        bits[r.byte] = r.bits
    rows = docs.select(F.col(doc_id).alias("doc"), text_bytes(text).alias("t")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select(F.struct("row", "doc").alias("row"), "t")
    mine = rows.mapInArrow(partial(_windows, window=window, bitmap=bits), f"row struct<row:long,doc:{kind}>, n long, at long, hash long, slots array<string>")
    mine = mine.select("row", F.col("at").alias("doc_at"), "hash", F.col("slots").alias("doc_slots"))
    met = mine.join(theirs, "hash").withColumn("shift", F.col("doc_at") - F.col("at"))
    # two grids of alignments, half a step apart, so that no alignment sits at an edge of both
    near = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("shift") + g * DRIFT // 2) / DRIFT).alias("band")) for g in (0, 1)]))
    met = met.select("row", "no", "n", "at", "shift", "slots", "doc_slots", near.alias("near"))
    # a band holds at most DRIFT matches of each of the item's windows
    held = met.groupBy("row", "no", "near").agg(F.first("n").alias("n"), F.collect_list(F.struct("at", "shift", "slots", "doc_slots")).alias("met"))
    held = held.where(F.size(F.array_distinct("met.at")) / F.col("n") >= min_coverage)
    named = held.select(F.struct("row.doc", "no").alias("pair"), "n", "met")
    same = named.mapInArrow(partial(_agreeing, min_coverage=min_coverage), f"doc {kind}, no long, coverage double")
    return same.groupBy("doc", "no").agg(F.max("coverage").alias("coverage")), members


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, min_coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage): the items that each document holds, with the share of the item's windows found.

    Null or empty texts, and items of fewer than window words or without one
    literal word in a window, match nothing. A null id is reported as null.
    Documents or items that share an id are one for the result: the best
    coverage counts. Items of one template are all reported. Empty tables: empty
    result. Other columns are ignored.
    """
    found, members = _held(docs, benchmark, doc_id, text, item_id, item_text, window, min_coverage)
    return found.join(members, "no").groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("coverage").alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, min_coverage: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose id holds no item. Rows with a null id go together. Odd rows: as for find_contamination."""
    found = _held(docs, benchmark, doc_id, text, item_id, item_text, window, min_coverage)[0].select(F.col("doc").alias("__held")).distinct()
    return docs.join(found, docs[doc_id].eqNullSafe(found["__held"]), "left_anti")
