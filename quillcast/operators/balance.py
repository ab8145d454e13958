"""Balanced parts of bounded batches by their rows' lengths."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differencing(lengths: list[int], k: int, equal: bool = False) -> list[int]:
    """The part (0 to k - 1) of each item by largest differencing: the two most uneven part sets are merged, heaviest against lightest.

    With equal, items are first dealt in groups of k by size, so that all parts
    have as many items; their number must then be a multiple of k.
    """
    if equal and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items can't form {k} equal parts")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    heap = []
    for number, items in enumerate(groups):
        parts = sorted([(lengths[i], [i]) for i in items] + [(0, []) for _ in range(k - len(items))], key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], number, parts))
    number = len(groups)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], number, merged))
        number += 1
    out = [0] * len(lengths)
    for part, (_, items) in enumerate(heap[0][2] if heap else []):
        for i in items:
            out[i] = part
    return out


def greedy(lengths: list[int], k: int) -> list[int]:
    """Each item, in the order given, goes to the lightest part so far."""
    heap, out = [(0, p) for p in range(k)], []
    for n in lengths:
        total, part = heapq.heappop(heap)
        out.append(part)
        heapq.heappush(heap, (total + n, part))
    return out


def balanced(df: DataFrame, batch: str, key: str, length: str, k: int, equal: bool = False) -> DataFrame:
    """(batch, key, length, part). A batch is a mini-batch of bounded size and is dealt within one task."""
    rows = df.select(batch, key, length)

    def deal(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(key)
        return b.assign(part=differencing(b[length].tolist(), k, equal))

    return rows.groupBy(batch).applyInPandas(deal, f"{rows.schema.simpleString()[7:-1]}, part int".replace(":", " "))


def micro_batches(df: DataFrame, batch: str, key: str, length: str, budget: int) -> DataFrame:
    """As balanced, with min(rows, ceil(sum / budget)) parts, numbered from the part with the most work (sum of squares)."""
    rows = df.select(batch, key, length)

    def deal(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(key)
        sizes = b[length].tolist()
        part = differencing(sizes, max(1, min(len(sizes), -(-sum(sizes) // budget))))
        work: dict[int, int] = {}
        for p, n in zip(part, sizes):
            work[p] = work.get(p, 0) + n * n
        place = {p: i for i, p in enumerate(sorted(work, key=lambda p: (-work[p], p)))}
        return b.assign(part=[place[p] for p in part])

    return rows.groupBy(batch).applyInPandas(deal, f"{rows.schema.simpleString()[7:-1]}, part int".replace(":", " "))


def imbalance(parts: DataFrame, batch: str, length: str) -> DataFrame:
    each = parts.groupBy(batch, "part").agg(F.sum(length).alias("s"))
    return each.groupBy(batch).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), (F.max("s") - F.min("s")).alias("diff"), F.avg("s").alias("mean"))
