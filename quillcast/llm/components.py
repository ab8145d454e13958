"""Connected components of a graph given as a table of links, by alternating stars (Kiveris et al. 2014).

Each round hangs every node's larger neighbours under its smallest one, then
its smaller neighbours likewise. Both are an aggregation and a join on the
node, so that a node with very many links is split like any skewed join key
and no neighbourhood is ever gathered. Rounds end when no link changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stash

_MAX_ROUNDS = 60


def _hang(links: DataFrame, larger: bool) -> DataFrame:
    """links (u, v): give each u its smallest neighbour, itself included, and hang the neighbours under it."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link to another.

    links holds two long columns in either order; repeats and links of a node
    to itself do not matter; rows with a null are ignored. No link: no row.
    """
    own = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    own, before = stash(own.distinct(), "links"), None
    for _ in range(_MAX_ROUNDS):
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, larger=True).where("u > v").distinct()
        own = stash(_hang(large, larger=False).where("u > v").distinct(), "links")
        state = own.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {_MAX_ROUNDS} rounds")
    roots = own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
