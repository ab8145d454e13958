"""Mix sources to target weights: how many words of each document the mix takes.

Plan. Sizes are counted where the text is read; only (id, source, size, key)
moves on. Each document gets a hash-random key from its id. Within a source,
the key's leading bits cut the documents into BUCKETS ranges of the random
order, so that a source with a third of all rows is spread over as many tasks.
Bucket totals (at most BUCKETS a source) are summed up in key order, and each
bucket then adds its own running sum: together an exact prefix sum of words
over the source's random order, without a global sort. The source's budget
cuts that order at its exact word.

Targets are found by raising one water level for all sources; each round is an
aggregation of the table of sources to four numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stash

#: Ranges of the random order within each source: 12 of the key's 60 bits.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: str, seed: str) -> Column:
    """60 bits of md5 over seed and id: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """rank (from 0) of each source by code point, null last, without one task that holds them all."""
    ranged = stash(sources.repartitionByRange("none", "src").withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy("none", "src"))
    return ranged.join(F.broadcast(before), "part").select("none", "src", "source_size", (own - 1 + F.col("before")).alias("rank"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """sources (none, src, source_size): adds target, the words that each source gives to the mix.

    Weights repeat over the sources in code point order. Targets add up to all
    words; none exceeds epochs times its source, the excess going to the others
    by weight until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    table = stash(_numbered(sources).select("none", "src", "source_size", weight.alias("w")), "weights")
    cap = F.col("source_size") * epochs
    total, heavy = table.agg(F.sum("source_size"), F.sum("w")).first()
    left, share, before = total or 0, heavy or 1, -1
    while True:
        above = cap.cast("double") < F.col("w") * F.lit(left) / F.lit(share)
        n, taken, weight_of = table.where(above).agg(F.count("*"), F.sum(cap), F.sum("w")).first()
        if n == before or n == 0:
            break
        left, share, before = (total or 0) - taken, max(1, heavy - weight_of), n
    return table.select("none", "src", "source_size", F.least(cap.cast("double"), F.col("w") * F.lit(left) / F.lit(share)).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) for every row.

    A source gives floor(target) words: whole epochs of all its documents, then
    documents in random order up to the budget's last word, the one at the cut
    in part. Sums of taken are exact; no document exceeds epochs times its size.

    Null or empty text: size 0, takes nothing. A null source is a source of its
    own, the last. A null id has the empty text's key. Rows with equal keys
    (repeated ids) follow by id and size; equal rows are interchangeable, so
    reruns agree. No words at all: every target is 0. Empty table: empty
    result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc"), F.col(source).alias("source"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"),
        words_in(text).alias("size"), random_key(doc_id, seed).alias("key"),
    )
    rows = stash(rows.withColumn("bucket", F.shiftright("key", 48).cast("int")), "sizes")
    sums = rows.groupBy("none", "src", "bucket").agg(F.sum("size").alias("words"))
    sums = stash(sums, "bucket-sums")
    targets = source_targets(sums.groupBy("none", "src").agg(F.sum("words").alias("source_size")), weights, epochs)
    start = (F.sum("words").over(W.partitionBy("none", "src").orderBy("bucket")) - F.col("words")).alias("start")
    sums = sums.select("none", "src", "bucket", start).join(targets, ["none", "src"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    sums = sums.select("none", "src", "bucket", "start", "source_size", "target", whole.alias("whole"), (budget - whole * F.col("source_size")).alias("rest"))
    joined = rows.join(sums, ["none", "src", "bucket"])
    order = W.partitionBy("none", "src", "bucket").orderBy("key", "doc", "size").rowsBetween(W.unboundedPreceding, 0)
    before = F.col("start") + F.sum("size").over(order) - F.col("size")
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - before))
    return joined.select(F.col("doc").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", (F.col("whole") * F.col("size") + cut).alias("taken"))
