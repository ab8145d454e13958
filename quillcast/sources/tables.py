"""Parquet layouts with the access paths of a store: upserts, shards by key, folders by month, and a term index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ordering import keep_last


def latest_per_key(df: DataFrame, key: Column | str, *order: Column | str) -> DataFrame:
    """The last record of each key in the given order, as a reload of an appended file keeps it."""
    return keep_last(df, key, *order)


def upsert(target: DataFrame, changes: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The target with each row of changes put in place of its key's, or added; of several changes the last in order counts.

    Both sides are dealt by the key once. The result is a new table: write it to
    a new path, and read that from then on.
    """
    last = keep_last(changes, key, *order).select(*target.columns)
    kept = target.join(last.select(key), key, "left_anti").select(*target.columns)
    return kept.unionByName(last)


def shard_of(key: Column, shards: int) -> Column:
    """The md5 of the key as a 128-bit number modulo shards (at most 2^30), folded over four words of 32 bits."""
    digest, rest = F.md5(key.cast("string").cast("binary")), F.lit(0).cast("long")
    for at in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        rest = (rest * F.lit(1 << 32) + word) % shards
    return rest.cast("int")


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """One folder a shard, sorted by key, so that a lookup reads one folder and few row groups of it."""
    placed = df.withColumn("shard", shard_of(F.col(key), shards))
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, key: str, value: str, shards: int) -> DataFrame:
    """The rows of one key; the shard is computed first, so that only its folder is listed."""
    shard = spark.range(1).select(shard_of(F.lit(value), shards)).first()[0]
    return spark.read.parquet(path).where((F.col("shard") == shard) & (F.col(key) == value))


def month_of(modified: Column, published: Column) -> Column:
    """yyyy-MM of the date of modification, else of publication, else 'unknown'."""
    return F.coalesce(F.date_format(F.coalesce(modified, published), "yyyy-MM"), F.lit("unknown"))


def write_by_month(df: DataFrame, path: str, modified: str, published: str) -> None:
    df.withColumn("month", month_of(F.col(modified), F.col(published))).write.mode("overwrite").partitionBy("month").parquet(path)


def index_terms(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(term, key, tf): the inverted index of the lower-cased words of the fields."""
    words = F.concat(*[X.words(F.lower(f)) for f in fields])
    return df.select(key, F.explode(words).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
