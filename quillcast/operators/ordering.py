"""Ranks over a whole table without one task that holds it all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset on one machine, as in tests, one of the session's own; on a cluster, where nobody could share it, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Adds the row's number from 0 in the given total order: ranges sorted apart, and an offset for each."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (own + F.col("__before")).cast("long")).drop("__part", "__before")


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key. As an aggregate it is combined before its shuffle, whatever the key's share."""
    cols = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("row"))
    best = df.groupBy(*keys).agg(F.min(packed).alias("best"))
    return best.select(*keys, "best.row.*").select(*df.columns)


def keep_last(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last row of each key, nulls first in order; combined before its shuffle like keep_first."""
    cols = [c for c in df.columns if c != key]
    packed = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("row"))
    return df.groupBy(key).agg(F.max(packed).alias("best")).select(key, "best.row.*").select(*df.columns)


def keep_latest(df: DataFrame, key: str, date: str, seq: str) -> DataFrame:
    """The row of each key with the greatest date; null dates lose, ties keep the smallest seq. Null keys go. Combined before its shuffle."""
    return keep_first(df.where(F.col(key).isNotNull()), [key], F.col(date).isNull(), -F.unix_micros(F.col(date).cast("timestamp")), F.col(seq))


def chronological_split(df: DataFrame, date: str, tie: str, ratio: float) -> DataFrame:
    """Adds split: train for the first floor(n * ratio) rows by date and tie, else test. Days are counted; rows of the day at the cut are ranked by ranges, those of others are labelled in place."""
    day = F.to_date(date)
    days = df.groupBy(day.alias("__d")).agg(F.count("*").alias("__n"))  # a row for each day
    days = days.select("__d", "__n", (F.sum("__n").over(W.orderBy(F.col("__d").asc_nulls_first())) - F.col("__n")).alias("before")).collect()
    total = int(sum(r["__n"] for r in days) * ratio)
    at = next((r for r in days if r.before <= total < r.before + r["__n"]), None)
    if at is None:
        return df.withColumn("split", F.lit("train"))
    same = day.eqNullSafe(F.lit(at["__d"]).cast("date"))
    earlier = F.coalesce(day < F.lit(at["__d"]).cast("date"), F.lit(at["__d"] is not None))
    others = df.where(~same).withColumn("split", F.when(earlier, "train").otherwise("test"))
    ranked = row_index(df.where(same), F.col(date).asc_nulls_first(), F.col(tie).asc_nulls_first(), name="__i")
    return others.unionByName(ranked.withColumn("split", F.when(F.col("__i") < total - at.before, "train").otherwise("test")).drop("__i"))


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows without replacement, by the order of a hash of the key: the same in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def round_robin(df: DataFrame, group: str, key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows taken from the groups in turn, each group in hash order."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    r = F.row_number().over(W.partitionBy(group).orderBy(h, key))
    return df.withColumn("turn", r).where(F.col("turn") <= n).orderBy("turn", group).limit(n)
