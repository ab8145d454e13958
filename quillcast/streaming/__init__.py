"""Streaming forms of the batch operators: dedup on arrival, counts by window, and upserts by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.bucket_table import BucketTable
from ..sources.tables import upsert


def read_arrivals(spark: SparkSession, path: str, schema: StructType | str, form: str = "json", files_at_once: int = 1000) -> DataFrame:
    """Files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(form).load(path)


def first_copies(arrivals: DataFrame, time: str, *parts: str, late: str = "2 days") -> DataFrame:
    """Rows whose hash of the given parts has not been seen within the watermark; the state is bounded by it."""
    text = F.concat(*[F.coalesce(F.col(p), F.lit("")) for p in parts])
    seen = arrivals.withColumn("hash", F.md5(text.cast("binary"))).withWatermark(time, late)
    return seen.dropDuplicatesWithinWatermark(["hash"])


def counts_by_window(arrivals: DataFrame, time: str, *groups: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by time window and groups; rows later than the watermark no longer count."""
    window: Column = F.window(time, width)
    counted = arrivals.withWatermark(time, late).groupBy(window.alias("w"), *groups).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *groups, "n")


def upsert_stream(arrivals: DataFrame, folder: str, checkpoint: str, key: str, *order: str, then: Callable[[str], None] | None = None, **trigger: bool | str) -> StreamingQuery:
    """Upserts each micro-batch into a table of versions under folder; then gets the path of each new version. For small tables: each version is whole (bucket_stream rewrites what changes).

    A version is named by its batch, and a repeated batch starts from the
    version before it, so that a batch that is run again gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes = batch
        if number > 0:
            target = spark.read.schema(batch.schema).parquet(f"{folder}/version={number - 1}")
        else:
            target = spark.createDataFrame([], batch.schema)
        path = f"{folder}/version={number}"
        upsert(target, changes, key, *order).write.mode("overwrite").parquet(path)
        if then:
            then(path)

    name = f"upsert_{uuid.uuid4().hex}"
    return arrivals.writeStream.queryName(name).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bucket_stream(arrivals: DataFrame, path: str, checkpoint: str, key: str, *order: str, buckets: int = 64, then: Callable[[int], None] | None = None, **trigger: bool | str) -> StreamingQuery:
    """Upserts each micro-batch into a BucketTable, which rewrites only the buckets that it touches; then gets the number of rows that changed.

    The table names the last batch it took, so that one that is run again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        changed = BucketTable(batch.sparkSession, path, batch.schema, key, buckets).upsert(batch, *order, batch=number)
        if then:
            then(changed)

    name = f"buckets_{uuid.uuid4().hex}"
    return arrivals.writeStream.queryName(name).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
