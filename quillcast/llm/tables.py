"""Intermediate tables in the folder that all executors share, and columns used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id wherever ids are compared: it sorts below every other id.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset on one machine, as in tests, a new one; on a cluster, where nobody could share it, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage: an executor lost later costs a re-read, not a
    recomputation. An empty frame keeps its schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def text_bytes(text: str) -> Column:
    """The text as UTF-8 bytes for Arrow; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
