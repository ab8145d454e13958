"""Derived tables that are kept while their inputs and their plan stay the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamps(spark: SparkSession, *inputs: str) -> DataFrame:
    """(path, length, modificationTime) of all files in and below the inputs; they are listed, not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs)).select("path", "length", "modificationTime")


def plan_of(df: DataFrame) -> str:
    """The analysed plan in one spelling, whole: the same for each build of the same transformations."""
    conf, name = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(name)
    conf.set(name, str(2**31 - 1))
    try:
        return df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        conf.set(name, before)


def stamped(spark: SparkSession, folder: str, inputs: list[str], build: Callable[[], DataFrame], version: str = "") -> DataFrame:
    """build()'s rows: from the folder if they were kept there for the same files, sizes, times, plan and version, else computed, kept and read back.

    The plan is made each time, which opens no more of the inputs than their
    schema takes. What it does not show, such as the code of a Python function,
    must be told apart by ``version``. The list of inputs is written after the
    rows and makes them count, so that a run that broke off is done again.
    """
    made, files = build(), stamps(spark, *inputs)
    digest = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()
    key = hashlib.sha256(repr((digest.n, str(digest.s), plan_of(made), version)).encode()).hexdigest()
    path = f"{folder}/{key}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/inputs/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        made.write.mode("overwrite").parquet(f"{path}/rows")
        files.write.mode("overwrite").parquet(f"{path}/inputs")
    return spark.read.schema(made.schema).parquet(f"{path}/rows")
