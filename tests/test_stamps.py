"""What makes a kept table be made anew, and what does not."""

import os
import shutil

from pyspark.sql import functions as F

from quillcast.sources import stamped


def test_only_changes_rebuild(spark, tmp_path):
    data, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(10).write.parquet(data)
    runs = spark.sparkContext.accumulator(0)

    def build(by=2, wide=1):
        def seen(batches):
            for b in batches:
                runs.add(len(b))
                yield b

        more = [(F.col("id") * by + i).alias(f"c{i}") for i in range(wide)]
        return spark.read.schema("id long").parquet(data).mapInPandas(seen, "id long").select("id", *more)

    def ask(version="", **how):
        df = stamped(spark, kept, [data], lambda: build(**how), version)
        assert all("/kept/" in f for f in df.inputFiles())
        return sorted(r.c0 for r in df.collect())

    assert ask() == ask() == [2 * i for i in range(10)] and runs.value == 10
    assert ask(by=3) == [3 * i for i in range(10)] and runs.value == 20  # another plan
    assert ask(version="b") == ask(version="b") and runs.value == 30
    wide = [stamped(spark, kept, [data], lambda n=n: build(wide=n)).columns for n in (40, 41, 40)]
    assert [len(w) for w in wide] == [41, 42, 41] and runs.value == 50  # beyond the columns that a plan prints by itself
    spark.range(10, 12).write.mode("append").parquet(data)
    assert ask() == [2 * i for i in range(12)] and runs.value == 62
    one = next(f"{data}/{f}" for f in os.listdir(data) if f.endswith(".parquet"))
    os.utime(one, (1, 1))  # touched, with the same content
    assert ask() == [2 * i for i in range(12)] and runs.value == 74
    assert ask() and runs.value == 74


def test_a_broken_run_is_done_again(spark, tmp_path):
    data, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(3).write.parquet(data)
    build = lambda: spark.read.parquet(data).select((F.col("id") + 1).alias("v"))
    stamped(spark, kept, [data], build)
    key = os.listdir(kept)[0]
    shutil.rmtree(f"{kept}/{key}/inputs")  # as if it had ended after some rows
    spark.range(1).selectExpr("id + 50 AS v").write.mode("overwrite").parquet(f"{kept}/{key}/rows")
    assert sorted(r.v for r in stamped(spark, kept, [data], build).collect()) == [1, 2, 3]
