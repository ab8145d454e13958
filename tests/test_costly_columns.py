import pytest
from pyspark.sql import functions as F

from quillcast import plans
from quillcast.functions import tagged as TG


@pytest.mark.parametrize("name", ["t6b_removed_examples", "k6b_boxed_formula", "x17b_same_formula"])
def test_a_small_file_is_dealt_to_all_tasks(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == 4


def test_each_introduction_is_tried_once(spark):
    df = spark.createDataFrame([("such as Kiwi.", "kiwi")], "t string, a string").select(TG.removed_examples(F.col("t"), F.col("a")).alias("gone"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
