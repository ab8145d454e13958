import duckdb
import pytest
from pyspark.sql import functions as F

from quillcast import plans
from quillcast.operators import scoring as S


@pytest.fixture
def events(spark, tmp_path):
    """Values on both sides of the bounds, each for all sources and outcomes, and a missing one."""
    values = [0.0, 25.0, 500.0, 549.0, 551.0, 560.21, -60.0, None]
    rows = [(8 * i + j, "2024-01-01", 1, ("purchase", "view")[j // 4], v, "{}") for i, v in enumerate(values) for j in range(8)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def as_sql(spark, events, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    found = {r.event_id: r.reward for r in plans.QUERIES[name](spark, events).collect()}
    assert found == pytest.approx(dict(c.execute(plans.ORACLE_SQL[name]).fetchall()))


def test_binary_reward_of_every_value_is_that_of_its_sql(spark, events):
    as_sql(spark, events, "k2_binary_reward")


def test_bounds_make_a_probability_unparsable(spark):
    p = [F.lit(x).cast("double") for x in (1.11, -0.11, 1.1, None)]
    row = spark.range(1).select(*[S.binary_reward(x, F.lit(1)).alias(f"b{i}") for i, x in enumerate(p)], S.freeform_reward(p[0], F.lit(1)).alias("f")).first()
    assert list(row) == pytest.approx([-1.25, -1.25, -0.01, -1.25, -1.0])


def test_reward_by_source_of_every_value_is_that_of_its_sql(spark, events):
    as_sql(spark, events, "k4_reward_by_source")
