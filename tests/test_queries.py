"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from quillcast import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None else f"{round(float(v), 5) + 0.0:.5f}" if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    found = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.collect(), df.columns) == normal(found.fetchall(), columns)


def test_names_are_unique():
    with pytest.raises(ValueError):
        plans.registry.query("t1_exact_dedup")(lambda spark, sf: None)
