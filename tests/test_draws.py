import pytest

from quillcast.operators import groups as G


def rows(spark, weights):
    return spark.createDataFrame(list(enumerate(weights)), "id long, w double")


@pytest.mark.parametrize("cell", [16, 1 << 16])
def test_draws_add_up_and_vary_as_independent_ones(spark, cell):
    """Over 16 seeds the counts of a row have the mean and the variance of a binomial; systematic draws would hardly vary."""
    weights = [0.0, 50.0, *[1.0] * 50, None, -3.0, float("inf")]
    df = rows(spark, weights)
    seen = []
    for seed in range(16 if cell > 16 else 4):
        taken = {r.id: r.taken for r in G.drawn(df, "id", "w", 200, seed, cell).collect()}
        assert sum(taken.values()) == 200 and set(taken) == set(range(len(weights)))
        assert not any(taken[i] for i in (0, 52, 53, 54))
        seen.append(taken[1])
    assert abs(sum(seen) / len(seen) - 100) < (8 if len(seen) > 4 else 20)
    if len(seen) > 4:
        variance = sum((x - sum(seen) / len(seen)) ** 2 for x in seen) / (len(seen) - 1)
        assert 15 < variance < 120  # 50 in expectation


def test_reruns_agree_and_odd_tables(spark):
    df = rows(spark, [1.0, 2.0, 3.0])
    first = sorted(map(tuple, G.drawn(df, "id", "w", 50, 3).collect()))
    assert first == sorted(map(tuple, G.drawn(df.repartition(3), "id", "w", 50, 3).collect()))
    assert [r.taken for r in G.drawn(rows(spark, [0.0, None]), "id", "w").collect()] == [0, 0]
    assert G.drawn(df.limit(0), "id", "w").collect() == [] and [r.taken for r in G.drawn(df, "id", "w", 0).collect()] == [0, 0, 0]
    assert [r.taken for r in G.drawn(df.where("id = 1"), "id", "w", 7, cell=2).collect()] == [7]


def test_weights(spark):
    df = rows(spark, [-2.0, 1.0, 3.0, 3.0])
    found = lambda *a: [r.weight for r in G.resampling_weights(df, "w", *a).orderBy("id").collect()]
    assert found("pow", 2.0) == [4.0, 1.0, 9.0, 9.0] and found("max_min") == [1.0, 0.0, 1.0, 1.0] and found("max_random") == [0.1, 0.1, 0.4, 0.4]
    with pytest.raises(ValueError):
        found("other")
