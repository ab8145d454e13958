import pytest

from quillcast.llm.mixing import mix_sources


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped) or 1
        target = {s: float(epochs * sizes[s]) if s in capped else w[s] * left / share for s in names}
        above = {s for s in names if target[s] > epochs * sizes[s]}
        if above <= capped:
            return target
        capped |= above


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size int, key string, target double")


@pytest.mark.parametrize("hot", [False, True])
def test_targets_and_budgets(spark, hot):
    rows = [(i, ["a", "b", "c", None, "Z", "é"][i % 6 if not hot or i % 3 else 0], " ".join(["w"] * (i % 17)), 1, "k", 0.0) for i in range(900)]
    got = mix_sources(frame(spark, rows)).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    expected = plain_targets(sizes)
    assert len(got) == 900
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert len({r.target for r in own}) == 1 and own[0].target == pytest.approx(expected[s])
        assert {r.source_size for r in own} == {sizes[s]}
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert len({r.taken // r.size for r in own if r.size and r.taken % r.size == 0}) <= 2
    again = mix_sources(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_rows(spark):
    rows = [(None, None, None, 1, "", 0.0), (1, "a", "", 1, "", 0.0), (2, "a", "one two\x0bthree\u00a0x", 1, "", 0.0), (2, "a", "one two\x0bthree\u00a0x", 1, "", 0.0), (3, "b", "y " * 100_000, 1, "", 0.0)]
    got = sorted(((r.doc_id, r.source, r.size, r.taken) for r in mix_sources(frame(spark, rows)).collect()), key=str)
    assert [g[:3] for g in got] == sorted([(None, None, 0), (1, "a", 0), (2, "a", 3), (2, "a", 3), (3, "b", 100_000)], key=str)
    assert sum(g[3] for g in got if g[1] == "a") == 18
    assert sum(g[3] for g in got if g[1] == "b") == 100_006 - 18
    assert mix_sources(frame(spark, rows[:2])).agg({"taken": "sum"}).first()[0] == 0
    assert mix_sources(frame(spark, rows).limit(0)).collect() == []


def test_plan_is_native(spark, sf_dir):
    plan = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
