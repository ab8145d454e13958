import random

import pytest
from pyspark.sql import functions as F

from quillcast import sources as IO
from quillcast import streaming as ST
from quillcast.functions import articles as A
from quillcast.functions import dates as D
from quillcast.functions import tagged as TG
from quillcast.functions import text as X
from quillcast.operators import balance as B
from quillcast.operators import extension as E
from quillcast.operators import groups as G
from quillcast.operators import ordering as O
from quillcast.operators import reshape as RS
from quillcast.operators import retrieval as T
from quillcast.operators import scoring as S


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    assert one(spark, X.boxed(F.lit(r"\boxed{1} then \boxed{2}")), X.strip_thinking(F.lit("<think>a\nb</think> c  d"))) == ["2", "c d"]
    assert one(spark, X.after_thinking(F.lit("a</think>b</think>c")), X.verdict(F.lit("none"))) == ["b", None]
    assert len(one(spark, X.word_windows(F.lit(" ".join(map(str, range(1000))))))[0]) == 3


def test_line_ends_are_stripped(spark):
    assert one(spark, X.last_tag(F.lit("<a>\n x\u00a0\n</a>"), "a"), X.answer_of(F.lit("<answer>\tb\n</answer>"))) == ["x", "b"]


def test_dates(spark):
    assert one(spark, *[D.epoch_seconds(F.lit(t)) for t in ("1700000000", "1700000000000", "1970-01-02T00:00:00Z", "nope")]) == [1700000000, 1700000000, 86400, None]
    assert one(spark, D.question_seconds(F.lit("unknown")), D.strict_date(F.lit("2024-3-5")), D.strict_date(F.lit("2024-13-05"))) == [None, None, None]
    assert str(one(spark, D.naive_timestamp(F.lit("2024-03-05T10:00:00+02:00")))[0]) == "2024-03-05 10:00:00"
    assert one(spark, D.latest_string(F.lit("2024-01-01"), F.lit(""), F.lit(None)), D.earliest_string(F.lit("2024-01-02"), F.lit("2024-01-01"), F.lit("x"))) == ["2024-01-01", "2024-01-01"]


def test_groups_and_scores(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 5.0)], "uid string, id int, s double")
    assert {r.id: round(r.advantage, 4) for r in G.grpo(df, "uid", "s").collect()} == {1: -0.7071, 2: 0.7071, 3: 5.0}
    assert {r.id: r.advantage for r in G.rloo(df, "uid", "s").collect()} == {1: -2.0, 2: 2.0, 3: 5.0}
    assert {r.id: r.advantage for r in G.best_gap(df, "uid", "s", "id").collect()} == {1: 0.0, 2: 2.0, 3: None}
    masked = spark.createDataFrame([(float(i), int(i in (1, 4))) for i in range(1, 5)], "x double, m int")
    assert G.masked_stats(masked, "x", "m").first().mean == 2.5
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, G.discounted_returns(arr(1, 1, 1), arr(1, 0, 1), 0.5)) == [[1.0, 1.5, 1.0]]
    assert one(spark, G.gae(arr(0, 0, 1), arr(0.5, 0.5, 0.5), 1.0, 1.0)) == [[0.5, 0.5, 0.5]]
    votes = spark.createDataFrame([(1, "B", 2), (1, "a ", 1), (1, "b", 4), (1, "A", 3)], "q int, a string, pos int")
    assert tuple(S.majority(votes, "q", "a", "pos").first()) == (1, "a", 2)
    assert one(spark, *[S.freeform_reward(F.lit(p), F.lit(c)) for p, c in ((0.5, 1), (0.5, 0), (0.0, 1))]) == [0.75, -0.25, -1.0]


def spread(lengths, parts, k):
    sums = [sum(n for n, p in zip(lengths, parts) if p == i) for i in range(k)]
    return max(sums) - min(sums)


def test_balanced_parts_are_complete_and_beat_greedy_ones():
    r = random.Random(7)
    for k in (1, 2, 5):
        lengths = [r.randrange(1, 400) for _ in range(60)]
        parts = B.differencing(lengths, k)
        assert len(parts) == 60 and set(parts) == set(range(k)) and spread(lengths, parts, k) <= spread(lengths, B.greedy(lengths, k), k)
        equal = B.differencing(lengths, k, equal=True)
        assert sorted(equal) == [p for p in range(k) for _ in range(60 // k)]
    assert B.differencing([], 3) == [] and B.differencing([5], 3) in ([0], [1], [2])
    with pytest.raises(ValueError):
        B.differencing([1, 2, 3], 2, equal=True)


def test_micro_batches_hold_every_row_once(spark):
    df = spark.createDataFrame([(i % 2, i, 1 + i * 7 % 90) for i in range(60)], "b int, id int, n int")
    rows = B.micro_batches(df, "b", "id", "n", 300).collect()
    assert sorted(r.id for r in rows) == list(range(60))
    for b in (0, 1):
        work = {}
        for r in rows:
            if r.b == b:
                work[r.part] = work.get(r.part, 0) + r.n**2
        assert list(sorted(work)) == list(range(-(-sum(r.n for r in rows if r.b == b) // 300)))
        assert [work[p] for p in sorted(work)] == sorted(work.values(), reverse=True)


def test_registry_and_engine(spark):
    names = E.Registry()
    f = names.register("one")(lambda x: x)
    assert names.register("one")(f) is f
    with pytest.raises(ValueError):
        names.register("one")(lambda x: x + 1)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, p string")
    assert {r.id: r.response for r in E.generate(df, "p", lambda ps: [p * 2 for p in ps]).collect()} == {1: "aa", 2: None}


def test_resampling_and_bootstrap(spark):
    df = spark.createDataFrame([(i, "g", float(i % 5)) for i in range(500)], "id int, g string, s double")
    taken = {r.id: r.taken for r in G.resampled(df, "id", "s").collect()}
    assert sum(taken.values()) == 500 and all(taken[i] == 0 for i in range(0, 500, 5))
    assert abs(sum(taken[i] for i in range(4, 500, 5)) - 200) <= 2
    b = G.bootstrap(df, "g", "s", 40).first()
    assert abs(b.mean - 2) < 0.05 and 0.02 < b.std < 0.15
    assert G.next_coefficient(0.1, 2.0, 1.0, 10, 100) == pytest.approx(0.102)


def test_chunks_zip_and_free_ids(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id int")
    with pytest.raises(ValueError):
        RS.chunks(df, 3, "id")
    assert sorted(r.idx for r in RS.pad_to_multiple(df, 4, "id").collect()) == list(range(12))
    assert RS.pad_to_multiple(df.limit(0), 4, "id").count() == 0
    nan = spark.createDataFrame([(1, float("nan")), (2, None)], "id int, x double")
    assert RS.zip_equal(nan, nan, "id").count() == 2
    with pytest.raises(Exception, match="column x differs"):
        RS.zip_equal(nan, nan.fillna(1.0), "id").collect()
    taken = spark.createDataFrame([(2,), (3,), (5,), (40,)], "t int")
    new = sorted(r.new_id for r in RS.ids_beside(df, taken, "id").collect())
    assert new == [1, 4, 6, 7, 8, 9, 10, 11, 12, 13]
    assert one(spark, T.verdict_probability(F.lit(None).cast("double"), F.lit(0.0)), T.yes_share(F.lit(1.0), F.lit(1.0))) == [0.0, 0.5]


def test_strict_lines_fail_and_lenient_lines_skip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"id": 1}\n\n# note\n{"id": 2}\n{"id": \n')
    with pytest.raises(Exception, match="malformed line"):
        IO.read_json_lines_strict(spark, str(path), "id int").collect()
    path.write_text('{"id": 1}\n\n{"id": 2}\nnot json\n')
    assert sorted(r.id for r in IO.read_json_lines(spark, str(path), "id int").collect()) == [1, 2]


def test_file_per_record_and_document(spark, tmp_path):
    for domain, name in (("a.com", "x"), ("a.com", "y"), ("b.com", "z")):
        (tmp_path / domain).mkdir(exist_ok=True)
        (tmp_path / domain / f"{name}.json").write_text('{"title": "t %s"}' % name)
    rows = IO.read_file_per_record(spark, str(tmp_path), "title string", spark.createDataFrame([("y",)], "id string"))
    assert sorted((r.id, r.domain, r.title) for r in rows.collect()) == [("x", "a.com", "t x"), ("z", "b.com", "t z")]
    (tmp_path / "doc.json").write_text('[{"title": "a"}, {"title": "b"}]')
    assert sorted(tuple(r) for r in IO.read_json_document(spark, str(tmp_path / "doc.json"), "title string").collect()) == [("0", "a"), ("1", "b")]


def test_shards_hold_the_whole_digest(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "k string, v int")
    found = {r.k: r.s for r in df.select("k", IO.shard_of(F.col("k"), 7).alias("s")).collect()}
    assert found == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % 7 for k in found}
    IO.write_shards(df, str(tmp_path / "t"), "k", 7)
    assert [r.v for r in IO.read_shard(spark, str(tmp_path / "t"), "k", "k9", 7).collect()] == [9]


def test_upsert_keeps_the_last_change(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, seq int")
    assert sorted(tuple(r) for r in IO.upsert(old, new, "id", "seq").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert IO.upsert(old.limit(0), new.limit(0), "id", "seq").count() == 0


def test_upsert_stream_over_two_arrivals(spark, tmp_path):
    put = lambda n, *rows: spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    versions = []
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        put(n, *rows)
        stream = ST.read_arrivals(spark, str(tmp_path / "in"), "id int, v string")
        ST.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), "id", "v", then=versions.append).awaitTermination()
    assert len(versions) == 2
    assert sorted(tuple(r) for r in spark.read.parquet(versions[-1]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_dates_in_words_and_examples(spark):
    said = ("on March 10, 2024 onwards", "10th March 2024", "05/03/2024", "05.03.2024", "Mar 2024", "soon", "2024-1-5", "")
    assert one(spark, *[A.normal_date(F.lit(t)) for t in said]) == ["2024-03-10", "2024-03-10", "2024-03-05", "2024-03-05", "2024-03", "soon", "2024-1-5", ""]
    assert one(spark, A.parse_stamp(F.lit("03/25/2024")).cast("string"), A.parse_stamp(F.lit("25/03/2024")).cast("string"), A.parse_stamp(F.lit("2024"))) == ["2024-03-25 00:00:00", "2024-03-25 00:00:00", None]
    assert one(spark, TG.without_examples(F.lit("Pick a fruit, e.g. Kiwi (green)."), F.lit("kiwi (green)")), TG.without_examples(F.lit("x"), F.lit(None))) == ["Pick a fruit, ", "x"]
    assert one(spark, TG.nested_box(F.lit(r"\boxed{a{b}c} \boxed{d")), TG.nested_box(F.lit(None).cast("string"))) == [None, None]


def test_removed_examples_are_reported(spark):
    said = lambda t, a: TG.removed_examples(F.lit(t).cast("string"), F.lit(a).cast("string"))
    got = one(spark, said("Fruit, such as Kiwi. Or a bird (e.g. kiwi) like a KIWI!", "kiwi"), said("Kiwi alone", "kiwi"), said("such as x", None), said("such as x", " "), said(None, "x"))
    assert got == [["e.g. kiwi", "such as Kiwi.", "like a KIWI!"], [], [], [], None]


def test_validation_metrics_of_small_groups(spark):
    rows = [("s", "p", 0.8, "A", 1), ("s", "p", 0.9, "B", 2), ("s", "q", 0.9, "A", 3), ("s", "q", 0.8, "B", 4), ("s", "q", 0.7, "A", 5), ("s", "q", None, "B", 6), ("t", "p", 0.5, None, 7)]
    got = {r.source: r for r in G.validation_metrics(spark.createDataFrame(rows, "source string, prompt string, x double, pred string, seq int"), "source", "prompt", "x", "pred", "seq").collect()}
    assert got["s"].mean == pytest.approx((0.85 + 0.8) / 2) and got["t"].mean == got["t"].best == got["t"].maj == 0.5
    assert got["s"].maj == pytest.approx((0.8 + 0.9) / 2)  # first of a tie, then the majority's first value
    best_of_three = (0.7 * 1 + 0.8 * 7 + 0.9 * 19) / 27
    assert got["s"].best == pytest.approx(((0.8 + 3 * 0.9) / 4 + best_of_three) / 2)
    assert got["s"].worst == pytest.approx(((3 * 0.8 + 0.9) / 4 + (0.9 * 1 + 0.8 * 7 + 0.7 * 19) / 27) / 2)


def test_a_split_cuts_within_a_day(spark):
    rows = [(i, None if i < 2 else f"2024-01-{1 + i // 5:02d} 00:00:{i % 3:02d}") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))]
    for ratio in (0.0, 0.05, 0.37, 0.8, 1.0):
        got = {r.id: r.split for r in O.chronological_split(df, "at", "id", ratio).collect()}
        assert [got[i] for i in want] == ["train"] * int(20 * ratio) + ["test"] * (20 - int(20 * ratio))
    assert O.chronological_split(df.limit(0), "at", "id", 0.5).collect() == []


def test_neighbours_in_blocks_and_parts(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {}
    for r in T.knn(df.where("id % 5 = 0"), df, "id", "v", 4, block=7, part=40).collect():
        got.setdefault(r.q, []).append((-r.s, r.d))
    x = {r.id: r.v for r in df.collect() if r.v}
    cos = lambda a, b: round(sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5, 6)
    assert {q: sorted(n) for q, n in got.items()} == {q: sorted((-cos(x[q], x[d]), d) for d in x if d != q)[:4] for q in x if q % 5 == 0}
