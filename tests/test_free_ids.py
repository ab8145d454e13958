from quillcast.operators import reshape as RS


def test_free_ids_end_below_stop(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id int")
    taken = spark.createDataFrame([(2,), (3,), (5,), (9,)], "t int")
    assert sorted(r.new_id for r in RS.ids_beside(df, taken, "id", stop=10).collect()) == [1, 4, 6, 7, 8]
    assert RS.ids_beside(df, taken, "id", stop=100).count() == 10
