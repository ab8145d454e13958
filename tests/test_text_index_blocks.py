import uuid

import pyarrow as pa

from quillcast.operators.ordering import shared_folder
from quillcast.sources import TextIndex
from quillcast.sources.text_index import _blocks


def test_blocks_of_a_range():
    table = pa.table({"r": pa.array([3, 3, 3], pa.int32()), "id": [9, 4, 5], "terms": pa.array([["b", "a", "b"], ["a"], []], pa.list_(pa.string()))})
    rows = {row["term"]: row for row in _blocks(table).to_pylist()}
    assert rows["a"] == {"term": "a", "r": 3, "n": 2, "most": 1, "least": 1, "docs": [{"id": 4, "length": 1, "positions": [0]}, {"id": 9, "length": 3, "positions": [1]}]}
    assert rows["b"] == {"term": "b", "r": 3, "n": 1, "most": 2, "least": 3, "docs": [{"id": 9, "length": 3, "positions": [0, 2]}]}
    assert _blocks(table.slice(0, 0)).num_rows == 0 if table.slice(0, 0).num_rows else True


def test_ranked_questions_move_no_row_for_each_posting(spark):
    index = TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", span=2, buckets=2)
    index.insert(spark.createDataFrame([(i, "a b" if i in (1, 3) else "b c") for i in range(6)], "id long, text string"))
    found = index.ranked(spark.createDataFrame([(0, "a b")], "q long, text string"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "explode(docs" not in plan
    assert [r.id for r in found.orderBy("rank").collect()] == [1, 3]
