"""Counters by hand, and the same ones observed while rows are written."""

import pytest
from pyspark.sql import Observation

from quillcast.operators.funnel import funnel_counters, observed_funnel
from quillcast.plans.outcomes import wide_funnel

ASK = "<question_title>{}</question_title><answer>{}</answer>{}".format
COLUMNS = "q1 string, q1_valid int, q2 string, q2_valid int, choose_best int, choose_best_response string, no_good_question int, final_question string, individual_validation_done int, leakage_check int"
ROWS = [
    (ASK("Who wins?", "Ann", " ann will"), 1, ASK("Where?", "Rome", ""), 0, 1, f"<q1>{ASK('where?', 'ROME', '')}</q1>", 0, ASK("Where?", "Rome", ""), 1, 1),  # the second, case aside
    (ASK("Who wins", "Ann", ""), 1, ASK("Who wins?", "Ann B", ""), 1, 1, f"<q1>{ASK('Who wins?', 'Ann', ' Ann')}</q1>", 0, "  short  ", 1, 0),  # 50 + 80 against 100 + 40: the second
    (ASK("A", "x", ""), 1, ASK("B", "y", ""), 1, 1, f"<q1>{ASK('C', 'z', '')}</q1>", 0, None, 1, 0),  # none alike
    (ASK("A", "", " without an answer"), 1, "", 1, 1, f"No Good Question <q1>{ASK('A', 'a', '')}</q1>", 1, "a final question without tags", 0, None),
    (None, None, None, None, None, None, None, None, None, None),
    ("0123456789", 1, "0123456789a", 0, 0, f"<q1>{ASK('A', 'a', '')}</q1>", 0, ASK("It is x", "IT", ""), 0, 0),  # a response that does not count
]
WANT = {
    "source_articles": 6, "total_questions_generated": 8, "questions_with_content": 8, "valid_questions": 6, "invalid_questions": 2, "articles_with_valid_questions": 4, "articles_with_no_good_question": 1,
    "articles_choose_best_completed": 4, "questions_with_leakage": 1, "questions_without_leakage": 5, "chosen_questions_with_leakage": 1, "chosen_questions_without_leakage": 2, "final_questions_with_leakage": 1,
    "final_questions_without_leakage": 1, "stage_individual_validation_completed": 3, "stage_choose_best_completed": 4, "stage_leakage_check_completed": 1,
    "position_1_total": 6, "position_1_valid": 4, "position_1_invalid": 0, "selected_1": 0, "position_2_total": 6, "position_2_valid": 2, "position_2_invalid": 2, "selected_2": 2,
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_counters(rows):
    assert {r.counter: r.n for r in funnel_counters(rows, 2).collect()} == WANT
    assert {r.n for r in funnel_counters(rows.limit(0), 2).collect()} == {0}


def test_observed_while_rows_flow_on(rows, tmp_path):
    seen = Observation("funnel")
    flowing = observed_funnel(rows, seen, 2)
    flowing.write.parquet(str(tmp_path / "out"))
    assert seen.get == WANT
    assert flowing.columns == rows.columns and sorted(map(str, flowing.collect())) == sorted(map(str, rows.collect()))


def test_no_text_is_taken_apart_twice(rows):
    """One replacement for each question, the choice and the final form, in the plan that runs."""
    plan = funnel_counters(rows, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 4 and "regexp_extract_all" not in plan


def test_rows_of_a_small_file_are_dealt_to_all_tasks(spark, sf_dir):
    assert wide_funnel(spark, sf_dir).rdd.getNumPartitions() == 4
