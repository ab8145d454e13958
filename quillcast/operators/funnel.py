"""All counters of a question pipeline, by stage and by position, in one pass over its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.tagged import NO_QUESTION, choice_score
from ..functions.text import strip

_yes = lambda c: F.coalesce(c, F.lit(False))


def _first(text: Column, tag: str) -> Column:
    """What stands in the first whole tag, stripped; null without one."""
    start = F.instr(text, f"<{tag}>") + len(tag) + 2
    after = F.substr(text, start)
    return F.when(text.contains(f"<{tag}>") & after.contains(f"</{tag}>"), strip(F.substring_index(after, f"</{tag}>", 1)))


def _leak(text: Column, answer: Column) -> Column:
    """Whether the answer, in lower case, stands outside its tags; null without an answer."""
    return F.when(answer != "", F.lower(F.regexp_replace(text, r"(?s)<answer>.*?</answer>", "")).contains(answer))


def _marked(rows: DataFrame, count: int) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with their flags in columns funnel__*, and the counters as aggregates over them.

    Each step is a column of its own, so that no text is taken apart twice. The
    choice is the question that it gives back, by likeness of title and answer;
    the first of the best, none if none is alike or none was good.
    """
    every = range(1, count + 1)
    c = lambda name: F.col(f"funnel__{name}")
    add = lambda df, columns: df.withColumns({f"funnel__{name}": column for name, column in columns.items()})
    one = lambda name: _yes(F.col(name) == 1)
    has = lambda q: _yes(F.length(strip(q)) > 10)
    part = lambda text, tag: F.lower(_first(text, tag))
    response, final = F.col("choose_best_response"), F.col("final_question")
    good_one = ~F.upper(response).contains(NO_QUESTION)
    texts = {f"{what}{i}": column for i in every for q in [F.col(f"q{i}")] for what, column in (("made", has(q)), ("title", part(q, "question_title")), ("answer", part(q, "answer")))}
    texts |= {"good": one("choose_best") & _yes((response != "") & good_one), "block": _first(response, "q1"), "chosen": F.regexp_extract(response, r"(?s)<q1>.*?</q1>", 0), "final": F.when(has(final), final)}
    marked = add(rows, texts)
    marked = add(marked, {"title": part(c("block"), "question_title"), "answer": part(c("block"), "answer"), "chosen_answer": part(c("chosen"), "answer"), "final_answer": part(c("final"), "answer")})
    scores = {}
    for i in every:
        t, a, title, answer = c(f"title{i}"), c(f"answer{i}"), c("title"), c("answer")
        either = lambda x, y: x.contains(y) | y.contains(x)
        scores[f"score{i}"] = F.when(t.isNotNull() & a.isNotNull() & title.isNotNull() & answer.isNotNull(), choice_score(t == title, either(t, title), a == answer, either(a, answer))).otherwise(0)
    marked = add(marked, scores)
    alike = F.array(*[c(name) for name in scores])
    marked = add(marked, {"best": F.when(c("good"), F.array_max(alike)).otherwise(0)})
    flags = {f"valid{i}": c(f"made{i}") & one(f"q{i}_valid") for i in every} | {f"leak{i}": F.when(c(f"made{i}"), _leak(F.col(f"q{i}"), c(f"answer{i}"))) for i in every}
    flags |= {"selected": F.when(c("best") >= 80, F.array_position(alike, c("best"))).otherwise(0), "chosen_leak": F.when(c("good"), _leak(c("chosen"), c("chosen_answer"))), "final_leak": _leak(c("final"), c("final_answer"))}
    marked = add(marked, flags)
    each = lambda name, test=lambda x: x: reduce(Column.__add__, [F.count_if(test(c(f"{name}{i}"))) for i in every])
    made, valid = each("made"), each("valid")
    counters = {
        "source_articles": F.count(F.lit(1)), "total_questions_generated": made, "questions_with_content": made, "valid_questions": valid, "invalid_questions": made - valid,
        "articles_with_valid_questions": F.count_if(reduce(Column.__or__, [c(f"valid{i}") for i in every])), "articles_with_no_good_question": F.count_if(one("no_good_question")), "articles_choose_best_completed": F.count_if(one("choose_best")),
        "questions_with_leakage": each("leak"), "questions_without_leakage": each("leak", lambda x: ~x),
        "chosen_questions_with_leakage": F.count_if(c("chosen_leak")), "chosen_questions_without_leakage": F.count_if(~c("chosen_leak")),
        "final_questions_with_leakage": F.count_if(c("final_leak")), "final_questions_without_leakage": F.count_if(~c("final_leak")),
        "stage_individual_validation_completed": F.count_if(one("individual_validation_done")), "stage_choose_best_completed": F.count_if(one("choose_best")), "stage_leakage_check_completed": F.count_if(one("leakage_check")),
    }
    for i in every:
        counters |= {f"position_{i}_total": F.count(F.lit(1)), f"position_{i}_valid": F.count_if(c(f"valid{i}")), f"position_{i}_invalid": F.count_if(c(f"made{i}") & ~c(f"valid{i}")), f"selected_{i}": F.count_if(c("selected") == i)}
    return marked, counters


def funnel_counters(rows: DataFrame, count: int = 3) -> DataFrame:
    """(counter, n) for rows with q1, q1_valid, ..., choose_best, choose_best_response, no_good_question, final_question, individual_validation_done and leakage_check. A text of ten characters or fewer is no question; nulls count as absent."""
    marked, counters = _marked(rows, count)
    totals = marked.agg(*[c.alias(name) for name, c in counters.items()])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(name).alias("counter"), F.col(name).alias("n")) for name in counters])).alias("c")).select("c.*")


def observed_funnel(rows: DataFrame, observation: Observation, count: int = 3) -> DataFrame:
    """The rows unchanged; whatever first runs over all of them fills the observation with the counters, without a scan of its own."""
    marked, counters = _marked(rows, count)
    return marked.observe(observation, *[c.alias(name) for name, c in counters.items()]).select(*rows.columns)
