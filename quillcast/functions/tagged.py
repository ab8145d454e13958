"""Column functions over generated texts: numbered answers, verdicts, question blocks, names of files and prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import last_match, last_tag, strip

# Tags of a complete question, its mark of failure, and phrases before an answer.
QUESTION_TAGS = ("question_id", "question_title", "background", "resolution_criteria", "answer", "answer_type")
NO_QUESTION = "NO GOOD QUESTION"
ANSWER_PHRASES = (r"the answer is\s+(.+?)(?:\.|$)", r"answer:\s+(.+?)(?:\.|$)", r"final answer:?\s+(.+?)(?:\.|$)")


def numbered_answers(text: Column) -> Column:
    """Map from answer to probability of the numbered pairs; those outside [0, 1] are left out, the last of equal answers counts."""
    pattern = r"(?s)<answer(\d+)>(.*?)</answer\1>\s*<probability\1>(.*?)</probability\1>"
    group = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    pairs = F.arrays_zip(group(2).alias("a"), group(3).alias("p"))
    typed = F.transform(pairs, lambda x: F.struct(strip(x["a"]).alias("a"), strip(x["p"]).try_cast("double").alias("p")))
    good = F.filter(typed, lambda x: x["p"].between(0, 1))
    names = F.array_distinct(F.transform(good, lambda x: x["a"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(good, lambda x: x["a"] == n), -1)["p"])
    return F.map_from_arrays(names, last)


@F.pandas_udf(StringType())
def nested_box(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    r"""What the last \boxed{...} holds, with balanced braces inside; null if it is not closed."""

    def inner(text: str | None) -> str | None:
        at = text.rfind("\\boxed{") if text else -1
        if at < 0:
            return None
        depth, begin = 0, at + len("\\boxed{")
        for i in range(begin - 1, len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if depth == 0:
                return text[begin:i]
        return None

    for batch in texts:
        yield batch.map(inner)


def answer_or_phrase(text: Column) -> Column:
    """The last answer tag, else the last boxed text, else what follows the first phrase that occurs, lower-cased; '' without any."""
    found = [strip(last_match(text, r"(?s)<answer>\s*(.*?)\s*</answer>")), strip(last_match(text, r"(?s)\\boxed\{(.*?)\}"))]
    return F.coalesce(*found, *[strip(last_match(F.lower(text), p)) for p in ANSWER_PHRASES], F.lit(""))


def digit_verdict(text: Column) -> Column:
    """'0' or '1': the first standalone one of the last answer tag, else the last of the text, else '1'; '' for an empty text."""
    tag = F.regexp_extract(F.coalesce(last_match(text, r"(?s)<answer>\s*(.*?)\s*</answer>"), F.lit("")), r"\b([01])\b", 1)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.coalesce(F.when(tag != "", tag), last_match(text, r"\b([01])\b"), F.lit("1")))


def final_question(text: Column, tags: tuple[str, ...] = QUESTION_TAGS) -> Column:
    """The last content of each tag, put together again in order; '' if one is missing or the text says there is no good question."""
    parts = [last_tag(text, t) for t in tags]
    whole = F.concat_ws("\n", *[F.concat(F.lit(f"<{t}>"), p, F.lit(f"</{t}>")) for t, p in zip(tags, parts)])
    lacks = F.array_contains(F.array(*parts), "") | text.contains(NO_QUESTION)
    return F.when(F.coalesce(lacks, F.lit(True)), "").otherwise(whole)


def question_blocks(text: Column, count: int) -> Column:
    """Up to count blocks <q1>, <q2>, ..., each wrapped as <q1>; a missing one is looked for behind its question_id, which counts from 0."""
    blocks = []
    for n in range(1, count + 1):
        own = last_none(F.regexp_extract_all(text, F.lit(rf"(?s)<q{n}>(.*?)</q{n}>"), F.lit(1)))
        other = last_none(F.regexp_extract_all(text, F.lit(rf"(?s)<question_id>{n - 1}</question_id>(.*?)(?=<question_id>|\z)"), F.lit(1)))
        body = F.coalesce(strip(own), F.concat(F.lit(f"<question_id>{n - 1}</question_id>\n"), strip(other)))
        blocks.append(F.concat(F.lit("<q1>\n"), body, F.lit("\n</q1>")))
    return F.array_compact(F.array(*blocks))


def last_none(found: Column) -> Column:
    """The first of an array of matches, null for none."""
    return F.get(found, F.lit(0))


def fenced_json(text: Column, count: int) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(.*?)\s*```"), F.lit(1)), strip), 1, count)


def source_of_file(name: Column, known: tuple[str, ...] = ()) -> Column:
    """The source in a file's name: the second-last label of a domain, else a known source, else what stands before a number, else the stem."""
    stem = F.regexp_replace(F.regexp_extract(F.lower(name), r"([^/]+)$", 1), r"\.(jsonl|json)$", "")
    domain = F.regexp_extract(stem, r"(?:^|[^a-z0-9.-])?([a-z0-9-]+)\.(?:com|org|net|co|in|uk|de|fr)(?![a-z0-9-])", 1)
    listed = F.coalesce(*[F.when(stem.contains(k), k) for k in known], F.lit(None).cast("string"))
    number = F.regexp_extract(stem, r"^([a-z-]+)_\d", 1)
    return F.coalesce(F.nullif(domain, F.lit("")), listed, F.nullif(number, F.lit("")), stem)


def run_of_file(name: Column) -> dict[str, Column]:
    """Model, generations, checkpoint and variant from names like model-variant_checkpoint_300_size_207_generations_5.jsonl."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"\.jsonl?$", "")
    number = lambda p: F.nullif(F.regexp_extract(stem, p, 1), F.lit("")).try_cast("int")
    model = F.regexp_replace(stem, r"[_-](checkpoint|size|generations?)[_-].*$", "")
    return {"model": model, "generations": number(r"generations?[_-](\d+)"), "checkpoint": number(r"checkpoint[_-](\d+)"), "variant": F.nullif(F.regexp_extract(model, r"-([a-z]+)$", 1), F.lit(""))}


def simple_tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-cased words without other characters than a-z, longer than two, not in stop. Words are not reduced to lemmas."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)


def normal_math(text: Column) -> Column:
    r"""One spelling of a formula: no spaces, units, signs of money and per cent, \left and \right; tfrac and dfrac as frac; .5 as 0.5; a/b as \frac{a}{b}."""
    t = text
    for pattern, by in ((r"\n|\\!|\\left|\\right|\^\{?\\circ\}?|\\?\$|\\?%", ""), (r"\\text\{ .*$", ""), (r"[td]frac", "frac"), (r"(^|[{ ])\.", "$10."), (r"(?s)^[^=]{0,2}=([^=]*)$", "$1"), (r"\\sqrt([^{\s])", r"\\sqrt{$1}"), (r"\s+", "")):
        t = F.regexp_replace(t, pattern, by)
    t = F.regexp_replace(t, r"\\frac(\d)(\d)", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"^(-?\d+)/(\d+)$", r"\\frac{$1}{$2}")
    return F.when(t == "0.5", r"\frac{1}{2}").otherwise(t)


def article_prompt(title: Column, authors: Column, day: Column, passage: Column, summary: Column) -> Column:
    """Lines for one retrieved article: title, the first five authors, the date in words, and the passage or else the summary; absent parts are left out."""
    line = lambda name, c: F.when(strip(c) != "", F.concat(F.lit(f"{name}: "), c))
    body = F.coalesce(F.nullif(strip(passage), F.lit("")), summary)
    return F.concat_ws("\n", line("Title", title), line("Authors", F.array_join(F.slice(authors, 1, 5), ", ")), line("Date", F.date_format(day, "MMMM dd, yyyy")), line("Passage", body))


def choice_score(title_same: Column, title_in: Column, answer_same: Column, answer_in: Column) -> Column:
    """100 for an equal title or 50 for a contained one, and 80 or 40 for the answer."""
    return F.when(title_same, 100).when(title_in, 50).otherwise(0) + F.when(answer_same, 80).when(answer_in, 40).otherwise(0)


def leaks_in_tagged(text: Column) -> Column:
    """Whether the answer of a tagged question occurs in its other parts."""
    a = F.lower(last_tag(text, "answer"))
    rest = F.lower(F.regexp_replace(text, r"(?s)<answer>.*?</answer>", ""))
    return F.coalesce((a != "") & rest.contains(a), F.lit(False))


# Phrases that introduce an example, in the order in which they are looked for.
EXAMPLE_INTROS = (
    "e.g.", "eg.", "example:", "for example", "such as", "like", "including", "specifically", "namely", "i.e.", "ie.", "that is", "in other words", "to illustrate", "as an example", "for instance",
)


def without_examples(text: Column, answer: Column) -> Column:
    """The text without the phrases from an introduction to the answer, case aside, if no sentence ends between them. The stop right after the answer goes too."""
    return F.when(F.coalesce(strip(answer), F.lit("")) == "", text).otherwise(_examples(text, answer)["t"])


def _examples(text: Column, answer: Column) -> Column:
    """(t, gone): the text without the phrases, and these. Each introduction is tried once, on what the ones before left, and by a pattern only where the text holds it."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(strip(answer), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E[.!?]?"))
    intros = F.array(*[F.struct(F.lit(i).alias("plain"), F.lit(rf"(?is)\b{i.replace('.', r'\.')}\s*[^.!?]*?").alias("pattern")) for i in EXAMPLE_INTROS])
    lower = lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def step(state: Column, intro: Column, rest: Column) -> Column:
        pattern = F.concat(intro["pattern"], rest)
        gone = F.concat(state["gone"], F.regexp_extract_all(state["t"], pattern, F.lit(0)))
        taken = F.struct(F.regexp_replace(state["t"], pattern, F.lit("")).alias("t"), gone.alias("gone"))
        return F.when(lower(state["t"]).contains(intro["plain"]), taken).otherwise(state)

    first = F.struct(text.alias("t"), F.array().cast("array<string>").alias("gone"))
    return F.get(F.transform(F.array(quoted), lambda rest: F.aggregate(intros, first, lambda s, i: step(s, i, rest))), F.lit(0))


def removed_examples(text: Column, answer: Column) -> Column:
    """The phrases that without_examples takes out, in the order of the introductions; none without an answer, null for a null text."""
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when((F.coalesce(strip(answer), F.lit("")) == "") | text.isNull(), none).otherwise(_examples(text, answer)["gone"])
