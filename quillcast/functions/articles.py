"""Column functions over articles and questions: dates in words, validity, relevance, labels and assembled texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Month names and the forms that a strict list of formats accepts.
MONTHS = "january february march april may june july august september october november december".split()
STAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM d, yyyy")


def parse_stamp(text: Column, formats: tuple[str, ...] = STAMP_FORMATS) -> Column:
    """The time without zone by the first format that reads the text whole; null if none does."""
    plain = F.regexp_replace(strip(text), r"(\.\d+)?([+-]\d{2}:?\d{2}|Z)?$", "")
    return F.coalesce(*[F.try_to_timestamp(F.when(plain.rlike(_shape(f)), plain), F.lit(f)).cast("timestamp_ntz") for f in formats])


def _shape(form: str) -> str:
    """A pattern for the length of each part of a format, so that a lenient parser can't guess."""
    shapes = {"yyyy": r"\d{4}", "MMMM": r"[A-Z][a-z]+", "d": r"\d{1,2}"}
    return "^" + re.sub(r"yyyy|MMMM|MM|dd|HH|mm|ss|d", lambda m: shapes.get(m[0], r"\d{2}"), form.replace("'", "")) + "$"


def month_number(name: Column) -> Column:
    """Two digits of a month's English name or its first three letters, case aside; null for other words."""
    n, out = F.lower(name), F.lit(None).cast("string")
    for i, m in enumerate(MONTHS, 1):
        out = F.when(n.isin(m, m[:3]), f"{i:02d}").otherwise(out)
    return out


def normal_date(text: Column) -> Column:
    """yyyy-MM-dd (or yyyy-MM) of a date in words or digits; the text itself if it is not understood."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*(on\s+|the\s+)", ""), r"(?i)\s*(onwards?|forward)\s*$", "")
    pick = lambda pattern, g: F.regexp_extract(t, pattern, g)
    slash, dots = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    swap = lambda p: F.concat_ws("-", pick(p, 3), pick(p, 2), pick(p, 1))
    us, eu, my = r"(\w+)\s+(\d{1,2}),?\s+(\d{4})", r"(\d{1,2})(?:st|nd|rd|th)?\s+(\w+)\s+(\d{4})", r"^(\w+)\s+(\d{4})$"
    whole = lambda y, m, d: F.when(m.isNotNull(), F.concat_ws("-", y, m, F.lpad(d, 2, "0")))
    words = F.coalesce(
        whole(pick(us, 3), month_number(pick(us, 1)), pick(us, 2)),
        whole(pick(eu, 3), month_number(pick(eu, 2)), pick(eu, 1)),
        F.when(month_number(pick(my, 1)).isNotNull(), F.concat_ws("-", pick(my, 2), month_number(pick(my, 1)))),
        strip(t),
    )
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t).when(t.rlike(slash), swap(slash)).when(t.rlike(dots), swap(dots)).otherwise(words)


def between_open(date: Column, low: str, high: str) -> Column:
    return (date > F.lit(low)) & (date < F.lit(high))


def last_date(publish: Column, modify: Column, download: Column, keep_publish: Column | None = None) -> Column:
    """The later of modification and download; publication counts instead of download where keep_publish holds, or without download."""
    first = F.when(F.coalesce(keep_publish, F.lit(False)) if keep_publish is not None else F.lit(False), publish).otherwise(F.coalesce(download, publish))
    return F.greatest(first, modify)


def word_count(*texts: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.size(F.filter(F.split(strip(F.coalesce(t, F.lit(""))), r"(?U)\s+"), lambda w: w != "")) for t in texts])


def is_relevant(question: Column, article: Column, no_good: Column) -> Column:
    """False for rows marked as irrelevant or as without a good question; missing marks pass."""
    return (F.coalesce(question, F.lit(1)) != 0) & (F.coalesce(article, F.lit(1)) != 0) & (F.coalesce(no_good, F.lit(0)) != 1)


def valid_if_present(*tests: tuple[Column, Column]) -> Column:
    """The conjunction of (value, test) in which a missing value passes."""
    return reduce(lambda a, b: a & b, [value.isNull() | F.coalesce(test, F.lit(False)) for value, test in tests])


def answer_of_resolution(resolution: Column) -> Column:
    r = resolution.cast("string")
    return F.when(r.isin("1", "1.0"), "Yes").when(r.isin("0", "0.0"), "No").otherwise(r)


def resolution_of_answer(answer: Column) -> Column:
    a = F.lower(answer)
    return F.when(a.contains("yes"), 1).when(a.contains("no"), 0).otherwise(-1)


def assembled(*parts: Column) -> Column:
    """Parts that are not blank, joined by line ends; pairs of line ends are halved in one pass."""
    kept = F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: strip(p) != "")
    return F.replace(F.array_join(kept, "\n"), F.lit("\n\n"), F.lit("\n"))


def start_before(start: Column, resolution: Column, days: int = 1) -> Column:
    """The start, moved to so many days before the resolution if it is later."""
    return F.least(start, F.date_sub(resolution, days))


def cut_start_date(background: Column) -> tuple[Column, Column]:
    """(date sentence, text without it): from 'Question Start Date:' to the first full stop after the first four digits, which stays."""
    pattern = r"(?s)Question Start Date:(.*?\d{4}[^.]*)"
    return strip(F.regexp_extract(background, pattern, 1)), F.regexp_replace(background, pattern, "")


def components_of(flat: dict[str, Column], text: Column, tags: dict[str, str]) -> dict[str, Column]:
    """Each component from its flat field if that is not blank, else from its tag in the text."""
    from .text import last_tag

    return {name: F.coalesce(F.when(strip(value) != "", value), last_tag(text, tags[name])) for name, value in flat.items()}


def components_present(parts: list[Column], least: int = 5) -> Column:
    return reduce(lambda a, b: a + b, [F.when(strip(F.coalesce(p, F.lit(""))) != "", 1).otherwise(0) for p in parts]) >= least
