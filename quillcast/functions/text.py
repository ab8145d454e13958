"""Column functions over tagged texts and answers: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: All characters that count as white space, line ends and wide spaces included.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without white space at its ends; F.trim takes off blanks alone."""
    return F.btrim(text, F.lit(SPACES))


def last_tag(text: Column, tag: str) -> Column:
    """What stands in the last <tag>, up to the first </tag> after it, trimmed; '' if there is none."""
    after = F.substring_index(text, f"<{tag}>", -1)
    found = text.contains(f"<{tag}>") & after.contains(f"</{tag}>")
    return F.when(found, strip(F.substring_index(after, f"</{tag}>", 1))).otherwise("")


def after_thinking(text: Column) -> Column:
    """The segment between the first and a second </think>; the whole text if there is none."""
    return F.coalesce(F.try_element_at(F.split(text, "</think>"), F.lit(2)), text)


def last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def answer_of(text: Column) -> Column:
    return strip(last_match(after_thinking(text), r"(?s)<answer>(.*?)</answer>"))


def probability_of(text: Column) -> Column:
    return strip(last_match(after_thinking(text), r"(?s)<probability>(.*?)</probability>")).try_cast("double")


def boxed(text: Column) -> Column:
    return last_match(text, r"\\boxed\{([^{}]*)\}")


def verdict(text: Column) -> Column:
    """The last 0 or 1 by position; null without either."""
    digit = F.regexp_extract(text, r"(?s).*([01])", 1)
    return F.when(digit != "", digit.cast("int"))


def strip_thinking(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"\s+", " "))


def normal_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, spaces squeezed: in this order."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"\s+", " "))


def last_number(text: Column) -> Column:
    """The last number within the last 300 characters, without commas."""
    return F.regexp_replace(last_match(F.right(text, F.lit(300)), r"(-?[0-9][0-9.,]*)"), ",", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of words; short texts pass unchanged as one."""
    step = size - overlap
    w = words(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step)).cast("int") * step, F.lit(step))
    return F.when(F.size(w) <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " ")))


def domain_of(url: Column) -> Column:
    """Host, lower-cased, without port and a leading www."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def leaks(answer: Column, *components: Column) -> Column:
    """Whether the trimmed answer occurs in a component, case aside; rows without an answer do not leak."""
    a = F.lower(strip(answer))
    held = F.lit(False)
    for c in components:
        held = held | F.coalesce(F.lower(c).contains(a), F.lit(False))
    return F.coalesce(a != "", F.lit(False)) & held
