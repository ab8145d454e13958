r"""Equality of formulas as column expressions: infix text to a postfix array, and its values at fixed points modulo a prime.

Two formulas that are the same rational function agree at every point; two that
differ agree at all of the points with a chance of about (degree / PRIME) ** POINTS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .tagged import normal_math
from .text import last_match, strip

#: A product of two residues fits a long.
PRIME = 2**31 - 1
POINTS = 3
#: Longer texts are no formulas: they are compared by spelling alone.
LONGEST = 1000

_TOKEN = r"\{-?\d+\}|\d+(?:\.\d+)?|[a-zA-Zπ]|[-+*/^()√~¬]"
_ENDS = r"[0-9a-zA-Zπ)}]"  # what may end an operand
_ORDER = {"+": 1, "-": 1, "*": 2, "/": 2, "¬": 3, "^": 4, "√": 5, "~": 6}


def formula_tokens(text: Column) -> Column:
    r"""The tokens of a formula with its products written out; null for what is none.

    Numbers, letters as variables, + - * / ^, brackets, \frac, \sqrt, \cdot, \times,
    \div and \pi are known. ~ divides the parts of a fraction and binds most, ¬ is a sign, and
    {n} the power by a whole number. Text with three letters in a row, or of letters
    alone, is a word and no formula.
    """
    t = normal_math(text)
    for pattern, by in (
        (r"\\cdot|\\times", "*"), (r"\\div", "/"), (r"\\pi", "π"), (r"\\d?frac", ""), (r"\\sqrt", "√"), (r"\}\{", ")~("), (r"\{", "("), (r"\}", ")"),
        (r"\*\*", "^"), (r"\^\((-?\d{1,6})\)(?!\^)", "{$1}"), (r"\^(-?\d{1,6})(?![\d^.])", "{$1}"),
        (rf"(?<!{_ENDS})\+", ""), (r"(?<![0-9a-zA-Zπ)}{])-", "¬"), (r"(?<=[0-9a-zA-Zπ)}])(?=[a-zA-Zπ(√])", "*"), (r"(?<=[a-zA-Zπ)}])(?=\d)", "*"),
    ):
        t = F.regexp_replace(t, pattern, by)
    spelt = F.regexp_replace(text, r"\\[a-zA-Z]+", "")
    known = (F.length(text) <= LONGEST) & ~spelt.rlike(r"[a-zA-Z]{3}|^\s*[a-zA-Z]{2,}\s*$") & t.rlike(rf"^(?:{_TOKEN})+$")
    return F.when(known, F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)))


def _postfix(tokens: Sequence[str]) -> list[str]:
    """Operands before their operators, by a stack of open operators. A bracket without its other half stays as a token without a value."""
    out: list[str] = []
    ops: list[str] = []
    for t in tokens:
        operand, power = t[0].isalnum(), t[0] == "{"
        # operators of at least this weight come off the stack first: none before an operand, an opening bracket or a prefix
        least = 99 if operand or t in ("(", "¬", "√") else 1 if t == ")" else 5 if power else _ORDER[t]
        while ops and _ORDER.get(ops[-1], 0) >= least:
            out.append(ops.pop())
        if operand or power or t == ")" and not ops:
            out.append(t)
        elif t == ")":
            ops.pop()
        else:
            ops.append(t)
    return out + ops[::-1]


@F.pandas_udf(ArrayType(StringType()))
def postfix(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else _postfix(t))


@lru_cache(maxsize=65_536)
def _hash(*parts: str | int) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") % PRIME


def _inverse(v: int | None) -> int | None:
    return pow(v, -1, PRIME) if v else None


def _applied(t: str, a: int | None, b: int | None) -> int | None:
    """An operator's value, b being its last operand."""
    if b is None or t not in ("¬", "√") and t[0] != "{" and a is None:
        return None
    if t[0] == "{":
        n, base = abs(int(t[1:-1])), _inverse(b) if t[1] == "-" else b
        return 1 if n == 0 else None if base is None else pow(base, n, PRIME)
    if t in ("/", "~"):
        return None if b == 0 else a * _inverse(b) % PRIME
    by = {"¬": lambda: -b, "√": lambda: _hash("√", b), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: _hash("^", a, b)}
    return by[t]() % PRIME if t in by else None


def _value(post: Sequence[str], point: int) -> int | None:
    stack: list[int | None] = []
    for t in post:
        if "0" <= t[0] <= "9":
            whole, _, places = t.partition(".")
            stack.append(int(whole + places) * pow(10, -len(places), PRIME) % PRIME)
        elif t.isalpha():
            stack.append(_hash(t, point))
        else:
            b, a = stack[-1] if stack else None, stack[-2] if len(stack) > 1 else None
            del stack[-1 if t in ("¬", "√") or t[0] == "{" else -2 :]
            stack.append(_applied(t, a, b))
    return stack[0] if len(stack) == 1 else None


@F.pandas_udf(ArrayType(LongType()))
def values_of(tokens: pd.Series) -> pd.Series:
    """The values of formulas modulo PRIME at POINTS points, letters being hashes of themselves and the point; null without one at some point. A root, and a power that is no whole number, are hashes of their parts."""

    def each(own: Sequence[str] | None) -> list[int] | None:
        if own is None:
            return None
        post = _postfix(own)
        found = [_value(post, p) for p in range(POINTS)]
        return None if None in found else found

    return tokens.map(each)


def formula_values(text: Column) -> Column:
    """Values at POINTS points; null for what is no formula or has no value at one of them. Equal formulas have equal values, so that it is a key to join and group by."""
    return values_of(formula_tokens(text))


def same_formula(one: Column, other: Column) -> Column:
    """Whether two answers are one formula: in one spelling, or as functions of their letters. Two nulls are equal, as a null and a text are not."""
    spelt = normal_math(one).eqNullSafe(normal_math(other))
    return F.coalesce(spelt | (formula_values(one) == formula_values(other)), F.lit(False)) | (one.isNull() & other.isNull())


# What the form with a tail of 300 characters replaces, and then takes out, in this order.
TAIL_REPLACED = (
    ("an ", ""), ("a ", ""), (".$", "$"), (r"\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (r",\text{and}", ","), (r"\text{and}", ","), (r"\text{m}", r"\text{}"),
)
TAIL_REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", r"\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters",
    "meals", "edges", "students", "childrentickets", "multiples", r"\text{s}", r"\text{.}", "\\text{\ns}", r"\text{}^2", r"\text{}^3", "\\text{\n}", r"\text{}", r"\mathrm{th}", r"^\circ",
    r"^{\circ}", r"\;", r",\!", "{,}", '"', r"\dots",
)


def normal_tail(answer: Column) -> Column:
    """What is behind the last sign of equality, without units and words of form, in one spelling."""
    t = F.substring_index(answer, "=", -1)
    for before, after in TAIL_REPLACED:
        t = F.replace(t, F.lit(before), F.lit(after))
    for gone in TAIL_REMOVED:
        t = F.replace(t, F.lit(gone))
    for pattern, by in (
        (r"(.*?)\$(.*?)\$(.*)", r"\$$2\$"), (r"\\(?:text|textbf|overline)\{(.*?)\}", "$1"), (r"\\boxed\{(.*)\}", "$1"), (r"frac([^{])(.)", "frac{$1}{$2}"), (r"sqrt([^{])", "sqrt{$1}"), (r"\$", ""),
    ):
        t = F.regexp_replace(t, pattern, by)
    return strip(F.when(F.replace(t, F.lit(",")).rlike(r"^\d+$"), F.replace(t, F.lit(","))).otherwise(t))


def tail_score(solution: Column, truth: Column, alike: Callable[[Column, Column], Column] | None = None) -> Column:
    """1.0 if the last 'Answer: ...' among a solution's last 300 characters (that is the form's rule) is the truth, else -1.0. ``alike`` compares both; without it their spellings are compared."""
    said = F.coalesce(last_match(F.right(solution, F.lit(300)), r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]"))
    said, true = normal_tail(said), normal_tail(truth)
    return F.when(F.coalesce(alike(said, true) if alike else said == true, F.lit(False)), 1.0).otherwise(-1.0)
