"""Equality of formulas against exact fractions at many points, and the form that reads a solution's tail."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillcast.functions import formulas as M


def same(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r.s for r in rows.select("i", M.same_formula(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]


EQUAL = [
    ("2(x+1)", "2x+2"), (r"\frac{x^2-1}{x-1}", "x+1"), ("(a+b)^2", "a^2+2ab+b^2"), ("0.5", "1/2"), (r"\frac12x", "x/2"), ("-x^2", "0-x*x"), ("x^{-2}", r"\frac{1}{x^2}"), ("1/\\frac{1}{2}", "2"),
    (r"\frac{1}{2}^2", "0.25"), (r"2\pi r", r"r\cdot\pi\times 2"), (r"\sqrt{x+x}", r"\sqrt{2x}"), (r"\sqrt{3}\cdot 2", r"2\sqrt3"), ("2^{n+1}", "2^{1+n}"), ("x - -3", "x+3"), ("2*-3", "-6"),
    (r"x = 3", "3"), ("x**3", "x*x*x"), ("1-2-3", "-4"), ("8/4/2", "1"), ("3x2", "6x"), ("1.50", "1.5"), ("east", "east"), (None, None), ("", ""), ("1/0", "1/0"),
]
DIFFERENT = [
    ("2(x+1)", "2x+1"), ("x", "y"), ("x", "X"), ("east", "seat"), ("no", "on"), ("1/0", "2/0"), ("1/(x-x)", "0"), ("x+", "x"), ("(x", "x"), ("x)", "x"), ("()", ""), ("1-(2-3)", "1-2-3"), ("2^3", "6"),
    (r"\sqrt{4}x", "x"), ("1,2", "2,1"), ("x=1,y=2", "x=2,y=1"), (None, "1"), ("1", None), ("x" + "+x" * 600, "601x"), ("-2^2", "4"), ("", "0"),
]


def test_equal_and_different(spark):
    assert same(spark, EQUAL) == [True] * len(EQUAL)
    assert same(spark, DIFFERENT) == [False] * len(DIFFERENT)


def some(rng, depth):
    """A random formula: its spelling, and it as a function of x and y; three spellings of each step."""
    if depth == 0:
        n = rng.randrange(1, 3)
        return rng.choice([(str(n), lambda x, y: Fraction(n)), ("x", lambda x, y: x), ("y", lambda x, y: y)])
    (a, f), (b, g) = some(rng, depth - 1), some(rng, rng.randrange(depth))
    return rng.choice([
        (f"({a}+{b})", lambda x, y: f(x, y) + g(x, y)), (f"({b}+({a}))", lambda x, y: f(x, y) + g(x, y)), (f"({a}-{b})", lambda x, y: f(x, y) - g(x, y)), (f"(-({b})+{a})", lambda x, y: f(x, y) - g(x, y)),
        (f"{{{a}}}{{{b}}}".join([r"\frac", ""]), lambda x, y: f(x, y) / g(x, y)), (f"(({a})/({b}))", lambda x, y: f(x, y) / g(x, y)), (f"({a})({b})", lambda x, y: f(x, y) * g(x, y)), (rf"({b})\cdot({a})", lambda x, y: f(x, y) * g(x, y)),
        (f"({a})^2", lambda x, y: f(x, y) ** 2), (f"(({a})*({a}))", lambda x, y: f(x, y) ** 2),
    ])


def test_random_formulas_against_fractions(spark):
    rng, at = random.Random(5), [(Fraction(3 + 7 * k, 5), Fraction(11 - 4 * k, 9)) for k in range(40)]
    made = []
    while len(made) < 120:
        spelt, f = some(rng, 1 + rng.randrange(3))
        try:
            made.append((spelt, [f(x, y) for x, y in at]))
        except ZeroDivisionError:
            continue
    pairs = [(made[i], made[j]) for i in range(0, 120, 3) for j in range(120)]
    want = [p[1] == q[1] for p, q in pairs]
    assert sum(want) > len(pairs) // 40 and not all(want)
    assert same(spark, [(p[0], q[0]) for p, q in pairs]) == want


def test_tail_form(spark):
    rows = [
        ("so\nAnswer: $x = 1,234$ dollars", "1234", 1.0), ("answer :\\boxed{\\frac12}", "\\frac{1}{2}", 1.0), ("Answer: 3\nAnswer: 4", "3", -1.0), ("Answer: 3" + " " * 400, "3", -1.0),
        ("3", "3", -1.0), (None, "3", -1.0), ("Answer: 3", None, -1.0), ("", "", -1.0), ("Answer: 5 \\text{m}", "5", 1.0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string, want double").orderBy("i")
    assert [(r.got, r.i) for r in df.select("i", M.tail_score(F.col("s"), F.col("t")).alias("got")).collect()] == [(r[2], i) for i, r in enumerate(rows)]
    algebra = spark.createDataFrame([("Answer: $2(x+1)$", "2x+2")], "s string, t string").select(M.tail_score(F.col("s"), F.col("t"), M.same_formula).alias("got"), M.tail_score(F.col("s"), F.col("t")).alias("plain"))
    assert tuple(algebra.first()) == (1.0, -1.0)


@pytest.mark.parametrize("text,want", [("2(x+1)", "2 x 1 + *"), ("-x^2", "x {2} ¬"), (r"\frac{1}{2}^2", "1 2 ~ {2}"), ("a-b-c", "a b - c -"), (r"\sqrt{x}^3", "x √ {3}")])
def test_postfix(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(M.postfix(M.formula_tokens(F.col("t"))).alias("p")).first()
    assert " ".join(row.p) == want
