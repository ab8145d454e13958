"""Folds over arrays of token values, divergences and clipped losses, and rows from tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def divergence(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """Estimators of the divergence of two policies from one sample: k1, abs, k2 (half the square) and k3, clamped at both ends."""
    d = logp - ref
    if kind == "k3":
        x = clip(-d, -20.0, 20.0)
        return clip(F.exp(x) - x - 1, -10.0, 10.0)
    return {"k1": d, "abs": F.abs(d), "k2": 0.5 * d * d}[kind]


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def log_prob_at(logits: Column, index: Column) -> Column:
    """The log probability of the entry at a 0-based index."""
    return F.get(logits, index) - log_sum_exp(logits)


def entropy(logits: Column) -> Column:
    total = log_sum_exp(logits)
    return total - F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - total) * x)


def clipped_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """The larger of the plain and the clipped loss of a token; for negative advantages at most -adv * dual."""
    ratio = F.exp(clip(logp - old, -20.0, 20.0))
    worse = F.greatest(-adv * ratio, -adv * clip(ratio, 1 - low, 1 + high))
    return F.when(adv < 0, F.least(worse, -adv * dual)).otherwise(worse)


def value_loss(value: Column, old: Column, returns: Column, width: float) -> Column:
    clipped = F.least(F.greatest(value, old - width), old + width)
    return 0.5 * F.greatest((value - returns) ** 2, (clipped - returns) ** 2)


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    """0 up to longest - buffer, then falling to -factor over the buffer and on."""
    return F.least(-(length - (longest - buffer)) / buffer * factor, F.lit(0.0))


def tuple_rows(df: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """(key, form, text): one row for each named part of each tuple."""
    rows = F.array(*[F.struct(F.lit(n).alias("form"), c.alias("text")) for n, c in parts.items()])
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.form", "x.text")
