"""Date parsers, three dialects kept apart: assumed UTC, zone dropped, and strings compared as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def epoch_seconds(text: Column) -> Column:
    """Seconds from a number (over 1e12: milliseconds) or an ISO date; naive is UTC; else null."""
    n = text.try_cast("double")
    number = F.when(F.abs(n) > 1e12, n / 1000).otherwise(n).cast("long")
    stamp = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(strip(text), "[Zz]$", "+00:00")))
    return F.when(n.isNotNull(), number).otherwise(stamp)


def question_seconds(text: Column) -> Column:
    """As epoch_seconds, with UNKNOWN as null."""
    return F.when(F.upper(strip(text)) == "UNKNOWN", F.lit(None)).otherwise(epoch_seconds(text))


def strict_date(text: Column) -> Column:
    """The date of a yyyy-MM-dd string, null for any other."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def naive_timestamp(text: Column) -> Column:
    """Zone dropped, not converted."""
    plain = F.regexp_replace(F.regexp_replace(text, r"([+-]\d{2}:?\d{2}|Z)$", ""), "T", " ")
    return plain.try_cast("timestamp_ntz")


def latest_string(*dates: Column) -> Column:
    """The greatest as strings; nulls and '' are skipped."""
    return F.greatest(*[F.nullif(d, F.lit("")) for d in dates])


def earliest_string(*dates: Column) -> Column:
    return F.least(*[F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), d) for d in dates])
