"""Number, money and date functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity (Spark's round() takes them away from zero)."""
    return F.floor(c + 0.5) if digits == 0 else F.floor(c * 10**digits + 0.5) / 10**digits


def cents(c: Column) -> Column:
    """An amount as whole cents."""
    return half_up(c * 100).cast("long")


def months_inclusive(first: Column, last: Column) -> Column:
    """Calendar months from ``first`` to ``last``, both counted; 0 if either is missing or last is earlier."""
    n = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
    return F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("long")


def iso_date(c: Column) -> Column:
    """The date at the front of an ISO text; null if it is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def two_letters(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[A-Za-z]{2}$"), F.upper(F.trim(c)))
