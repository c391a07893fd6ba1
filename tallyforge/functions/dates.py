"""Dates and ages as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """ISO, long and unambiguous numeric dates; null for what could be two dates.

    A numeric date counts if one of its first two parts is over 12, or both
    are equal; years of two digits are of this century.
    """
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    long = F.lit(None).cast("date")
    for pattern, form in ((r"(?i)^\d{1,2} [a-z]{3} \d{4}$", "d MMM yyyy"), (r"(?i)^\d{1,2} [a-z]{4,} \d{4}$", "d MMMM yyyy"), (r"(?i)^[a-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"(?i)^[a-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"(?i)^\d{1,2}-[a-z]{3}-\d{4}$", "d-MMM-yyyy")):
        long = F.coalesce(long, F.when(t.rlike(pattern), F.try_to_date(F.initcap(t), form)))
    numeric = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2}|\d{4})$"
    a, b, y = (F.regexp_extract(t, numeric, i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y < 100, y + 2000).otherwise(y)
    day, month = F.when(a > 12, a).when(b > 12, b).when(a == b, a), F.when(a > 12, b).when(b > 12, a).when(a == b, b)
    parts = F.when(t.rlike(numeric), F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))
    return F.coalesce(iso, long, parts)


def age_seconds(now: Column, then: Column) -> Column:
    """Seconds since then, never negative, to the millisecond."""
    return F.greatest(F.lit(0.0), F.round((F.unix_micros(now) - F.unix_micros(then)) / 1e6, 3))
