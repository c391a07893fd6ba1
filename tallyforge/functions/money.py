"""Money as columns: minor units, rounding, tolerances and proofs. All decimal, all built-in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 4217 minor units that aren't two.
MINOR_UNITS = {
    "BHD": 3, "IQD": 3, "JOD": 3, "KWD": 3, "LYD": 3, "OMR": 3, "TND": 3,
    "CLF": 4,
    "BIF": 0, "CLP": 0, "DJF": 0, "GNF": 0, "JPY": 0, "KMF": 0, "KRW": 0, "MGA": 0, "PYG": 0, "RWF": 0, "UGX": 0, "VND": 0, "VUV": 0, "XAF": 0, "XOF": 0, "XPF": 0,
}
MONEY = "decimal(28,8)"


def minor_units(currency: Column) -> Column:
    """Digits behind the point; two for a code that isn't known."""
    by_digits: dict[int, list[str]] = {}
    for code, digits in MINOR_UNITS.items():
        by_digits.setdefault(digits, []).append(code)
    return reduce(lambda chain, kv: chain.when(currency.isin(kv[1]), kv[0]), by_digits.items(), F.when(currency.isNull(), 2)).otherwise(2)


def money_round(value: Column, digits: Column) -> Column:
    """value rounded half up to a column of digits (0, 2, 3 or 4), as MONEY."""
    value = value.cast(MONEY)
    pick = F.when(digits == 0, F.round(value, 0).cast(MONEY))
    for d in (3, 4):
        pick = pick.when(digits == d, F.round(value, d).cast(MONEY))
    return pick.otherwise(F.round(value, 2).cast(MONEY))


def money_equal(left: Column, right: Column, digits: Column) -> Column:
    """Equal after each side is rounded; null if either is."""
    return money_round(left, digits) == money_round(right, digits)


def exceeds(variance: Column, base: Column, absolute: Column, percentage: Column | None = None) -> Column:
    """Strictly beyond the absolute tolerance, or beyond the share of a positive base where one is set; a share only makes it stricter."""
    out = F.abs(variance) > absolute
    if percentage is not None:
        out |= percentage.isNotNull() & (base > 0) & (F.abs(variance) * 100 > percentage * base)
    return out


def to_decimal(text: Column, kind: str = "decimal(38,10)") -> Column:
    """Thousands commas and blanks out; null for what isn't a number."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast(kind)


def divide_money(amount: Column, quantity: Column) -> Column:
    """Price of one to eight places, only if it multiplies back to the amount at two."""
    price = F.round(F.try_divide(amount.cast("decimal(18,2)"), quantity.cast("decimal(10,3)")), 8).cast("decimal(18,8)")
    return F.when((quantity > 0) & (F.round(price * quantity.cast("decimal(10,3)"), 2) == F.round(amount, 2)), price)


def close(a: Column, b: Column) -> Column:
    """Within 0.02 or a thousandth of b, whichever is more."""
    return F.abs(a - b) <= F.greatest(F.lit(0.02), 0.001 * F.abs(b))
