"""Number parsing, exact rounding, and numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# A fraction or an exponent needs a dot: 1.0e5 is a number, 1e5 is not.
NUMBER_PATTERN = r"^[+-]?(\d+|\d*\.\d*([eE][+-]?\d+)?)$"
INT_PATTERN = r"^[+-]?\d+$"
FLOAT_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FLOAT_OR_SPECIAL_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def without_commas(c: Column) -> Column:
    return strip(F.translate(c, ",", ""))


def number(c: Column) -> Column:
    """Double value of a cell, thousands commas removed; NULL if not a number."""
    # The pattern stops Spark from reading '1d' or 'inf'.  Taking the match
    # itself, the text is worked out once.
    return F.regexp_extract(without_commas(c), NUMBER_PATTERN, 0).try_cast("double")


def plain_float(c: Column) -> Column:
    """Double value of a cell as a loosely typed REAL column would read it."""
    text = strip(c)
    return F.when(text.rlike(FLOAT_PATTERN), text.try_cast("double"))


def plain_int(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(INT_PATTERN), text.try_cast("bigint"))


def float_text(x: Column) -> Column:
    """Shortest decimal text of a double: 4512.33, 100.0, 1e+16.

    Spark writes 12345678.9 as 1.23456789E7, so values of ordinary size go
    through a decimal.
    """
    plain = F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    sci = F.lower(F.regexp_replace(x.cast("string"), r"\.0E", "E"))
    sci = F.regexp_replace(sci, r"e(\d)", "e+$1")
    sci = F.regexp_replace(sci, r"e([+-])(\d)$", "e$10$2")
    size = F.abs(x)
    return F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain).otherwise(sci)


def whole_text(c: Column) -> Column:
    """A whole number's digits without its sign, commas and leading zeros; exact
    at any length."""
    return F.regexp_replace(without_commas(c), r"^[+-]?0*(?=\d)", "")


def abs_text(c: Column, x: Column) -> Column:
    """Text of the absolute value of the number in ``c``, whose double is ``x``:
    whole, digit for digit, if it is written without a dot."""
    return F.when(F.contains(c, F.lit(".")), float_text(F.abs(x))).otherwise(whole_text(c))


def int_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def ratio(n: Column, total: Column, digits: int, scale: int = 100) -> Column:
    """scale * n / total, rounded half up to ``digits`` places with whole-number
    arithmetic, so that no two engines can disagree.  0.0 for an empty total.
    Both arguments must be non-negative bigints."""
    unit = 10**digits
    top = n * F.lit(2 * scale * unit).cast("bigint") + total
    exact = int_div(top, total * 2).cast("double") / F.lit(float(unit))
    return F.when(total > 0, exact).otherwise(F.lit(0.0))


def share(n: int, total: int, digits: int, scale: int = 100) -> float:
    """The same of two known numbers."""
    unit = 10**digits
    return (n * 2 * scale * unit + total) // (2 * total) / unit if total else 0.0


def round_decimal(x: Column, digits: int) -> Column:
    """Round a double half up on its decimal digits."""
    exact = F.round(x.try_cast("decimal(38,10)"), digits).cast("double")
    return F.coalesce(exact, x)


def cents_text(x: Column) -> Column:
    """Text of a double rounded half up to cents; as it is if it is too large to have cents."""
    exact = F.coalesce(F.round(x.try_cast("decimal(38,20)"), 2).cast("double"), F.round(x.try_cast("decimal(38,4)"), 2).cast("double"))
    return float_text(F.coalesce(exact, x))
