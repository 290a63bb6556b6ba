"""Derived columns of the curated zone."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import iso_day
from .numbers import FLOAT_PATTERN, plain_float
from .text import strip

# US dollars per unit of currency.
FX_RATES = {"USD": 1.0, "EUR": 1.09, "GBP": 1.27, "CAD": 0.74, "AUD": 0.66, "JPY": 0.0067, "INR": 0.012}

# Country by the first octet of an address.
IP_COUNTRIES = {
    "192": "US", "10": "US", "172": "US", "203": "AU", "198": "GB", "45": "US", "104": "DE", "178": "FR",
}


def _lookup(key: Column, table: dict[str, object], default: object) -> Column:
    # A chain of comparisons is a literal in the plan: no join, no shuffle.
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    return expr.otherwise(default)


def amount_usd(amount: Column, currency: Column, rates: dict[str, float] = FX_RATES) -> Column:
    """amount x rate, half up to cents; missing or zero is 0, text is NULL."""
    # A rate is a whole number of ten-thousandths, so products are exact and are
    # rounded once, at the hundreds place.
    parts = {k: F.lit(round(v * 10_000)).cast("decimal(5,0)") for k, v in rates.items()}
    rate = _lookup(F.upper(currency), parts, F.lit(10_000).cast("decimal(5,0)"))
    text = strip(amount)
    # up to twelve digits before the dot with twenty after it, else up to 24 with eight
    cents = [F.round(text.try_cast(kind) * rate, -2).cast("double") / 10_000 for kind in ("decimal(32,20)", "decimal(32,8)")]
    value = F.when(text.rlike(FLOAT_PATTERN),
                   F.coalesce(*cents, text.try_cast("double") * rate.cast("double") / 10_000))
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(value)


def age_group(dob: Column, as_of: datetime.date | str) -> Column:
    years = F.floor(F.datediff(F.lit(str(as_of)).cast("date"), iso_day(dob)) / 365)
    return (
        F.when(years.isNull(), "Unknown")
        .when(years < 18, "Under 18")
        .when(years <= 25, "18-25")
        .when(years <= 40, "26-40")
        .when(years <= 60, "41-60")
        .otherwise("60+")
    )


def tenure_years(joined: Column, as_of: datetime.date | str) -> Column:
    """Days / 365.25 to two places.  A tie at half a hundredth cannot occur, so
    adding a half and taking the floor is exact for either sign."""
    days = F.datediff(F.lit(str(as_of)).cast("date"), iso_day(joined)).cast("bigint")
    return F.floor((days * 800 + 1461) / 2922).cast("double") / 100.0


def ip_country(ip: Column, countries: dict[str, str] = IP_COUNTRIES) -> Column:
    return _lookup(F.substring_index(ip, ".", 1), countries, "Unknown")


def is_anomaly(temperature: Column, low: float = -10.0, high: float = 80.0) -> Column:
    t = F.coalesce(plain_float(temperature), F.when(temperature.isNotNull(), 0.0))
    return F.when((t > high) | (t < low), 1).otherwise(0)


def number_or_zero(c: Column) -> Column:
    """Double value of a text; non-numeric text is 0, NULL stays NULL."""
    return F.coalesce(plain_float(c), F.when(c.isNotNull(), 0.0))


def quality_flag(missing: list[Column], extra_columns: int = 0) -> Column:
    """POOR when over 30% of the cells are missing.  ``extra_columns`` counts
    columns that are never missing but belong to the row."""
    n = sum((m.cast("int") for m in missing), F.lit(0))
    return F.when(n * 10 > 3 * (len(missing) + extra_columns), "POOR").otherwise("OK")
