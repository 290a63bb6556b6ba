"""Date parsing.  Every format is tried in order behind a shape test, so that
Spark's parser never sees (and never raises on) a text of another shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

YEAR_FIRST = r"^(?!0000)(\d{4})%s(\d{1,2})%s(\d{1,2})$"
YEAR_LAST = r"^(\d{1,2})%s(\d{1,2})%s(?!0000)(\d{4})$"
CLOCK = r"^(?!0000)(\d{4}-\d{1,2}-\d{1,2})\s+(\d{1,2}:\d{1,2}:\d{1,2})$"

# Format name -> (shape, order of year, month and day groups).
NUMERIC_FORMATS = {
    "%Y-%m-%d": (YEAR_FIRST % ("-", "-"), "$1-$2-$3"),
    "%Y/%m/%d": (YEAR_FIRST % ("/", "/"), "$1-$2-$3"),
    "%d/%m/%Y": (YEAR_LAST % ("/", "/"), "$3-$2-$1"),
    "%m/%d/%Y": (YEAR_LAST % ("/", "/"), "$3-$1-$2"),
    "%d-%m-%Y": (YEAR_LAST % ("-", "-"), "$3-$2-$1"),
    "%d.%m.%Y": (YEAR_LAST % (r"\.", r"\."), "$3-$2-$1"),
    "%m.%d.%Y": (YEAR_LAST % (r"\.", r"\."), "$3-$1-$2"),
}

# The three lists of formats, in the order they are tried.
ZONE_FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y"]
ANY_FILE_FORMATS = ZONE_FORMATS + ["%Y/%m/%d", "%d.%m.%Y", "%m.%d.%Y"]
PROFILE_FORMATS = [
    "%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%d.%m.%Y",
    "%Y-%m-%d %H:%M:%S", "%d %b %Y", "%b %d, %Y",
]


def _parsed(s: Column, fmt: str) -> Column:
    """Date (or timestamp) of ``s`` in one format, NULL if it does not match."""
    if fmt in NUMERIC_FORMATS:
        shape, order = NUMERIC_FORMATS[fmt]
        iso = s if fmt == "%Y-%m-%d" else F.regexp_replace(s, shape, order)
        return F.when(s.rlike(shape), iso.try_cast("date"))
    if fmt == "%Y-%m-%d %H:%M:%S":
        return F.when(s.rlike(CLOCK), F.regexp_replace(s, CLOCK, "$1 $2").try_cast("timestamp_ntz"))
    one_space = F.regexp_replace(s, r"\s+", " ")
    if fmt == "%d %b %Y":
        return F.when(s.rlike(r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$"), F.try_to_date(one_space, "d MMM yyyy"))
    if fmt == "%b %d, %Y":
        return F.when(s.rlike(r"^[A-Za-z]{3}\s+\d{1,2},\s+\d{4}$"), F.try_to_date(one_space, "MMM d, yyyy"))
    raise ValueError(f"unknown date format {fmt!r}")


def iso_text(s: Column, formats: list[str]) -> Column:
    """ISO text of a stripped cell; text in no known format is kept.  ``s`` is
    looked at many times: pass a column, not a computation."""
    return F.coalesce(*[_parsed(s, f).cast("string") for f in formats], s)


def zone_date(c: Column) -> Column:
    """ISO text of a date in one of the zone formats; other text is kept."""
    return F.when(strip(c) == "", c).otherwise(iso_text(strip(c), ZONE_FORMATS))


def any_file_date(c: Column) -> Column:
    return F.when(strip(c) == "", c).otherwise(iso_text(strip(c), ANY_FILE_FORMATS))


def tagged_date(s: Column) -> Column:
    """'stamp|format' of a stripped cell in the first format that matches, NULL
    if none does.  One text, so that coalesce stops at the first match and each
    format is parsed once."""
    return F.coalesce(*[F.concat(_parsed(s, f).cast("string"), F.lit("|" + f)) for f in PROFILE_FORMATS])


def tagged_day(tagged: Column) -> Column:
    return F.left(tagged, F.lit(10))


def tagged_stamp(tagged: Column) -> Column:
    return F.rpad(F.substring_index(tagged, "|", 1), 19, " 00:00:00")


def tagged_format(tagged: Column) -> Column:
    return F.substring_index(tagged, "|", -1)


def iso_day(c: Column) -> Column:
    """Date of the first ten characters, which must be YYYY-MM-DD."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def looks_like_date(c: Column) -> Column:
    """First ten characters parse as ISO or day/month/year."""
    head = F.substring(strip(c), 1, 10)
    return reduce(
        lambda a, b: a | b, [_parsed(head, f).isNotNull() for f in ("%Y-%m-%d", "%d/%m/%Y")]
    )
