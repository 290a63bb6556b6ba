"""Text expressions: stripping, the three kinds of missing, case, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace when a cell is
# stripped.  A character set lets Spark trim in one pass; a regex would not.
WHITESPACE = "".join(map(chr, [
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

# Texts that stand for a missing value, compared in lower case.
BLANK_TOKENS = ["nan", "null", "none", "n/a", "na", "-"]

# The shapes of an e-mail address, a phone number, a plain number.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[\+\-\(\)\s\d]{7,}$"
PLAIN_NUMBER_PATTERN = r"^-?\d+(\.\d+)?$"

CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_empty(c: Column) -> Column:
    """NULL, or nothing left after stripping (the zone tables' rule)."""
    return c.isNull() | (strip(c) == "")


def is_blank(c: Column) -> Column:
    """Empty, or a text that stands for a missing value (profile and cleaner)."""
    return F.coalesce(F.lower(strip(c)).isin("", *BLANK_TOKENS), F.lit(True))


def is_void(c: Column) -> Column:
    """NULL or exactly '' (quality scores)."""
    return c.isNull() | (c == "")


def strip_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def title(c: Column) -> Column:
    """Capitalise after every character that has no case: O'Brien, Foo_Bar, 3Rd."""
    parts = F.split(F.lower(c), f"(?<!{CASED})(?={CASED})")
    capital = lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 2**31 - 1))
    return F.array_join(F.transform(parts, capital), "")


def is_email(c: Column) -> Column:
    return strip(c).rlike(EMAIL_PATTERN)


def is_phone(c: Column) -> Column:
    s = strip(c)
    return s.rlike(PHONE_PATTERN) & ~F.translate(s, " -", "").rlike(PLAIN_NUMBER_PATTERN)


KEY_LENGTH = 64


def compact_key(c: Column) -> Column:
    """Stand-in for a long value in a grouping key: texts over 64 characters are
    replaced by their length and SHA-256, so that counting distinct documents
    shuffles digests and not documents.  ``c`` is looked at several times: pass
    a column, not a computation."""
    return F.when(F.length(c) <= KEY_LENGTH, c).otherwise(
        F.concat(F.lit("\u0000"), F.length(c).cast("string"), F.lit(":"), F.sha2(c, 256)))


def row_digest(cells: list[Column]) -> Column:
    """SHA-256 of a row of texts without NULLs.  The lengths come first, so two
    different rows never join to the same text."""
    lengths = F.concat_ws(",", *[F.length(c).cast("string") for c in cells])
    return F.sha2(F.concat(lengths, F.lit(":"), *cells), 256)


def quoted(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_prefix(names: list[str], base: str = "_") -> str:
    """``base``, with underscores added until no name begins so: helper columns
    named with it stand beside any columns."""
    while any(n.lower().startswith(base.lower()) for n in names):
        base += "_"
    return base
