"""Building blocks of the comparison SQL, written from the rules and not from
the Spark expressions."""

from __future__ import annotations

# Texts that stand for a missing value, the shapes of addresses and numbers,
# the shapes of dates, and the lists of formats in the order they are tried.
BLANKS = "('', 'nan', 'null', 'none', 'n/a', 'na', '-')"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
PHONE = r"^[\+\-\(\)\s\d]{7,}$"
PLAIN = r"^-?\d+(\.\d+)?$"
NUMBER = r"^[+-]?(\d+|\d*\.\d*([eE][+-]?\d+)?)$"
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INT = r"^[+-]?\d+$"

SHAPES = {
    "%Y-%m-%d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "%Y/%m/%d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "%d/%m/%Y": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "%m/%d/%Y": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "%d-%m-%Y": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "%d.%m.%Y": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "%m.%d.%Y": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "%Y-%m-%d %H:%M:%S": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "%d %b %Y": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "%b %d, %Y": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
}
ZONE = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y"]
ANY = ZONE + ["%Y/%m/%d", "%d.%m.%Y", "%m.%d.%Y"]
PROFILE = ["%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y-%m-%d %H:%M:%S", "%d %b %Y",
           "%b %d, %Y"]


def blank(v):
    return f"({v} IS NULL OR lower(trim({v})) IN {BLANKS})"


def empty(v):
    return f"({v} IS NULL OR trim({v}) = '')"


def number(v):
    t = f"trim(replace({v}, ',', ''))"
    return f"(CASE WHEN regexp_matches({t}, '{NUMBER}') THEN try_cast({t} AS DOUBLE) END)"


def real(v):
    t = f"trim({v})"
    return f"(CASE WHEN regexp_matches({t}, '{FLOAT}') THEN try_cast({t} AS DOUBLE) END)"


def strptime(v, f):
    return f"(CASE WHEN regexp_matches(trim({v}), '{SHAPES[f]}') THEN try_strptime(trim({v}), '{f}') END)"


def date_iso(v, formats):
    tries = ", ".join(f"strftime({strptime(v, f)}, '%Y-%m-%d')" for f in formats)
    return f"(CASE WHEN {empty(v)} THEN {v} ELSE coalesce({tries}, trim({v})) END)"


def date_stamp(v):
    return "coalesce(" + ", ".join(strptime(v, f) for f in PROFILE) + ")"


def date_format(v):
    return "(CASE " + " ".join(f"WHEN {strptime(v, f)} IS NOT NULL THEN '{f}'" for f in PROFILE) + " END)"


def title(v):
    """Character by character: upper case unless the one before is a letter."""
    s = f"lower({v})"
    return (
        f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i > 1 AND "
        f"regexp_matches(substr({s}, i - 1, 1), '[a-z]') THEN substr({s}, i, 1) ELSE upper(substr({s}, i, 1)) END), '')"
    )


def pct(n, total, digits, scale=100):
    """scale * n / total, half up, in whole numbers."""
    u = 10**digits
    return (f"(CASE WHEN {total} > 0 THEN CAST((CAST({n} AS BIGINT) * {2 * scale * u} + CAST({total} AS BIGINT)) // "
            f"(2 * CAST({total} AS BIGINT)) AS DOUBLE) / {u}.0 ELSE 0.0 END)")


def text_key(cols, lower=False):
    """Whole-row key as a list, which compares element by element."""
    one = (lambda c: f"lower(trim({c}))") if lower else (lambda c: f"trim({c})")
    return "[" + ", ".join(one(f'"{c}"') for c in cols) + "]"


def quote(s):
    return "'" + s.replace("'", "''") + "'"


def sensitivity(v, keywords):
    parts = [f"WHEN regexp_matches(lower({v}), '{'|'.join(words)}') THEN '{label}'" for label, words in keywords.items()]
    return "(CASE " + " ".join(parts) + " ELSE 'Internal' END)"
