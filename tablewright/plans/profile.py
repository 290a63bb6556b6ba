"""Column and table profile: types, issues, suggested actions, health."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, naming, numbers, text
from ..operators import histogram, packed
from ..operators.cells import first_values, head_and_total, head_rows, long_cells
from ..operators.ranks import Stats, statistics
from ..session import stage

# How many leading values decide the type, the date format, and
# the count of mixed formats; shares above which a type is assigned.
TYPE_SAMPLE, FORMAT_SAMPLE, MIXED_SAMPLE = 200, 50, 500
DATE_SHARE, EMAIL_SHARE, NUMBER_SHARE, PHONE_SHARE = 0.7, 0.7, 0.85, 0.7
CATEGORY_LIMIT = 20

# Severity of each issue ('missing' depends on its share).
SEVERITY = {"whitespace": "low", "case": "medium", "format": "high", "invalid_email": "high", "outliers": "medium",
            "negative": "medium"}
ISSUES = ["missing", *SEVERITY]

# Fixed values: (issue, column type or None for any, action, label, default),
# in the order they are offered.
ACTIONS = [
    ("missing", "number", "fill_missing_mean", "Fill with column mean", 0),
    ("missing", "number", "fill_missing_median", "Fill with column median", 0),
    ("missing", "number", "fill_missing_zero", "Fill with zero", 0),
    ("missing", "categorical", "fill_missing_mode", "Fill with most common value", 0),
    ("missing", "categorical", "fill_missing_unknown", "Fill with 'Unknown'", 0),
    ("missing", "date", "fill_missing_today", "Fill with today's date", 0),
    ("missing", "text", "fill_missing_unknown", "Fill with 'Unknown'", 0),
    ("missing", "email", "fill_missing_unknown", "Fill with 'Unknown'", 0),
    ("missing", "phone", "fill_missing_unknown", "Fill with 'Unknown'", 0),
    ("missing", None, "drop_rows_missing", "Drop rows where this is missing", 0),
    ("missing", None, "keep_missing", "Keep as null (no change)", 0),
    ("whitespace", None, "trim_whitespace", "Trim leading/trailing spaces", 1),
    ("case", None, "standardize_lower", "Convert to lowercase", 0),
    ("case", None, "standardize_upper", "Convert to UPPERCASE", 0),
    ("case", None, "standardize_title", "Convert to Title Case", 0),
    ("format", None, "standardize_date_iso", "Standardise all dates to YYYY-MM-DD", 1),
    ("invalid_email", None, "drop_rows_invalid_email", "Drop rows with invalid emails", 0),
    ("invalid_email", None, "null_invalid_email", "Set invalid emails to null", 0),
    ("outliers", None, "cap_outliers", "Cap outliers at 1.5×IQR boundaries", 0),
    ("outliers", None, "drop_outliers", "Drop rows with outliers", 0),
    ("outliers", None, "keep_outliers", "Keep outliers as-is", 0),
    ("negative", None, "abs_values", "Take absolute value", 0),
    ("negative", None, "drop_rows_negative", "Drop rows with negative values", 0),
    ("negative", None, "null_negative", "Set negative values to null", 0),
]

CASE_TYPES = ("text", "categorical", "email")


# --- lazy parts, one row per column ------------------------------------------


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """position, column_name, total_rows, null_count, null_pct, completeness,
    unique_count, whitespace_count: one pass that ships packed hashes."""
    held = packed.pack(df, cols, df.count())
    facts = packed.sums(held, packed.counted(held, dict.fromkeys(range(len(cols)), 2)))
    rows = [(i, cols[i], f["total"], f["blank"], f["distinct"], f["padded"]) for i, f in sorted(facts.items()) if f["total"]]
    return _shares(df.sparkSession.createDataFrame(rows, COUNTS))


COUNTS = "position int, column_name string, total_rows bigint, null_count bigint, unique_count bigint, whitespace_count bigint"


def _shares(counts: DataFrame) -> DataFrame:
    n, total = F.col("null_count"), F.col("total_rows")
    return counts.select(
        "position", "column_name", "total_rows", "null_count", numbers.ratio(n, total, 2).alias("null_pct"),
        numbers.ratio(total - n, total, 1).alias("completeness"), "unique_count", "whitespace_count")


def _looks(leading: DataFrame) -> dict[str, dict]:
    """What the first filled cells (column_name, rank, value) of each column look like:
    shares by kind, and of the date formats the usual one of the first fifty."""
    cells = leading.select("column_name", "rank", text.strip(F.col("value")).alias("s"))
    s, rank = F.col("s"), F.col("rank")
    cells = cells.select(
        "column_name", "rank", dates.tagged_format(dates.tagged_date(s)).alias("date_format"),
        text.is_email(s).alias("is_email"), numbers.number(s).isNotNull().alias("is_number"), text.is_phone(s).alias("is_phone"))
    early = rank <= TYPE_SAMPLE
    seen = cells.groupBy("column_name", "date_format").agg(
        F.count("*").alias("n"), F.count_if(early).alias("early"), F.count_if(early & F.col("is_email")).alias("emails"),
        F.count_if(early & F.col("is_number")).alias("numbers"), F.count_if(early & F.col("is_phone")).alias("phones"),
        F.count_if(rank <= FORMAT_SAMPLE).alias("usual"), F.min("rank").alias("first"))
    by_column: dict[str, list] = {}
    for r in seen.collect():
        by_column.setdefault(r["column_name"], []).append(r)
    out = {}
    for c, rs in by_column.items():
        share = lambda name, rows=rs: sum(r[name] for r in rows) / sum(r["early"] for r in rs)
        dated = [r for r in rs if r["date_format"] is not None]
        usual = min((r for r in dated if r["usual"]), key=lambda r: (-r["usual"], r["first"]), default=None)
        out[c] = {"n": sum(r["n"] for r in rs), "dates": share("early", dated), "emails": share("emails"), "numbers": share("numbers"),
                  "phones": share("phones"), "format": usual and usual["date_format"],
                  "others": sum(r["n"] for r in dated) - (usual["n"] if usual else 0)}
    return out


def leading_looks(df: DataFrame, cols: list[str], seq: str) -> tuple[dict[str, dict], int]:
    """What the leading cells of each column look like, and how many rows there are.
    The leading rows answer for all columns but sparse ones, which share one more pass."""
    k = MIXED_SAMPLE
    rows = df.select(text.quoted(seq).alias("seq"), *[text.quoted(c) for c in cols])
    head, total = head_and_total(rows, "seq", 4 * k)
    order = Window.partitionBy("column_name").orderBy("seq")
    cells = long_cells(head, cols, "seq", histogram.filled).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    looks = _looks(cells)
    sparse = [c for c in cols if total > 4 * k and (c not in looks or looks[c]["n"] < k)]
    if sparse:
        looks |= _looks(first_values(rows, sparse, "seq", k, histogram.filled))
    return looks, total


def kind_of(looks: dict | None, unique: int | None = None) -> str | None:
    """Type of a column; None if it takes the number of its values to tell."""
    if looks:
        for name, share, least in (("date", "dates", DATE_SHARE), ("email", "emails", EMAIL_SHARE),
                                   ("number", "numbers", NUMBER_SHARE), ("phone", "phones", PHONE_SHARE)):
            if looks[share] > least:
                return name
    return None if unique is None else "categorical" if 2 <= unique <= CATEGORY_LIMIT else "text"


def _formats(kind: str, looks: dict | None) -> tuple[str | None, int]:
    """Usual date format of a date column, and cells in other formats."""
    return (looks["format"], looks["others"]) if kind == "date" and looks["format"] else (None, 0)


def types(df: DataFrame, cols: list[str], seq: str) -> DataFrame:
    """position, column_name, inferred_type, date_format, format_issues.  Only columns whose
    leading cells don't tell are counted, and those only up to the limit that matters."""
    looks, total = leading_looks(df, cols, seq)
    open_ = [c for c in cols if kind_of(looks.get(c)) is None]
    unique: dict[str, int] = {}
    if open_:
        held = packed.pack(df, open_, total, most=CATEGORY_LIMIT + 1)
        facts = packed.sums(held, packed.counted(held, dict.fromkeys(range(len(open_)), 2)))
        unique = {c: facts[i]["distinct"] if i in facts else 0 for i, c in enumerate(open_)}
    kinds = {c: kind_of(looks.get(c), unique.get(c, 0)) for c in cols}
    rows = [(i, c, kinds[c], *_formats(kinds[c], looks.get(c))) for i, c in enumerate(cols)] if total else []
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, inferred_type string, date_format string, format_issues bigint")


def primary_key(profile: DataFrame, words: list[str] = naming.KEY_WORDS) -> DataFrame:
    """primary_key: of the columns without blanks or repeats the first whose
    name says so, else the first.  No row if there is none."""
    unique = profile.filter((F.col("null_count") == 0) & (F.col("unique_count") == F.col("total_rows")))
    return first_by_name(unique, words)


def first_by_name(columns: DataFrame, words: list[str]) -> DataFrame:
    says_so = F.lower("column_name").rlike("|".join(words))
    return columns.orderBy(says_so.desc(), "position").limit(1).select(F.col("column_name").alias("primary_key"))


# --- the report --------------------------------------------------------------


@dataclass
class Column:
    """Profile of one column."""

    name: str
    position: int
    inferred_type: str
    date_format: str | None
    total_rows: int
    null_count: int
    null_pct: float
    completeness: float
    unique_count: int
    whitespace_count: int
    case_issues: int = 0
    format_issues: int = 0
    email_invalid: int = 0
    outlier_count: int = 0
    negative_count: int = 0
    samples: list[str] = field(default_factory=list)

    @property
    def sensitivity(self) -> str:
        return naming.sensitivity(self.name)

    @property
    def is_pii(self) -> bool:
        return self.sensitivity == "PII"

    @property
    def issues(self) -> list[dict]:
        counts = {
            "missing": self.null_count, "whitespace": self.whitespace_count, "case": self.case_issues,
            "format": self.format_issues, "invalid_email": self.email_invalid, "outliers": self.outlier_count,
            "negative": self.negative_count if naming.has_word(self.name, naming.POSITIVE_WORDS) else 0,
        }
        missing = "high" if self.null_pct > 30 else "medium" if self.null_pct > 5 else "low"
        messages = {
            "missing": f"{self.null_count} missing values ({self.null_pct}%)",
            "whitespace": f"{self.whitespace_count} values have extra whitespace",
            "case": f"{self.case_issues} values differ only by capitalisation",
            "format": f"{self.format_issues} dates in mixed formats (expected {self.date_format})",
            "invalid_email": f"{self.email_invalid} invalid email addresses",
            "outliers": f"{self.outlier_count} numeric outliers detected (IQR rule)",
            "negative": f"{self.negative_count} negative values in a column that should be positive",
        }
        return [
            {"type": i, "severity": SEVERITY.get(i, missing), "count": counts[i], "message": messages[i]}
            for i in ISSUES if counts[i] > 0
        ]

    @property
    def suggestions(self) -> list[dict]:
        found = [i["type"] for i in self.issues]
        return [
            {"action": action, "label": label, "default": bool(default)}
            for issue, kind, action, label, default in ACTIONS
            if issue in found and kind in (None, self.inferred_type)
        ]


@dataclass
class Report:
    """Profile of a table: one entry per column and the table's totals."""

    columns: list[Column]
    total_rows: int
    full_duplicates: int
    near_duplicates: int

    @property
    def primary_key(self) -> str | None:
        unique = [c.name for c in self.columns if c.null_count == 0 and c.unique_count == self.total_rows]
        return next((n for n in unique if naming.has_word(n, naming.KEY_WORDS)), unique[0] if unique else None)

    @property
    def global_rules(self) -> list[dict]:
        rules = []
        if self.full_duplicates:
            rules.append({"rule": "remove_full_duplicates", "label": f"Remove {self.full_duplicates} fully duplicate rows",
                          "default": True, "param": None})
        if self.near_duplicates:
            rules.append({"rule": "remove_near_duplicates",
                          "label": f"Remove {self.near_duplicates} near-duplicate rows (differ only by case/whitespace)",
                          "default": False, "param": None})
        if self.primary_key:
            rules.append({"rule": "dedupe_by_pk", "label": f"Deduplicate by '{self.primary_key}' (keep first occurrence)",
                          "default": True, "param": self.primary_key})
        return rules

    @property
    def stats(self) -> dict:
        n = max(len(self.columns), 1)
        issues = sum(len(c.issues) for c in self.columns)
        affected = sum(1 for c in self.columns if c.issues)
        # Exact tenths, rounded half up.
        complete = Fraction(sum(round(c.completeness * 10) for c in self.columns), 10 * n)
        score = max(Fraction(0), 100 - Fraction(issues * 8, n))
        labels: dict[str, int] = {}
        for c in self.columns:
            labels[c.sensitivity] = labels.get(c.sensitivity, 0) + 1
        return {
            "total_issues": issues, "affected_cols": affected, "clean_cols": len(self.columns) - affected,
            "avg_completeness": _tenths(complete), "health_score": _tenths(complete * 6 / 10 + score * 4 / 10),
            "pii_columns": sum(c.is_pii for c in self.columns), "sensitivity_breakdown": labels,
        }

    def default_rules(self) -> dict:
        """Per column the first suggestion marked default, else the first."""
        columns = {}
        for c in self.columns:
            if c.suggestions:
                pick = next((s for s in c.suggestions if s["default"]), c.suggestions[0])
                columns[c.name] = {"action": pick["action"]}
        return {"global": {"remove_full_duplicates": True, "dedupe_by_pk": True}, "columns": columns}

    # Tables of the report: rows number at most columns x issues x actions.

    def columns_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.position, c.name, c.inferred_type, c.date_format, c.null_count, c.null_pct, c.unique_count,
                 c.completeness, c.sensitivity, int(c.is_pii), c.whitespace_count, c.case_issues, c.format_issues,
                 c.email_invalid, c.outlier_count, c.negative_count, len(c.issues), c.samples) for c in self.columns]
        return spark.createDataFrame(rows, (
            "position int, column_name string, inferred_type string, date_format string, null_count bigint, "
            "null_pct double, unique_count bigint, completeness double, sensitivity string, is_pii int, "
            "whitespace_count bigint, case_issues bigint, format_issues bigint, email_invalid bigint, "
            "outlier_count bigint, negative_count bigint, issue_count bigint, samples array<string>"))

    def issues_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, i["type"], i["severity"], i["count"], i["message"]) for c in self.columns for i in c.issues]
        return spark.createDataFrame(
            rows, "column_name string, issue string, severity string, count bigint, message string")

    def suggestions_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, p, s["action"], s["label"], int(s["default"]))
                for c in self.columns for p, s in enumerate(c.suggestions)]
        return spark.createDataFrame(
            rows, "column_name string, position int, action string, label string, is_default int")

    def rules_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r["rule"], r["label"], int(r["default"]), r["param"]) for r in self.global_rules]
        return spark.createDataFrame(rows, "rule string, label string, is_default int, param string")

    def stats_table(self, spark: SparkSession) -> DataFrame:
        s = self.stats
        labels = [s["sensitivity_breakdown"].get(k, 0) for k in ("PII", "Financial", "Public", "Internal")]
        row = (self.total_rows, len(self.columns), s["total_issues"], s["affected_cols"], s["clean_cols"],
               s["avg_completeness"], s["health_score"], s["pii_columns"], *labels)
        return spark.createDataFrame([row], (
            "total_rows bigint, total_cols bigint, total_issues bigint, affected_cols bigint, clean_cols bigint, "
            "avg_completeness double, health_score double, pii_columns bigint, sens_pii bigint, "
            "sens_financial bigint, sens_public bigint, sens_internal bigint"))


def _tenths(x: Fraction) -> float:
    return float((x * 20 + 1) // 2) / 10


def number_issues(values: DataFrame, stats: dict[str, Stats]) -> DataFrame:
    """column_name, outlier_count, negative_count from values(name, x, n); the
    bands are literals."""
    x, n = F.col("x"), F.col("n")
    outside = F.coalesce(*[
        F.when(F.col("name") == c, (x < s.band[0]) | (x > s.band[1])) for c, s in stats.items() if s.band], F.lit(False))
    some = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return values.groupBy(F.col("name").alias("column_name")).agg(
        some(outside).alias("outlier_count"), some(x < 0).alias("negative_count"))


def near_duplicates(df: DataFrame, cols: list[str], seq: str, mixed: DataFrame) -> int:
    """Rows that equal an earlier one but for case and outer whitespace and are not spelled
    like the first of them; ``mixed``: hashes (r2) of the folded rows that are spelled in
    several ways.  Only those rows are shuffled, as hashes."""
    rows = df.select(text.quoted(seq).alias("seq"), packed.row_hashes(cols).alias("h")).select("seq", "h.*")
    spelled = rows.join(mixed, "r2", "left_semi").groupBy("r2", "r3", "r0", "r1").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    groups = spelled.groupBy("r2", "r3").agg((F.sum("n") - F.min_by("n", "first")).alias("odd"))
    return groups.agg(F.coalesce(F.sum("odd"), F.lit(0))).first()[0]


def analyze(df: DataFrame, cols: list[str], seq: str, samples: int = 5) -> Report:
    """Profile a table of text columns.

    The leading rows tell types and formats.  One pass over the table then packs hashes of
    cells and rows, the numbers of number columns and the samples; what is counted, unique,
    spelled differently, duplicate or an outlier follows from that.  Further passes, one each,
    are made for the leading cells of sparse columns and for rows that are spelled in several
    ways, where there are such.  The number of jobs does not grow
    with the columns, and one summary row per column comes back to the driver.

    ``df`` is read by each pass and must be the same every time: pass a stored table if it
    is expensive to compute.
    """
    spark = df.sparkSession
    df = df.select(text.quoted(seq), *[text.quoted(c) for c in cols])
    looks, total = leading_looks(df, cols, seq)
    if not total or not cols:
        raise ValueError("The table is empty or has no columns.")
    told = {c: kind_of(looks.get(c)) for c in cols}
    of_type = lambda *ts: [c for c in cols if told[c] in ts]
    cased = of_type(None, *CASE_TYPES)
    held = packed.pack(df, cols, total, cased, of_type("email"), of_type("number"), rows=True, least=samples)
    widths = {i: 4 if c in cased else 2 for i, c in enumerate(cols)} | {packed.ROWS: 4}
    facts = packed.sums(held, packed.counted(held, widths))
    nothing = dict.fromkeys(("total", "blank", "padded", "invalid", "distinct", "odd", "mixed"), 0)
    facts = {i: facts.get(i, nothing) for i in widths}
    numeric: dict[str, dict] = {}
    if of_type("number"):
        values = stage(packed.number_values(held, cols), "numbers")
        stats = statistics(values, median=False)
        numeric = {r["column_name"]: r.asDict() for r in number_issues(values, stats).collect()}
    picked = packed.least_values(held, samples) if samples else {}
    rows, near = facts[packed.ROWS], 0
    if rows["mixed"]:
        of_rows = packed.counted(held.filter(F.col("col") == packed.ROWS), widths)
        near = near_duplicates(df, cols, seq, of_rows.select(F.explode("mixed").alias("r2")))
    out = []
    for i, c in enumerate(cols):
        f = facts[i]
        kind = kind_of(looks.get(c), f["distinct"])
        date_format, format_issues = _formats(kind, looks.get(c))
        out.append(Column(
            name=c, position=i, inferred_type=kind, date_format=date_format,
            total_rows=f["total"], null_count=f["blank"], null_pct=numbers.share(f["blank"], total, 2),
            completeness=numbers.share(total - f["blank"], total, 1), unique_count=f["distinct"], whitespace_count=f["padded"],
            case_issues=f["odd"] if kind in CASE_TYPES else 0, format_issues=format_issues, email_invalid=f["invalid"],
            outlier_count=numeric.get(c, {}).get("outlier_count", 0),
            negative_count=numeric.get(c, {}).get("negative_count", 0), samples=picked.get(i, []),
        ))
    return Report(out, total, total - rows["distinct"], near)


def preview(df: DataFrame, seq: str, k: int = 5) -> DataFrame:
    return head_rows(df, seq, k)
