"""Curation of a table of any shape: detected key, types, dates, sensitivity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, derive, naming, numbers, text
from ..operators import histogram, packed
from ..operators.cells import by_name, date_columns, long_cells, measure, storage_types
from ..operators.dedupe import keep_first
from .profile import first_by_name

# A distribution is shown for 2 to 30 values, the 15 commonest.
FEWEST_VALUES, MOST_VALUES, SHOWN_VALUES = 2, 30, 15


def _given(value):
    return ~text.is_void(value)


def primary_key(df: DataFrame, cols: list[str]) -> DataFrame:
    """primary_key: the first column without repeats among its given values,
    unstripped, whose name says so; else the first such column."""
    counts = histogram.distinct_counts(df, cols, keep=_given, raw=True).filter(F.col("filled") == F.col("distinct"))
    placed = counts.withColumn("position", by_name(F.col("column_name"), {c: i for i, c in enumerate(cols)}))
    return first_by_name(placed, naming.ANY_FILE_KEY_WORDS)


@dataclass(frozen=True)
class Shape:
    """What was detected about a table's columns."""

    cols: list[str]
    key: str | None
    date_cols: list[str]
    storage: dict[str, str]

    def label(self, col: str) -> str:
        return naming.sensitivity(col, naming.ANY_FILE_KEYWORDS)


def detect(df: DataFrame, cols: list[str], seq: str, key: str | None = None) -> Shape:
    """Types and dates from the leading rows, the key from all rows unless one is given: a
    key that repeats is never detected, but who knows a table's key can have its repeats removed."""
    if key is None:
        found = primary_key(df, cols).first()
        key = found["primary_key"] if found else None
    dated = {r["column_name"] for r in date_columns(df, cols, seq).filter("is_date = 1").collect()}
    kinds = {r["column_name"]: r["storage_type"] for r in storage_types(df, cols, seq).collect()}
    return Shape(cols, key, [c for c in cols if c in dated], kinds)


def _standardized(df: DataFrame, shape: Shape, seq: str) -> DataFrame:
    # Two projections: each cell is stripped once, then looked at many times.
    stripped = df.select(seq, *[text.strip(text.quoted(c)).alias(c) for c in shape.cols])

    def cell(c):
        value = text.quoted(c)
        value = dates.iso_text(value, dates.ANY_FILE_FORMATS) if c in shape.date_cols else value
        return F.when(text.quoted(c) != "", value)

    return stripped.select(seq, *[cell(c).alias(c) for c in shape.cols])


def _key(shape: Shape):
    # Keys are compared as stripped, before dates are rewritten.
    return text.strip_to_null(text.quoted(shape.key))


def cleanse(df: DataFrame, shape: Shape, seq: str, run_time: str) -> DataFrame:
    """Stripped, ISO dates, no null key, first row per key if there is one."""
    rows = df
    if shape.key:
        rows = keep_first(df.filter(_key(shape).isNotNull()), [_key(shape)], seq)
    rows = _standardized(rows, shape, seq)
    flag = derive.quality_flag([text.quoted(c).isNull() for c in shape.cols])
    return rows.withColumns({
        "_cleansed_at": F.lit(run_time).cast("timestamp"), "_is_duplicate": F.lit(0), "_quality_flag": flag})


def cleanse_report(df: DataFrame, shape: Shape, seq: str) -> DataFrame:
    """One row: raw_rows, curated_rows, dupes_removed (null keys included),
    poor_quality_rows."""
    poor = derive.quality_flag([text.quoted(c).isNull() for c in shape.cols]) == "POOR"
    rows = _standardized(df, shape, seq).select(F.col(seq).alias("seq"), *[text.quoted(c) for c in shape.cols],
                                                poor.cast("int").alias("_poor"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    if not shape.key:
        return rows.agg(F.count("*").alias("raw_rows"), F.count("*").alias("curated_rows"),
                        F.lit(0).cast("bigint").alias("dupes_removed"), total("_poor").alias("poor_quality_rows"))
    keys = rows.groupBy(text.quoted(shape.key).alias("key")).agg(
        F.count("*").alias("n"), F.min_by("_poor", "seq").alias("poor"))
    return keys.agg(
        total("n").alias("raw_rows"), F.count("key").alias("curated_rows"),
        (total("n") - F.count("key")).alias("dupes_removed"),
        total(F.when(F.col("key").isNotNull(), F.col("poor"))).alias("poor_quality_rows"))


def completeness(curated: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, completeness of the curated rows."""
    counts = measure(curated, cols, {"nulls": lambda c: F.count_if(c.isNull())}, {"total": F.count("*")})
    full = F.when(F.col("total") > 0, numbers.ratio(F.col("total") - F.col("nulls"), F.col("total"), 1)).otherwise(100.0)
    return counts.select("column_name", full.alias("completeness"))


def value_distribution(curated: DataFrame, shape: Shape, seq: str) -> DataFrame:
    """column_name, value, n: commonest values of the first Public or Internal
    column, dates aside, that has a handful of values; first seen among equals.

    Which column that is, is settled first, by at most one value more than a handful of each column
    a task; only the values of that one are counted."""
    cols = [c for c in shape.cols if shape.label(c) in ("Public", "Internal") and c not in shape.date_cols]
    few = packed.few_values(curated, cols, MOST_VALUES, _given) if cols else {}
    chosen = next((c for c in cols if FEWEST_VALUES <= few.get(c, 0) <= MOST_VALUES), None)
    if chosen is None:
        return curated.sparkSession.createDataFrame([], "column_name string, value string, n bigint")
    counts = long_cells(curated, [chosen], seq, keep=_given).groupBy("column_name", "value").agg(
        F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.orderBy(F.col("n").desc(), "first").limit(SHOWN_VALUES).select("column_name", "value", "n")


def classify(shape: Shape, spark) -> DataFrame:
    """column_name, sensitivity_label, is_pii, inferred_type, is_date."""
    rows = [(c, shape.label(c), int(shape.label(c) == "PII"), shape.storage[c], int(c in shape.date_cols))
            for c in shape.cols]
    return spark.createDataFrame(
        rows, "column_name string, sensitivity_label string, is_pii int, inferred_type string, is_date int")


def catalog_entries(shape: Shape, table_name: str, spark) -> DataFrame:
    """Governance catalog rows of the table."""
    described = F.concat("inferred_type", F.lit(" column"), F.when(F.col("is_date") == 1, " · date").otherwise(""))
    return classify(shape, spark).select(
        F.lit(table_name).alias("table_name"), "column_name", "sensitivity_label", "is_pii",
        F.lit("Auto-detected").alias("owner"), described.alias("description"))
