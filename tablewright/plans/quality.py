"""Five quality dimensions of a table and their weighted total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.tables import ZONE_TABLES
from ..functions import numbers, text

DIMENSIONS = ["completeness", "uniqueness", "accuracy", "consistency", "timeliness"]

# Weights in percent.
WEIGHTS = {"completeness": 30, "uniqueness": 20, "accuracy": 25, "consistency": 15, "timeliness": 10}

# Type each column's cells should have.
EXPECTED_TYPES = {
    "customer_profiles": {"customer_id": str, "full_name": str, "email": str, "dob": str, "account_type": str},
    "transaction_logs": {"txn_id": str, "amount": float, "currency": str, "txn_date": str, "status": str},
    "hr_records": {"emp_id": str, "salary": float, "performance_score": int, "is_active": int},
    "product_catalog": {"product_id": str, "price": float, "stock_qty": int},
    "sensor_telemetry": {"sensor_id": str, "temperature": float, "humidity": float, "pressure": float,
                         "alert_flag": int},
    "audit_trail": {"audit_id": str, "user_id": str, "action": str, "ip_address": str, "status": str},
}


def _given_or(name: str, default: float) -> Column:
    """Number in a cell; a missing cell or a zero takes the default."""
    c = F.col(name)
    x = numbers.plain_float(c)
    return F.when(text.is_void(c) | (x == 0), F.lit(default)).otherwise(x)


def business_rule(table: str) -> Column | None:
    """The rule each row of a table should satisfy."""
    if table == "transaction_logs":
        return _given_or("amount", 0.0) >= 0
    if table == "sensor_telemetry":
        return _given_or("temperature", 0.0).between(-50, 100)
    if table == "hr_records":
        score = _given_or("performance_score", 3.0)
        return (score >= 1) & (score < 6)  # 1 to 5 once the fraction is cut
    return None


def fits(c: Column, kind: type) -> Column:
    """A given cell can be read as the type."""
    if kind is str:
        return ~text.is_void(c)
    pattern = numbers.FLOAT_OR_SPECIAL_PATTERN if kind is float else numbers.FLOAT_PATTERN
    return F.coalesce(text.strip(c).rlike(pattern), F.lit(False))


def timeliness(started: Column, now: Column) -> Column:
    """100 for ten minutes, then 2 points less per minute, down to 0."""
    micros = F.timestamp_diff("MICROSECOND", started, now)
    late = F.greatest(micros - 600_000_000, F.lit(0).cast("bigint"))
    # Two points a minute are one hundredth per 300 milliseconds.
    lost = numbers.int_div(late * 2 + 300_000, 600_000)
    return F.greatest(F.lit(10_000) - lost, F.lit(0)).cast("double") / 100.0


def overall(scores: dict[str, Column]) -> Column:
    """Weighted total to two places, in whole hundredths."""
    top = sum((F.round(scores[d] * 100).cast("bigint") * w for d, w in WEIGHTS.items()), F.lit(0).cast("bigint"))
    return numbers.int_div(top + 50, 100).cast("double") / 100.0


def row_facts(df: DataFrame, cols: list[str], rule: Column | None, expected: dict[str, type]) -> DataFrame:
    """Per distinct row: copies, given cells, rows that pass, cells that fit.
    Copies merge before the shuffle, which carries digests and counts."""
    # Each cell is turned to text once; missing ones read None in the digest.
    texts = df.withColumns({f"_t{i}": text.quoted(c).cast("string") for i, c in enumerate(cols)})
    places = [F.col(f"_t{i}") for i in range(len(cols))]
    given = sum(((~text.is_void(t)).cast("int") for t in places), F.lit(0))
    passing = F.lit(1) if rule is None else F.coalesce(rule, F.lit(False)).cast("int")
    fitting = sum((fits(text.quoted(c), t).cast("int") for c, t in expected.items()), F.lit(0))
    counted = texts.select(
        *[F.coalesce(t, F.lit("None")).alias(f"_t{i}") for i, t in enumerate(places)],
        given.alias("given"), passing.alias("passing"), fitting.alias("fitting"))
    rows = counted.select(text.row_digest(places).alias("row"), "given", "passing", "fitting")
    return rows.groupBy("row").agg(
        F.count("*").alias("n"), F.sum("given").alias("given"), F.sum("passing").alias("passing"),
        F.sum("fitting").alias("fitting"))


def scores(df: DataFrame, cols: list[str], rule: Column | None = None, expected: dict[str, type] | None = None,
           started: Column | None = None, now: Column | None = None, limit: int | None = None,
           seq: str | None = None) -> DataFrame:
    """One row: row_count, the five dimensions, overall.  All 0 if empty.
    ``limit`` scores only the first rows in arrival order."""
    expected = expected or {}
    if limit is not None:
        df = df.orderBy(seq).limit(limit)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = row_facts(df, cols, rule, expected).agg(
        total("n").alias("row_count"), F.count("*").alias("distinct"), total("given").alias("given"),
        total("passing").alias("passing"), total("fitting").alias("fitting"))
    n = F.col("row_count")
    some = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    fit = numbers.ratio(F.col("fitting"), n * len(expected), 2) if expected else F.lit(100.0)
    timely = F.lit(100.0) if started is None else timeliness(started, F.current_timestamp() if now is None else now)
    parts = sums.select(
        "row_count",
        numbers.ratio(F.col("given"), n * len(cols), 2).alias("completeness"),
        numbers.ratio(F.col("distinct"), n, 2).alias("uniqueness"),
        numbers.ratio(F.col("passing"), n, 2).alias("accuracy"),
        some(fit).alias("consistency"),
        some(timely).alias("timeliness"),
    )
    return parts.withColumn("overall", overall({d: F.col(d) for d in DIMENSIONS}))


def table_scores(curated: DataFrame, name: str, started: Column | None = None, now: Column | None = None) -> DataFrame:
    """Scores of a curated zone table over all its stored columns."""
    table = ZONE_TABLES[name]
    cols = table.names + ([table.derived] if table.derived else []) + ["_cleansed_at", "_is_duplicate", "_quality_flag"]
    one = scores(curated, cols, business_rule(name), EXPECTED_TYPES[name], started, now)
    return one.select(F.lit(f"curated_{name}").alias("table_name"), "*")


def with_aggregate(all_scores: DataFrame) -> DataFrame:
    """Add the row ``_aggregate``: the mean of each dimension and its overall.
    One rollup makes both, so the scores are computed once."""
    hundredths = lambda d: F.sum(F.round(F.col(d) * 100).cast("bigint"))
    mean = lambda d: (numbers.int_div(hundredths(d) * 2 + F.count("*"), F.count("*") * 2).cast("double") / 100.0).alias(d)
    rolled = all_scores.rollup("table_name").agg(F.sum("row_count").alias("row_count"), *[mean(d) for d in DIMENSIONS])
    return rolled.withColumn("overall", overall({d: F.col(d) for d in DIMENSIONS})).fillna("_aggregate", ["table_name"])
