"""Raw -> curated -> consumption: lazy plans over the six zone tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.tables import ZONE_TABLES, ZoneTable
from ..functions import dates, derive, naming, numbers, text
from ..operators.dedupe import keep_first

Day = datetime.date | str


def row_hash(cols: list[str], empty_as_none: bool = False) -> Column:
    """SHA-256 of the cells joined by '|', before any trimming.  A missing cell
    is hashed as the text None; with ``empty_as_none`` an empty one is too."""
    cells = [text.quoted(c) for c in cols]
    if empty_as_none:
        cells = [F.nullif(c, F.lit("")) for c in cells]
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("None")) for c in cells]), 256)


def stamp(df: DataFrame, cols: list[str], source: Column, run_time: str, empty_as_none: bool = False) -> DataFrame:
    """Raw zone: cells as they came, with run time, source file and row hash."""
    return df.withColumns({
        "_ingested_at": F.lit(run_time).cast("timestamp"),
        "_source_file": source,
        "_row_hash": row_hash(cols, empty_as_none),
    })


def _standardized(df: DataFrame, table: ZoneTable, seq: str) -> DataFrame:
    # Two projections: each cell is stripped once, then looked at many times.
    stripped = df.select(seq, *[text.strip(text.quoted(c)).alias(c) for c in table.names])

    def cell(c):
        value = text.quoted(c)
        value = dates.iso_text(value, dates.ZONE_FORMATS) if naming.is_zone_date(c) else value
        return F.when(text.quoted(c) != "", value)

    return stripped.select(seq, *[cell(c).alias(c) for c in table.names])


def _flag(table: ZoneTable) -> Column:
    # The three stamp columns belong to the row and are never missing.
    return derive.quality_flag([text.quoted(c).isNull() for c in table.names], extra_columns=3)


def cleanse(df: DataFrame, name: str, seq: str, run_time: str) -> DataFrame:
    """Curated rows: stripped, ISO dates, no null key, first row per key."""
    table = ZONE_TABLES[name]
    # Rows are dropped before the rest of their cells is looked at.
    key = text.strip(text.quoted(table.key))
    first = _standardized(keep_first(df.filter(key != ""), [key], seq), table, seq)
    return first.withColumns({
        "_cleansed_at": F.lit(run_time).cast("timestamp"),
        "_is_duplicate": F.lit(0),
        "_quality_flag": _flag(table),
    })


def cleanse_report(df: DataFrame, name: str, seq: str) -> DataFrame:
    """One row: rows_in, rows_out, dupes_removed, poor_quality.  Rows dropped
    for a null key are not duplicates.  Only key, count and flag are shuffled."""
    table = ZONE_TABLES[name]
    poor = (_flag(table) == "POOR").cast("int").alias("poor")
    rows = _standardized(df, table, seq).select(F.col(table.key).alias("key"), F.col(seq).alias("seq"), poor)
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("poor", "seq").alias("poor"))
    zero = F.lit(0)
    keyed = F.col("key").isNotNull()
    return keys.agg(
        F.coalesce(F.sum("n"), zero).alias("rows_in"),
        F.count("key").alias("rows_out"),
        F.coalesce(F.sum(F.when(keyed, F.col("n") - 1)), zero).alias("dupes_removed"),
        F.coalesce(F.sum(F.when(keyed, F.col("poor"))), zero).alias("poor_quality"),
    ).select(F.lit(name).alias("table_name"), "*")


def with_derived(df: DataFrame, name: str, as_of: Day) -> DataFrame:
    """Add the table's derived column."""
    if name == "transaction_logs":
        return df.withColumn("amount_usd", derive.amount_usd(F.col("amount"), F.col("currency")))
    if name == "customer_profiles":
        return df.withColumn("age_group", derive.age_group(F.col("dob"), as_of))
    if name == "hr_records":
        return df.withColumn("tenure_years", derive.tenure_years(F.col("join_date"), as_of))
    if name == "sensor_telemetry":
        return df.withColumn("is_anomaly", derive.is_anomaly(F.col("temperature")))
    if name == "audit_trail":
        return df.withColumn("ip_country", derive.ip_country(F.col("ip_address")))
    return df


def typed(df: DataFrame, name: str) -> DataFrame:
    """Columns in their stored types; text that does not fit becomes NULL."""
    def cell(c, kind):
        col = text.quoted(c)
        if kind == "REAL":
            return numbers.plain_float(col)
        if kind == "INTEGER":
            whole = numbers.plain_float(col)
            return F.coalesce(numbers.plain_int(col), F.when(whole == F.floor(whole), whole.try_cast("bigint")))
        return col

    table = ZONE_TABLES[name]
    return df.withColumns({c: cell(c, k) for c, k in table.columns.items() if k != "TEXT"})


def as_text(df: DataFrame, name: str) -> DataFrame:
    """A stored curated table as the plans read it: its own columns as text."""
    table = ZONE_TABLES[name]
    return df.withColumns({c: text.quoted(c).cast("string") for c, k in table.columns.items() if k != "TEXT"})


# --- consumption zone ------------------------------------------------------


def active_customers(customers: DataFrame, txns: DataFrame, days: int = 90) -> DataFrame:
    """Customers with a transaction in the ``days`` before the latest one.

    Transactions are reduced to one row per customer before the join, so a
    customer with a third of all transactions joins as a single row.
    """
    latest = txns.agg(F.substring(F.max("txn_date"), 1, 10).try_cast("date").alias("d"))
    cutoff = latest.select(F.date_sub("d", days).cast("string"))
    recent = txns.filter(F.col("txn_date") >= cutoff.scalar()).groupBy("customer_id").agg(
        F.max("txn_date").alias("last"), F.count("txn_id").alias("n"))
    keep = F.coalesce(F.col("_quality_flag") != "POOR", F.lit(True))
    groups = ["customer_id", "full_name", "email", "account_type", "country"]
    joined = customers.filter(keep).select(groups).join(recent, "customer_id")
    return joined.groupBy(groups).agg(F.max("last").alias("last_txn_date"), F.sum("n").alias("txn_count"))


def high_value_transactions(txns: DataFrame, floor: float = 10000.0) -> DataFrame:
    """Over ``floor`` US dollars, neither failed nor cancelled; no status, no row."""
    rows = txns.filter((F.col("amount_usd") > floor) & ~F.col("status").isin("Failed", "Cancelled"))
    return rows.select("txn_id", "customer_id", numbers.plain_float(F.col("amount")).alias("amount"), "amount_usd",
                       "currency", "txn_date", "merchant", "status")


def department_headcount(staff: DataFrame) -> DataFrame:
    """Averages skip missing cells; text that is no number counts as 0."""
    mean = lambda c: numbers.round_decimal(F.avg(derive.number_or_zero(F.col(c))), 2)
    return staff.groupBy("department").agg(
        F.count("*").alias("headcount"),
        mean("salary").alias("avg_salary"),
        mean("performance_score").alias("avg_performance"),
        F.count_if(numbers.plain_float(F.col("is_active")) == 1).alias("active_count"),
    )


def low_stock_products(products: DataFrame, below: int = 50) -> DataFrame:
    rows = products.filter(derive.number_or_zero(F.col("stock_qty")) < below)
    return typed(rows, "product_catalog").select("product_id", "product_name", "category", "price", "stock_qty",
                                                 "supplier")


def sensor_alerts(sensors: DataFrame) -> DataFrame:
    rows = sensors.filter(numbers.plain_float(F.col("alert_flag")) == 1)
    return typed(rows, "sensor_telemetry").select("sensor_id", "timestamp", "location", "temperature", "humidity",
                                                  "battery_pct", "alert_flag", "is_anomaly")


def publish(curated: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The consumption tables whose curated tables are given."""
    made = {
        "cons_active_customers": (active_customers, ("customer_profiles", "transaction_logs")),
        "cons_high_value_transactions": (high_value_transactions, ("transaction_logs",)),
        "cons_department_headcount": (department_headcount, ("hr_records",)),
        "cons_low_stock_products": (low_stock_products, ("product_catalog",)),
        "cons_sensor_alerts": (sensor_alerts, ("sensor_telemetry",)),
    }
    return {name: make(*[curated[n] for n in needs]) for name, (make, needs) in made.items()
            if all(n in curated for n in needs)}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows: all counts in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


def run_summary(raw: dict[str, DataFrame], curated: dict[str, DataFrame], pii_columns: int) -> DataFrame:
    """One row: raw, curated and POOR rows over all tables, PII columns."""
    parts = [df.select(F.lit(1).alias("raw"), F.lit(0).alias("cur"), F.lit(0).alias("poor")) for df in raw.values()]
    parts += [
        df.select(F.lit(0).alias("raw"), F.lit(1).alias("cur"), (F.col("_quality_flag") == "POOR").cast("int").alias("poor"))
        for df in curated.values()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(total("raw").alias("total_raw_rows"), total("cur").alias("total_curated_rows"),
                    total("poor").alias("poor_quality_rows")).withColumn("pii_columns_tagged", F.lit(pii_columns))
