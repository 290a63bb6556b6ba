"""Column-level governance registry and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Table, column, sensitivity, personal (1) or not (0), owner,
# description.
REGISTRY = [
    ("raw_customer_profiles", "full_name", "PII", 1, "CRM Team", "Customer legal full name"),
    ("raw_customer_profiles", "email", "PII", 1, "CRM Team", "Primary email address"),
    ("raw_customer_profiles", "phone", "PII", 1, "CRM Team", "Mobile or landline number"),
    ("raw_customer_profiles", "dob", "PII", 1, "CRM Team", "Date of birth"),
    ("raw_customer_profiles", "address", "PII", 1, "CRM Team", "Residential address"),
    ("raw_customer_profiles", "customer_id", "Internal", 0, "CRM Team", "Unique customer identifier"),
    ("raw_customer_profiles", "account_type", "Internal", 0, "CRM Team", "Customer account tier"),
    ("raw_customer_profiles", "city", "Public", 0, "CRM Team", "City of residence"),
    ("raw_customer_profiles", "country", "Public", 0, "CRM Team", "Country of residence"),
    ("raw_customer_profiles", "created_at", "Internal", 0, "CRM Team", "Account creation timestamp"),
    ("raw_transaction_logs", "txn_id", "Internal", 0, "Finance Team", "Unique transaction ID"),
    ("raw_transaction_logs", "customer_id", "PII", 1, "Finance Team", "Reference to customer"),
    ("raw_transaction_logs", "amount", "Financial", 0, "Finance Team", "Transaction amount"),
    ("raw_transaction_logs", "currency", "Internal", 0, "Finance Team", "Currency code (ISO 4217)"),
    ("raw_transaction_logs", "txn_date", "Internal", 0, "Finance Team", "Date of transaction"),
    ("raw_transaction_logs", "txn_type", "Internal", 0, "Finance Team", "Type of transaction"),
    ("raw_transaction_logs", "merchant", "Public", 0, "Finance Team", "Merchant name"),
    ("raw_transaction_logs", "status", "Internal", 0, "Finance Team", "Transaction status"),
    ("raw_transaction_logs", "account_number", "Financial", 1, "Finance Team", "Bank account number"),
    ("raw_transaction_logs", "card_last4", "Financial", 1, "Finance Team", "Last 4 digits of card"),
    ("raw_hr_records", "emp_id", "Internal", 0, "HR Team", "Unique employee ID"),
    ("raw_hr_records", "full_name", "PII", 1, "HR Team", "Employee full name"),
    ("raw_hr_records", "email", "PII", 1, "HR Team", "Work email address"),
    ("raw_hr_records", "department", "Internal", 0, "HR Team", "Employee department"),
    ("raw_hr_records", "designation", "Internal", 0, "HR Team", "Job title/designation"),
    ("raw_hr_records", "salary", "Financial", 0, "HR Team", "Annual salary"),
    ("raw_hr_records", "join_date", "Internal", 0, "HR Team", "Employment start date"),
    ("raw_hr_records", "manager_id", "Internal", 0, "HR Team", "Direct manager employee ID"),
    ("raw_hr_records", "performance_score", "Internal", 0, "HR Team", "Annual performance rating (1-5)"),
    ("raw_hr_records", "is_active", "Internal", 0, "HR Team", "Active employment status flag"),
    ("raw_product_catalog", "product_id", "Public", 0, "Product Team", "Unique product identifier"),
    ("raw_product_catalog", "product_name", "Public", 0, "Product Team", "Product display name"),
    ("raw_product_catalog", "category", "Public", 0, "Product Team", "Top-level product category"),
    ("raw_product_catalog", "sub_category", "Public", 0, "Product Team", "Product sub-category"),
    ("raw_product_catalog", "price", "Public", 0, "Finance Team", "Retail price"),
    ("raw_product_catalog", "stock_qty", "Internal", 0, "Ops Team", "Current stock quantity"),
    ("raw_product_catalog", "supplier", "Internal", 0, "Ops Team", "Supplier company name"),
    ("raw_product_catalog", "last_updated", "Internal", 0, "Product Team", "Catalog last update date"),
    ("raw_sensor_telemetry", "sensor_id", "Internal", 0, "Ops Team", "Unique sensor identifier"),
    ("raw_sensor_telemetry", "timestamp", "Internal", 0, "Ops Team", "Reading timestamp"),
    ("raw_sensor_telemetry", "location", "Internal", 0, "Ops Team", "Physical sensor location zone"),
    ("raw_sensor_telemetry", "temperature", "Public", 0, "Ops Team", "Temperature reading in Celsius"),
    ("raw_sensor_telemetry", "humidity", "Public", 0, "Ops Team", "Relative humidity percentage"),
    ("raw_sensor_telemetry", "pressure", "Public", 0, "Ops Team", "Atmospheric pressure in hPa"),
    ("raw_sensor_telemetry", "battery_pct", "Internal", 0, "Ops Team", "Sensor battery percentage remaining"),
    ("raw_sensor_telemetry", "alert_flag", "Internal", 0, "Ops Team", "Alert triggered flag (0/1)"),
    ("raw_audit_trail", "audit_id", "Internal", 0, "Security Team", "Unique audit record ID"),
    ("raw_audit_trail", "user_id", "PII", 1, "Security Team", "Acting user identifier"),
    ("raw_audit_trail", "action", "Internal", 0, "Security Team", "Action performed"),
    ("raw_audit_trail", "entity", "Internal", 0, "Security Team", "Entity type affected"),
    ("raw_audit_trail", "entity_id", "Internal", 0, "Security Team", "Affected entity ID"),
    ("raw_audit_trail", "ip_address", "PII", 1, "Security Team", "Source IP address"),
    ("raw_audit_trail", "timestamp", "Internal", 0, "Security Team", "Event timestamp"),
    ("raw_audit_trail", "status", "Internal", 0, "Security Team", "Audit event outcome"),
]

CATALOG_COLUMNS = ["table_name", "column_name", "sensitivity_label", "is_pii", "owner", "description"]
CATALOG_SCHEMA = ("table_name string, column_name string, sensitivity_label string, is_pii int, owner string, "
                  "description string")


def pii_columns() -> int:
    return sum(r[3] for r in REGISTRY)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, CATALOG_SCHEMA)


def sensitivity_summary(catalog: DataFrame) -> DataFrame:
    """Columns and personal columns per label."""
    return catalog.groupBy("sensitivity_label").agg(
        F.count("*").alias("columns"), F.sum("is_pii").alias("pii_columns"))


def classified(catalog: DataFrame, run_time: str) -> DataFrame:
    return catalog.withColumn("last_classified_at", F.lit(run_time).cast("timestamp"))


def replace_tables(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalog in which every table named in ``entries`` has just those entries.
    ``entries`` holds one row per (table, column), the catalog's key."""
    named = entries.select("table_name").distinct()
    kept = catalog.join(named, "table_name", "left_anti").select(catalog.columns)
    return kept.unionByName(entries.select(catalog.columns))
