"""What the comparison SQL expects, stated here on its own: a change of a word, a
weight or a label in the library shows as a difference."""

from __future__ import annotations

# Sensitivity keywords of profiles, first label first.
PROFILE_KEYWORDS = {
    "PII": [
        "name", "email", "phone", "mobile", "address", "dob", "birth", "ssn", "passport", "gender", "age",
        "zip", "postal", "nic", "aadhar", "pan", "license", "userid", "user_id", "customerid", "customer_id",
        "first", "last", "contact"],
    "Financial": [
        "salary", "amount", "price", "revenue", "cost", "balance", "credit", "debit", "account", "card", "bank",
        "payment", "invoice", "tax", "wage", "income", "fee", "discount", "total", "subtotal"],
    "Public": [
        "category", "type", "status", "country", "city", "region", "product", "sku", "description", "title",
        "model", "brand", "color", "size", "rating", "department"],
}

# The same for tables of any shape.
ANY_FILE_KEYWORDS = {
    "PII": [
        "name", "email", "phone", "mobile", "address", "dob", "birth", "ssn", "passport", "gender", "age", "ip",
        "zip", "postal", "nic", "aadhar", "pan", "license"],
    "Financial": [
        "salary", "amount", "price", "revenue", "cost", "balance", "credit", "debit", "account", "card", "bank",
        "payment", "invoice", "tax", "wage", "income"],
    "Public": [
        "category", "type", "status", "country", "city", "region", "product", "sku", "description", "title",
        "model", "brand", "color", "size", "rating"],
}

# Words inside names of date columns.
ANY_FILE_DATE_WORDS = [
        "date", "time", "created", "updated", "at", "on", "dob", "birth", "joined", "hired", "start", "end",
        "timestamp", "ts"]

# Endings of date columns in the zone tables.
ZONE_DATE_ENDINGS = [
        "_date", "_at", "dob", "join_date", "last_updated", "timestamp"]

# Words inside names of key columns.
KEY_WORDS = [
        "id", "key", "no", "num", "code"]

# The same for tables of any shape.
ANY_FILE_KEY_WORDS = [
        "id", "key", "no", "num", "code", "ref"]

# Words inside names of columns without negative numbers.
POSITIVE_WORDS = [
        "amount", "price", "salary", "count", "qty", "quantity", "stock"]

# Weights of the scores in percent.
WEIGHTS = {"completeness": 30, "uniqueness": 20, "accuracy": 25, "consistency": 15, "timeliness": 10}

# Type each column's cells should have.
EXPECTED_TYPES = {
    "customer_profiles": {"customer_id": str, "full_name": str, "email": str, "dob": str, "account_type": str},
    "transaction_logs": {"txn_id": str, "amount": float, "currency": str, "txn_date": str, "status": str},
    "hr_records": {"emp_id": str, "salary": float, "performance_score": int, "is_active": int},
    "product_catalog": {"product_id": str, "price": float, "stock_qty": int},
    "sensor_telemetry": {"sensor_id": str, "temperature": float, "humidity": float, "pressure": float, "alert_flag": int},
    "audit_trail": {"audit_id": str, "user_id": str, "action": str, "ip_address": str, "status": str},
}

# Fixed values: (issue, column type or None for any, action, label, default).
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

# Key and columns of the zone tables.
ZONE_KEYS = {"customer_profiles": "customer_id", "transaction_logs": "txn_id", "hr_records": "emp_id",
             "product_catalog": "product_id", "sensor_telemetry": "sensor_id", "audit_trail": "audit_id"}

# Table, column, sensitivity, personal (1) or not (0), owner, description.
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
