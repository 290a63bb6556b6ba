"""The six zone tables: columns, stored types, keys, derived columns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ZoneTable:
    name: str
    key: str
    columns: dict[str, str]  # column -> TEXT, REAL or INTEGER
    derived: str | None  # column added after cleansing
    derived_type: str | None

    @property
    def names(self) -> list[str]:
        return list(self.columns)


# Tables, keys, columns with their stored types, derived columns.
ZONE_TABLES = {
    "customer_profiles": ZoneTable(
        name="customer_profiles", key="customer_id", derived="age_group", derived_type="TEXT",
        columns={
            "customer_id": "TEXT", "full_name": "TEXT", "email": "TEXT", "phone": "TEXT", "dob": "TEXT",
            "address": "TEXT", "city": "TEXT", "country": "TEXT", "account_type": "TEXT", "created_at": "TEXT"}),
    "transaction_logs": ZoneTable(
        name="transaction_logs", key="txn_id", derived="amount_usd", derived_type="REAL",
        columns={
            "txn_id": "TEXT", "customer_id": "TEXT", "amount": "REAL", "currency": "TEXT", "txn_date": "TEXT",
            "txn_type": "TEXT", "merchant": "TEXT", "status": "TEXT", "account_number": "TEXT", "card_last4": "TEXT"}),
    "hr_records": ZoneTable(
        name="hr_records", key="emp_id", derived="tenure_years", derived_type="REAL",
        columns={
            "emp_id": "TEXT", "full_name": "TEXT", "email": "TEXT", "department": "TEXT", "designation": "TEXT",
            "salary": "REAL", "join_date": "TEXT", "manager_id": "TEXT", "performance_score": "INTEGER",
            "is_active": "INTEGER"}),
    "product_catalog": ZoneTable(
        name="product_catalog", key="product_id", derived=None, derived_type=None,
        columns={
            "product_id": "TEXT", "product_name": "TEXT", "category": "TEXT", "sub_category": "TEXT",
            "price": "REAL", "stock_qty": "INTEGER", "supplier": "TEXT", "last_updated": "TEXT"}),
    "sensor_telemetry": ZoneTable(
        name="sensor_telemetry", key="sensor_id", derived="is_anomaly", derived_type="INTEGER",
        columns={
            "sensor_id": "TEXT", "timestamp": "TEXT", "location": "TEXT", "temperature": "REAL", "humidity": "REAL",
            "pressure": "REAL", "battery_pct": "REAL", "alert_flag": "INTEGER"}),
    "audit_trail": ZoneTable(
        name="audit_trail", key="audit_id", derived="ip_country", derived_type="TEXT",
        columns={
            "audit_id": "TEXT", "user_id": "TEXT", "action": "TEXT", "entity": "TEXT", "entity_id": "TEXT",
            "ip_address": "TEXT", "timestamp": "TEXT", "status": "TEXT"}),
}

# Source file of each raw table.
SOURCE_FILES = {f"{name}.csv": name for name in ZONE_TABLES}
