"""Zone plans: cleanse, derive, publish."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import ZONE_TABLES
from tablewright.functions import naming
from tablewright.plans import zones

from . import constants
from . import sqltext as q
from .base import AS_OF, query
from .q_functions import ANOMALY_SQL, IP_SQL, USD_SQL, age_sql, tenure_sql
from .views import COLUMNS, ZONE_TABLE, ctes, view

RUN_TIME = f"{AS_OF} 00:00:00"
SHORT = {"dirty_customer": "customer", "dirty_txn": "txn", "dirty_hr": "hr", "dirty_product": "product",
         "dirty_sensor": "sensor", "dirty_audit": "audit"}


def curated_ctes(*views):
    """cur_<view>: the curated rows of each view, for more CTEs to use."""
    out = []
    for v in views:
        key, names = constants.ZONE_KEYS[ZONE_TABLE[v]], COLUMNS[v]
        cells = []
        for c in names:
            s = f"""nullif(trim("{c}"), '')"""
            cells.append(f'{q.date_iso(s, q.ZONE) if c.endswith(tuple(constants.ZONE_DATE_ENDINGS)) else s} AS "{c}"')
        n = " + ".join(f'CAST("{c}" IS NULL AS INT)' for c in names)
        out.append(f"std_{v} AS (SELECT seq, {', '.join(cells)} FROM {v})")
        out.append(f"""flag_{v} AS (SELECT *, CASE WHEN ({n}) * 10 > {3 * (len(names) + 3)} THEN 'POOR' ELSE 'OK'
          END AS _quality_flag, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn FROM std_{v})""")
        out.append(f"cur_{v} AS (SELECT * EXCLUDE (rn) FROM flag_{v} WHERE {key} IS NOT NULL AND rn = 1)")
    return ctes(*views) + ",\n" + ",\n".join(out)


def curated(spark, sf, v):
    return zones.cleanse(view(spark, sf, v), ZONE_TABLE[v], "seq", RUN_TIME)


def derived(spark, sf, v):
    return zones.with_derived(curated(spark, sf, v), ZONE_TABLE[v], AS_OF)


for _v in COLUMNS:
    @query(f"z1_cleanse_{SHORT[_v]}", curated_ctes(_v) + f"SELECT *, CAST(0 AS INT) AS _is_duplicate FROM cur_{_v}")
    def z1(spark, sf, v=_v):
        return curated(spark, sf, v).drop("_cleansed_at")


@query("z2_cleanse_report", curated_ctes(*COLUMNS) + " UNION ALL ".join(f"""
SELECT '{ZONE_TABLE[v]}' AS table_name, (SELECT count(*) FROM {v}) AS rows_in, (SELECT count(*) FROM cur_{v}) AS rows_out,
  (SELECT count(*) FROM flag_{v} WHERE {constants.ZONE_KEYS[ZONE_TABLE[v]]} IS NOT NULL AND rn > 1) AS dupes_removed,
  (SELECT count(*) FROM cur_{v} WHERE _quality_flag = 'POOR') AS poor_quality""" for v in COLUMNS))
def z2_cleanse_report(spark, sf):
    out = None
    for v in COLUMNS:
        one = zones.cleanse_report(view(spark, sf, v), ZONE_TABLE[v], "seq")
        out = one if out is None else out.unionAll(one)
    return out


DERIVED_SQL = {
    "dirty_customer": f"{age_sql('dob')} AS age_group",
    "dirty_txn": f"CAST({USD_SQL} AS DOUBLE) AS amount_usd",
    "dirty_hr": f"{tenure_sql('join_date')} AS tenure_years",
    "dirty_sensor": f"{ANOMALY_SQL} AS is_anomaly",
    "dirty_audit": f"{IP_SQL} AS ip_country",
}

for _v, _sql in DERIVED_SQL.items():
    _key = constants.ZONE_KEYS[ZONE_TABLE[_v]]

    @query(f"z4_derive_{SHORT[_v]}", curated_ctes(_v) + f"SELECT {_key}, {_sql} FROM cur_{_v}")
    def z4(spark, sf, v=_v, key=_key, name=_sql.rsplit(" AS ", 1)[1]):
        return derived(spark, sf, v).select(key, name)


ACTIVE_SQL = """
SELECT c.customer_id, c.full_name, c.email, c.account_type, c.country, max(t.txn_date) AS last_txn_date,
  count(t.txn_id) AS txn_count
FROM cur_dirty_customer c JOIN cur_dirty_txn t ON c.customer_id = t.customer_id
WHERE t.txn_date >= (SELECT strftime(CAST(max(txn_date) AS DATE) - INTERVAL 90 DAY, '%Y-%m-%d') FROM cur_dirty_txn)
  AND c._quality_flag <> 'POOR' GROUP BY 1, 2, 3, 4, 5"""
HIGH_SQL = f"""SELECT txn_id, customer_id, {q.real('amount')} AS amount, amount_usd, currency, txn_date, merchant, status
FROM (SELECT *, CAST({USD_SQL} AS DOUBLE) AS amount_usd FROM cur_dirty_txn)
WHERE amount_usd > 10000 AND status NOT IN ('Failed', 'Cancelled')"""


def loose(c):
    return f"(CASE WHEN {c} IS NOT NULL THEN coalesce({q.real(c)}, 0) END)"


HEADCOUNT_SQL = f"""SELECT department, count(*) AS headcount,
  CAST(round(CAST(avg({loose('salary')}) AS DECIMAL(28,10)), 2) AS DOUBLE) AS avg_salary,
  CAST(round(CAST(avg({loose('performance_score')}) AS DECIMAL(28,10)), 2) AS DOUBLE) AS avg_performance,
  CAST(sum(CASE WHEN is_active = '1' THEN 1 ELSE 0 END) AS BIGINT) AS active_count
FROM cur_dirty_hr GROUP BY department"""
LOW_SQL = f"""SELECT product_id, product_name, category, {q.real('price')} AS price,
  try_cast(stock_qty AS BIGINT) AS stock_qty, supplier FROM cur_dirty_product WHERE {loose('stock_qty')} < 50"""
ALERT_SQL = f"""SELECT sensor_id, "timestamp", location, {q.real('temperature')} AS temperature,
  {q.real('humidity')} AS humidity, {q.real('battery_pct')} AS battery_pct, try_cast(alert_flag AS BIGINT) AS alert_flag,
  {ANOMALY_SQL} AS is_anomaly FROM cur_dirty_sensor WHERE alert_flag = '1'"""


@query("z5_active_customers", curated_ctes("dirty_customer", "dirty_txn") + ACTIVE_SQL)
def z5_active_customers(spark, sf):
    return zones.active_customers(curated(spark, sf, "dirty_customer"), curated(spark, sf, "dirty_txn"))


@query("z6_high_value", curated_ctes("dirty_txn") + HIGH_SQL)
def z6_high_value(spark, sf):
    return zones.high_value_transactions(derived(spark, sf, "dirty_txn"))


@query("z7_headcount", curated_ctes("dirty_hr") + HEADCOUNT_SQL)
def z7_headcount(spark, sf):
    return zones.department_headcount(curated(spark, sf, "dirty_hr"))


@query("z8_low_stock", curated_ctes("dirty_product") + LOW_SQL)
def z8_low_stock(spark, sf):
    return zones.low_stock_products(curated(spark, sf, "dirty_product"))


@query("z9_alerts", curated_ctes("dirty_sensor") + ALERT_SQL)
def z9_alerts(spark, sf):
    return zones.sensor_alerts(derived(spark, sf, "dirty_sensor"))


def all_derived(spark, sf):
    return {ZONE_TABLE[v]: derived(spark, sf, v) for v in COLUMNS}


@query("z10_load_counts", curated_ctes(*COLUMNS) + f"""
SELECT 'cons_active_customers' AS table_name, count(*) AS "rows" FROM ({ACTIVE_SQL})
UNION ALL SELECT 'cons_high_value_transactions', count(*) FROM ({HIGH_SQL})
UNION ALL SELECT 'cons_department_headcount', count(*) FROM ({HEADCOUNT_SQL})
UNION ALL SELECT 'cons_low_stock_products', count(*) FROM ({LOW_SQL})
UNION ALL SELECT 'cons_sensor_alerts', count(*) FROM ({ALERT_SQL})""")
def z10_load_counts(spark, sf):
    return zones.row_counts(zones.publish(all_derived(spark, sf)))


@query("z11_run_summary", curated_ctes(*COLUMNS) + "SELECT CAST("
       + " + ".join(f"(SELECT count(*) FROM {v})" for v in COLUMNS) + " AS BIGINT) AS total_raw_rows, CAST("
       + " + ".join(f"(SELECT count(*) FROM cur_{v})" for v in COLUMNS) + " AS BIGINT) AS total_curated_rows, CAST("
       + " + ".join(f"(SELECT count(*) FROM cur_{v} WHERE _quality_flag = 'POOR')" for v in COLUMNS)
       + " AS BIGINT) AS poor_quality_rows, CAST(12 AS INT) AS pii_columns_tagged")
def z11_run_summary(spark, sf):
    from tablewright.catalog.governance import pii_columns

    raw = {v: view(spark, sf, v) for v in COLUMNS}
    return zones.run_summary(raw, {v: curated(spark, sf, v) for v in COLUMNS}, pii_columns())
