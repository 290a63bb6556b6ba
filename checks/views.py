"""Dirty test tables derived from the given tables, as SQL that Spark and
DuckDB both run.  ``seq`` is the arrival order; other columns are text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "dirty_customer": """
SELECT c_custkey + shift AS seq,
  CASE WHEN c_custkey % 251 = 0 THEN '' ELSE 'CUST' || lpad(CAST(c_custkey AS STRING), 6, '0') END AS customer_id,
  CASE WHEN shift = 20000000 THEN '  ' || upper(c_name)
       WHEN c_custkey % 11 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS full_name,
  CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'bad-email'
       ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
  CASE WHEN c_custkey % 33 = 0 THEN 'N/A'
       ELSE '+1-' || CAST(200 + c_custkey % 800 AS STRING) || '-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS phone,
  CASE WHEN c_custkey % 401 = 0 THEN 'unknown-date'
       WHEN c_custkey % 5 = 0 THEN lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '/' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '/' || CAST(1950 + c_custkey % 56 AS STRING)
       WHEN c_custkey % 7 = 0 THEN lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '.' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '.' || CAST(1950 + c_custkey % 56 AS STRING)
       ELSE CAST(1950 + c_custkey % 56 AS STRING) || '-' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') END AS dob,
  CASE WHEN c_custkey % 29 = 0 THEN '-' ELSE CAST(c_custkey AS STRING) || ' Main St' END AS address,
  CASE WHEN c_custkey % 29 = 0 THEN '' ELSE 'City' || CAST(c_nationkey AS STRING) END AS city,
  CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_nationkey % 3 = 0 THEN 'US' WHEN c_nationkey % 3 = 1 THEN 'Ca' ELSE 'gb' END AS country,
  CASE WHEN c_custkey % 13 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS account_type,
  CASE WHEN c_custkey % 58 = 0 THEN '' ELSE CAST(2018 + c_custkey % 7 AS STRING) || '-06-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') END AS created_at
FROM customer CROSS JOIN (SELECT 0 AS shift UNION ALL SELECT 10000000 UNION ALL SELECT 20000000) s
WHERE shift = 0 OR (shift = 10000000 AND c_custkey % 67 = 0) OR (shift = 20000000 AND c_custkey % 71 = 0)
""",
    "dirty_txn": """
SELECT o_orderkey AS seq,
  'TXN' || lpad(CAST(o_orderkey AS STRING), 7, '0') AS txn_id,
  'CUST' || lpad(CAST(o_custkey AS STRING), 6, '0') AS customer_id,
  CASE WHEN o_orderkey % 125 = 0 THEN '0' WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 131 = 0 THEN 'abc'
       WHEN o_orderkey % 89 = 0 THEN '-' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS amount,
  CASE WHEN o_orderkey % 53 = 0 THEN 'XXX' WHEN o_orderkey % 59 = 0 THEN 'eur' WHEN o_orderkey % 61 = 0 THEN ''
       WHEN o_orderkey % 7 = 0 THEN 'EUR' WHEN o_orderkey % 7 = 1 THEN 'GBP' WHEN o_orderkey % 7 = 2 THEN 'CAD'
       WHEN o_orderkey % 7 = 3 THEN 'AUD' WHEN o_orderkey % 7 = 4 THEN 'JPY' WHEN o_orderkey % 7 = 5 THEN 'INR' ELSE 'USD' END AS currency,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS txn_date,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Refund' ELSE 'Purchase' END AS txn_type,
  CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'Merchant ' || substr(o_orderpriority, 1, 1) END AS merchant,
  CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 43 = 0 THEN 'Cancelled' WHEN o_orderstatus = 'F' THEN 'Completed'
       WHEN o_orderstatus = 'O' THEN 'Pending' ELSE 'Failed' END AS status,
  lpad(CAST(o_orderkey * 7919 % 1000000007 AS STRING), 12, '0') AS account_number,
  lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') AS card_last4
FROM orders
""",
    "dirty_hr": """
SELECT c_custkey AS seq, 'EMP' || lpad(CAST(c_custkey AS STRING), 5, '0') AS emp_id, c_name AS full_name,
  lower(replace(c_name, '#', '.')) || '@corp.example' AS email,
  CASE WHEN c_custkey % 90 = 0 THEN '' ELSE c_mktsegment END AS department,
  'Grade ' || CAST(c_custkey % 4 AS STRING) AS designation,
  CASE WHEN c_custkey % 77 = 0 THEN 'n/a' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS salary,
  CASE WHEN c_custkey % 83 = 0 THEN '' ELSE CAST(2010 + c_custkey % 15 AS STRING) || '-03-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') END AS join_date,
  CASE WHEN c_custkey % 25 = 0 THEN '' ELSE 'EMP' || lpad(CAST(c_custkey % 100 AS STRING), 5, '0') END AS manager_id,
  CASE WHEN c_custkey % 61 = 0 THEN '9' WHEN c_custkey % 62 = 0 THEN '' WHEN c_custkey % 63 = 0 THEN '0' ELSE CAST(1 + c_custkey % 5 AS STRING) END AS performance_score,
  CASE WHEN c_custkey % 4 = 0 THEN '0' ELSE '1' END AS is_active
FROM customer
""",
    "dirty_product": """
SELECT p_partkey AS seq, 'PROD' || lpad(CAST(p_partkey AS STRING), 6, '0') AS product_id, p_name AS product_name,
  CASE WHEN p_partkey % 19 = 0 THEN lower(p_type) ELSE p_type END AS category, p_brand AS sub_category,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS price,
  CASE WHEN p_partkey % 37 = 0 THEN '' WHEN p_partkey % 39 = 0 THEN '-3' ELSE CAST(p_size * 4 AS STRING) END AS stock_qty,
  'Supplier ' || CAST(p_partkey % 10 AS STRING) AS supplier,
  '2024-0' || CAST(1 + p_partkey % 9 AS STRING) || '-15' AS last_updated
FROM part
""",
    "dirty_sensor": """
SELECT event_id AS seq, 'SENS' || lpad(CAST(event_id AS STRING), 6, '0') AS sensor_id,
  CAST(CAST(ts AS DATE) AS STRING) || ' 00:00:00' AS "timestamp", 'Zone-' || event_type AS location,
  CAST(CAST("value" - 20 AS DECIMAL(18,2)) AS STRING) AS temperature,
  CAST(CAST(10 + user_id % 90 AS DECIMAL(18,2)) AS STRING) AS humidity,
  CAST(950 + user_id % 100 AS STRING) AS pressure,
  CASE WHEN event_id % 33 = 0 THEN '' ELSE CAST(5 + event_id % 95 AS STRING) END AS battery_pct,
  CASE WHEN "value" - 20 > 80 OR "value" - 20 < -10 OR user_id % 90 > 80 THEN '1' ELSE '0' END AS alert_flag
FROM events
""",
    "dirty_audit": """
SELECT event_id AS seq, 'AUD' || lpad(CAST(event_id AS STRING), 7, '0') AS audit_id,
  'USR' || lpad(CAST(user_id AS STRING), 5, '0') AS user_id, upper(event_type) AS action, 'Order' AS entity,
  'ENT' || lpad(CAST(event_id % 1000 AS STRING), 6, '0') AS entity_id,
  CASE WHEN event_id % 47 = 0 THEN ''
       WHEN event_id % 8 = 0 THEN '192.168' WHEN event_id % 8 = 1 THEN '10.0' WHEN event_id % 8 = 2 THEN '172.16'
       WHEN event_id % 8 = 3 THEN '203.45' WHEN event_id % 8 = 4 THEN '198.51' WHEN event_id % 8 = 5 THEN '45.33'
       WHEN event_id % 8 = 6 THEN '104.21' ELSE '8.8' END || CASE WHEN event_id % 47 = 0 THEN '' ELSE '.' || CAST(event_id % 254 AS STRING) || '.1' END AS ip_address,
  CAST(CAST(ts AS DATE) AS STRING) || ' 00:00:00' AS "timestamp",
  CASE WHEN event_id % 9 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM events
""",
}

BASE = {
    "dirty_customer": "customer", "dirty_txn": "orders", "dirty_hr": "customer",
    "dirty_product": "part", "dirty_sensor": "events", "dirty_audit": "events",
}

COLUMNS = {
    "dirty_customer": ["customer_id", "full_name", "email", "phone", "dob", "address", "city", "country",
                       "account_type", "created_at"],
    "dirty_txn": ["txn_id", "customer_id", "amount", "currency", "txn_date", "txn_type", "merchant", "status",
                  "account_number", "card_last4"],
    "dirty_hr": ["emp_id", "full_name", "email", "department", "designation", "salary", "join_date", "manager_id",
                 "performance_score", "is_active"],
    "dirty_product": ["product_id", "product_name", "category", "sub_category", "price", "stock_qty", "supplier",
                      "last_updated"],
    "dirty_sensor": ["sensor_id", "timestamp", "location", "temperature", "humidity", "pressure", "battery_pct",
                     "alert_flag"],
    "dirty_audit": ["audit_id", "user_id", "action", "entity", "entity_id", "ip_address", "timestamp", "status"],
}

# The zone table each view stands for.
ZONE_TABLE = {
    "dirty_customer": "customer_profiles", "dirty_txn": "transaction_logs", "dirty_hr": "hr_records",
    "dirty_product": "product_catalog", "dirty_sensor": "sensor_telemetry", "dirty_audit": "audit_trail",
}

# Copies of a customer row are exploded from the row itself: no cross join.
_COPIES = """FROM (SELECT c.*, explode(array_compact(array(0,
  CASE WHEN c_custkey % 67 = 0 THEN 10000000 END, CASE WHEN c_custkey % 71 = 0 THEN 20000000 END))) AS shift
  FROM {customer} c)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, dealt to the cores: each is a file of one row group, which
    is one task otherwise."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One dirty table as a DataFrame."""
    base = BASE[name]
    sql = VIEWS[name].replace('"', "`")
    if name == "dirty_customer":
        sql = sql[: sql.index("FROM customer CROSS JOIN")] + _COPIES
    else:
        sql = sql.replace(f"FROM {base}", "FROM {%s}" % base)
    return spark.sql(sql, **{base: table(spark, sf_dir, base)})


def ctes(*names: str) -> str:
    """WITH clause that defines the views for DuckDB, open for more entries."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
