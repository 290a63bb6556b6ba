"""Scalar functions and predicates, each over a whole dirty table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import dates, derive, naming, numbers, text
from tablewright.operators import cells
from tablewright.plans import clean, profile

from . import constants
from . import sqltext as q
from .base import AS_OF, query
from .views import COLUMNS, VIEWS, ctes, table, view

CUSTOMER = COLUMNS["dirty_customer"]


@query("f1_blank", ctes("dirty_customer") + f"""
SELECT seq, {", ".join(f"CAST({q.blank(c)} AS INT) AS {c}_blank, CAST({q.empty(c)} AS INT) AS {c}_empty" for c in CUSTOMER)}
FROM dirty_customer""")
def f1_blank(spark, sf):
    df = view(spark, sf, "dirty_customer")
    flags = []
    for c in CUSTOMER:
        flags += [text.is_blank(F.col(c)).cast("int").alias(f"{c}_blank"),
                  text.is_empty(F.col(c)).cast("int").alias(f"{c}_empty")]
    return df.select("seq", *flags)


@query("f2_strip_null", ctes("dirty_customer") + f"""
SELECT seq, {", ".join(f"nullif(trim({c}), '') AS {c}" for c in CUSTOMER)} FROM dirty_customer""")
def f2_strip_null(spark, sf):
    df = view(spark, sf, "dirty_customer")
    return df.select("seq", *[text.strip_to_null(F.col(c)).alias(c) for c in CUSTOMER])


@query("f3_date_zone", ctes("dirty_customer") + f"""
SELECT seq, {q.date_iso('dob', q.ZONE)} AS dob, {q.date_iso('created_at', q.ZONE)} AS created_at FROM dirty_customer""")
def f3_date_zone(spark, sf):
    return view(spark, sf, "dirty_customer").select(
        "seq", *[dates.zone_date(F.col(c)).alias(c) for c in ("dob", "created_at")])


@query("f4_date_any", ctes("dirty_customer") + f"""
SELECT seq, {q.date_iso('dob', q.ANY)} AS dob, {q.date_iso('created_at', q.ANY)} AS created_at FROM dirty_customer""")
def f4_date_any(spark, sf):
    return view(spark, sf, "dirty_customer").select(
        "seq", *[dates.any_file_date(F.col(c)).alias(c) for c in ("dob", "created_at")])


@query("f5_date_parse", ctes("dirty_customer") + f"""
SELECT seq, strftime({q.date_stamp('dob')}, '%Y-%m-%d %H:%M:%S') AS stamp, {q.date_format('dob')} AS date_format
FROM dirty_customer""")
def f5_date_parse(spark, sf):
    stripped = view(spark, sf, "dirty_customer").select("seq", text.strip(F.col("dob")).alias("dob"))
    tagged = stripped.select("seq", dates.tagged_date(F.col("dob")).alias("t"))
    return tagged.select("seq", dates.tagged_stamp(F.col("t")).alias("stamp"),
                         dates.tagged_format(F.col("t")).alias("date_format"))


@query("f6_number", ctes("dirty_txn") + f"""
SELECT seq, {q.number('amount')} AS amount, {q.number('account_number')} AS account_number,
  {q.number('currency')} AS currency FROM dirty_txn""")
def f6_number(spark, sf):
    return view(spark, sf, "dirty_txn").select(
        "seq", *[numbers.number(F.col(c)).alias(c) for c in ("amount", "account_number", "currency")])


@query("f7_case", ctes("dirty_customer") + f"""
SELECT seq, lower(trim(account_type)) AS account_lower, upper(trim(country)) AS country_upper,
  {q.title('trim(full_name)')} AS name_title, {q.title('trim(email)')} AS email_title FROM dirty_customer""")
def f7_case(spark, sf):
    s = lambda c: text.strip(F.col(c))
    return view(spark, sf, "dirty_customer").select(
        "seq", F.lower(s("account_type")).alias("account_lower"), F.upper(s("country")).alias("country_upper"),
        text.title(s("full_name")).alias("name_title"), text.title(s("email")).alias("email_title"))


@query("f8_patterns", ctes("dirty_customer") + f"""
SELECT seq, CAST(regexp_matches(trim(email), '{q.EMAIL}') AS INT) AS is_email,
  CAST(regexp_matches(trim(phone), '{q.PHONE}') AND NOT regexp_matches(replace(replace(trim(phone), ' ', ''), '-', ''),
    '{q.PLAIN}') AS INT) AS is_phone,
  CAST(regexp_matches(trim(dob), '{q.PHONE}') AND NOT regexp_matches(replace(replace(trim(dob), ' ', ''), '-', ''),
    '{q.PLAIN}') AS INT) AS dob_is_phone
FROM dirty_customer""")
def f8_patterns(spark, sf):
    return view(spark, sf, "dirty_customer").select(
        "seq", text.is_email(F.col("email")).cast("int").alias("is_email"),
        text.is_phone(F.col("phone")).cast("int").alias("is_phone"),
        text.is_phone(F.col("dob")).cast("int").alias("dob_is_phone"))


RATE_SQL = """CAST(CASE upper(currency) WHEN 'USD' THEN 1.0 WHEN 'EUR' THEN 1.09 WHEN 'GBP' THEN 1.27 WHEN 'CAD' THEN 0.74
  WHEN 'AUD' THEN 0.66 WHEN 'JPY' THEN 0.0067 WHEN 'INR' THEN 0.012 ELSE 1.0 END AS DECIMAL(10,4))"""
USD_SQL = f"""CASE WHEN {q.empty('amount')} THEN 0.0 WHEN regexp_matches(amount, '{q.FLOAT}')
  THEN CAST(round(try_cast(amount AS DECIMAL(18,6)) * {RATE_SQL}, 2) AS DOUBLE) END"""


@query("f9_amount_usd", ctes("dirty_txn") + f"SELECT seq, CAST({USD_SQL} AS DOUBLE) AS amount_usd FROM dirty_txn")
def f9_amount_usd(spark, sf):
    return view(spark, sf, "dirty_txn").select(
        "seq", derive.amount_usd(F.col("amount"), F.col("currency")).alias("amount_usd"))


ISO10 = r"^\d{4}-\d{2}-\d{2}$"


def day_sql(c):
    h = f"substr({c}, 1, 10)"
    return f"(CASE WHEN regexp_matches({h}, '{ISO10}') THEN try_cast({h} AS DATE) END)"


def age_sql(c):
    y = f"floor(date_diff('day', {day_sql(c)}, DATE '{AS_OF}') / 365)"
    return (f"(CASE WHEN {y} IS NULL THEN 'Unknown' WHEN {y} < 18 THEN 'Under 18' WHEN {y} <= 25 THEN '18-25' "
            f"WHEN {y} <= 40 THEN '26-40' WHEN {y} <= 60 THEN '41-60' ELSE '60+' END)")


def tenure_sql(c):
    d = f"date_diff('day', {day_sql(c)}, DATE '{AS_OF}')"
    return f"CAST(round(CAST({d} AS DOUBLE) / 365.25, 2) AS DOUBLE)"


@query("f10_age_group", ctes("dirty_customer") + f"SELECT seq, {age_sql('dob')} AS age_group FROM dirty_customer")
def f10_age_group(spark, sf):
    return view(spark, sf, "dirty_customer").select("seq", derive.age_group(F.col("dob"), AS_OF).alias("age_group"))


@query("f11_tenure", ctes("dirty_hr") + f"SELECT seq, {tenure_sql('join_date')} AS tenure_years FROM dirty_hr")
def f11_tenure(spark, sf):
    return view(spark, sf, "dirty_hr").select("seq", derive.tenure_years(F.col("join_date"), AS_OF).alias("tenure_years"))


IP_SQL = """CASE split_part(ip_address, '.', 1) WHEN '192' THEN 'US' WHEN '10' THEN 'US' WHEN '172' THEN 'US'
  WHEN '203' THEN 'AU' WHEN '198' THEN 'GB' WHEN '45' THEN 'US' WHEN '104' THEN 'DE' WHEN '178' THEN 'FR'
  ELSE 'Unknown' END"""


@query("f12_ip_country", ctes("dirty_audit") + f"SELECT seq, {IP_SQL} AS ip_country FROM dirty_audit")
def f12_ip_country(spark, sf):
    return view(spark, sf, "dirty_audit").select("seq", derive.ip_country(F.col("ip_address")).alias("ip_country"))


ANOMALY_SQL = f"""CAST(CASE WHEN coalesce({q.real('temperature')}, 0) > 80 OR coalesce({q.real('temperature')}, 0) < -10
  THEN 1 ELSE 0 END AS INT)"""


@query("f13_anomaly", ctes("dirty_sensor") + f"SELECT seq, {ANOMALY_SQL} AS is_anomaly FROM dirty_sensor")
def f13_anomaly(spark, sf):
    return view(spark, sf, "dirty_sensor").select("seq", derive.is_anomaly(F.col("temperature")).alias("is_anomaly"))


@query("f14_absolute", ctes("dirty_txn") + f"""
SELECT seq, abs({q.number('amount')}) AS amount_abs,
  CASE WHEN {q.number('amount')} >= 0 THEN {q.number('amount')} END AS amount_null_negative,
  CASE WHEN {q.number('amount')} IS NOT NULL
    THEN least(greatest({q.number('amount')}, 1000.0), 200000.0) END AS amount_capped FROM dirty_txn""")
def f14_absolute(spark, sf):
    x = F.col("x")
    return view(spark, sf, "dirty_txn").select("seq", numbers.number(F.col("amount")).alias("x")).select(
        "seq", F.abs(x).alias("amount_abs"), F.when(x >= 0, x).alias("amount_null_negative"),
        F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(1000.0)), F.lit(200000.0))).alias("amount_capped"))


def label_union(label):
    """One row per (view, column): its label and its number of filled cells."""
    rows = []
    for v, cols in COLUMNS.items():
        counts = ", ".join(f"""count(nullif(trim("{c}"), '')) AS "{c}" """ for c in cols)
        rows.append(f"SELECT '{v}' AS table_name, column_name, {label} AS label, filled FROM (UNPIVOT "
                    f"(SELECT {counts} FROM {v}) ON COLUMNS(*) INTO NAME column_name VALUE filled)")
    return ctes(*COLUMNS) + "\n" + "\nUNION ALL\n".join(rows)


def labelled(spark, sf, label):
    parts = []
    for v, cols in COLUMNS.items():
        counts = cells.filled_counts(view(spark, sf, v), cols, text.is_empty)
        parts.append(counts.withColumn("table_name", F.lit(v)).withColumn(
            "label", cells.by_name(F.col("column_name"), {c: label(c) for c in cols})))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "column_name", "label", "filled")


@query("f15_sensitivity", label_union(q.sensitivity("column_name", constants.PROFILE_KEYWORDS)))
def f15_sensitivity(spark, sf):
    return labelled(spark, sf, naming.sensitivity)


@query("f16_sensitivity_any", label_union(q.sensitivity("column_name", constants.ANY_FILE_KEYWORDS)))
def f16_sensitivity_any(spark, sf):
    return labelled(spark, sf, lambda c: naming.sensitivity(c, naming.ANY_FILE_KEYWORDS))


@query("f17_date_cols", label_union(
    "CASE WHEN regexp_matches(column_name, '(_date|_at|dob|join_date|last_updated|timestamp)$') THEN 'date' "
    "ELSE 'other' END"))
def f17_date_cols(spark, sf):
    return labelled(spark, sf, lambda c: "date" if naming.is_zone_date(c) else "other")


def unpivot_sql(v, cols, seq="seq"):
    return " UNION ALL ".join(
        f"""SELECT {i} AS pos, '{c}' AS column_name, "{c}" AS v, {seq} AS seq FROM {v}""" for i, c in enumerate(cols))


ANY_DATE_SQL = f"""
, long AS ({unpivot_sql('dirty_customer', CUSTOMER)}),
head AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY seq) AS rn FROM long),
flags AS (SELECT column_name, max(CASE WHEN {q.strptime("substr(trim(v), 1, 10)", "%Y-%m-%d")} IS NOT NULL
   OR {q.strptime("substr(trim(v), 1, 10)", "%d/%m/%Y")} IS NOT NULL THEN 1 ELSE 0 END) AS by_value
   FROM head WHERE rn <= 5 GROUP BY column_name)
SELECT column_name, CAST(CASE WHEN regexp_matches(lower(column_name),
  'date|time|created|updated|at|on|dob|birth|joined|hired|start|end|timestamp|ts') THEN 1 ELSE by_value END AS INT)
  AS is_date FROM flags"""


@query("f18_date_cols_any", ctes("dirty_customer") + ANY_DATE_SQL)
def f18_date_cols_any(spark, sf):
    return cells.date_columns(view(spark, sf, "dirty_customer"), CUSTOMER, "seq")


def flag_sql(v, test, extra=0):
    cols = COLUMNS[v]
    n = " + ".join(f"CAST({test(chr(34) + c + chr(34))} AS INT)" for c in cols)
    return ctes(v) + f"SELECT seq, CASE WHEN ({n}) * 10 > {3 * (len(cols) + extra)} THEN 'POOR' ELSE 'OK' END AS flag FROM {v}"


def flag_query(name, test, extra):
    for v in ("dirty_customer", "dirty_product"):
        sql_test = q.blank if test is text.is_blank else q.empty

        @query(f"f19_quality_flag_{name}" + ("" if v == "dirty_customer" else "_product"), flag_sql(v, sql_test, extra))
        def run(spark, sf, v=v):
            missing = [test(F.col(c)) for c in COLUMNS[v]]
            return view(spark, sf, v).select("seq", derive.quality_flag(missing, extra).alias("flag"))


flag_query("zone", text.is_empty, 3)
flag_query("any", text.is_empty, 0)
flag_query("clean", text.is_blank, 0)


# Whole numbers beyond the doubles, and amounts with more decimals than cents.
@query("c12_abs_long", """SELECT l_orderkey * 10 + l_linenumber AS seq, ltrim(CAST(l_partkey AS VARCHAR) || '12345678901234567' ||
  CAST(l_suppkey AS VARCHAR) || repeat('7', CAST(l_linenumber * 4 AS INT)), '0') AS n FROM lineitem""")
def c12_abs_long(spark, sf):
    lines = table(spark, sf, "lineitem")
    long = F.concat(F.lit("-"), F.col("l_partkey").cast("string"), F.lit("12345678901234567"), F.col("l_suppkey").cast("string"),
                    F.expr("repeat('7', CAST(l_linenumber * 4 AS INT))"))
    df = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), long.alias("n"))
    return clean.clean(df, ["n"], "seq", {"columns": {"n": {"action": "abs_values"}}}).data.select("seq", "n")


@query("c8_median_long", """WITH n AS (SELECT CAST('9007199254740992000' AS HUGEINT) + c_custkey AS v, c_custkey FROM customer),
  o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM n WHERE c_custkey % 10 <> 0)
SELECT c_custkey AS seq, CASE WHEN c_custkey % 10 = 0 THEN (SELECT CAST(v AS VARCHAR) FROM o WHERE k = n // 2)
  ELSE CAST(v AS VARCHAR) END AS n FROM n""")
def c8_median_long(spark, sf):
    key = F.col("c_custkey")
    value = F.when(key % 10 == 0, "").otherwise((F.lit("9007199254740992000").cast("decimal(30,0)") + key).cast("string"))
    df = table(spark, sf, "customer").select(key.alias("seq"), value.alias("n"))
    return clean.clean(df, ["n"], "seq", {"columns": {"n": {"action": "fill_missing_median"}}}).data.select("seq", "n")


@query("f9_amount_fine", """SELECT o_orderkey AS seq, CAST(o_orderkey % 1000 * 100 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) / 100 AS amount_usd
FROM orders""")
def f9_amount_fine(spark, sf):
    """Just over and just under half a cent, in the eighth decimal."""
    key = F.col("o_orderkey")
    amount = F.concat((key % 1000).cast("string"), F.when(key % 2 == 0, ".00500001").otherwise(".00499999"))
    return table(spark, sf, "orders").select(key.alias("seq"), derive.amount_usd(amount, F.lit("USD")).alias("amount_usd"))


@query("p18_long_samples", """SELECT CAST(k - 1 AS INT) AS "position", v AS "value" FROM (SELECT v, row_number() OVER (ORDER BY v) AS k FROM (
  SELECT DISTINCT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS v FROM documents) WHERE lower(v) NOT IN ('', 'nan', 'null', 'none', 'n/a', 'na', '-')) WHERE k <= 5""")
def p18_long_samples(spark, sf):
    """The five smallest values of a column of long texts, whole."""
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text")
    values = profile.analyze(df, ["text"], "seq").columns[0].samples
    return spark.createDataFrame(list(enumerate(values)), "position int, value string")


@query("p18_whole_samples", """SELECT CAST(k - 1 AS INT) AS "position", v AS "value" FROM (SELECT v, row_number() OVER (ORDER BY v) AS k FROM (
  SELECT DISTINCT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS v FROM documents) WHERE lower(v) NOT IN ('', 'nan', 'null', 'none', 'n/a', 'na', '-')) WHERE k <= 5""")
def p18_whole_samples(spark, sf):
    """The five smallest values of a column of texts of any length, uncut."""
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text")
    values = profile.analyze(df, ["text"], "seq").columns[0].samples
    return spark.createDataFrame(list(enumerate(values)), "position int, value string")


@query("c18_clean_twice", """SELECT c_custkey AS seq, trim(c_name) AS c_name, 'OK' AS _quality_flag FROM customer""")
def c18_clean_twice(spark, sf):
    """Cleaning a cleaned table replaces its flag, whatever else its columns are called."""
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit(" "), "c_name").alias("c_name"),
                                             F.lit("k").alias("_key"), F.lit("r").alias("_rank"), F.lit("c").alias("_c0"), F.lit("b").alias("a`b"))
    cols = ["c_name", "_key", "_rank", "_c0", "a`b"]
    rules = {"global": {"remove_near_duplicates": True}, "columns": {"c_name": {"action": "trim_whitespace"}, "_c0": {"action": "trim_whitespace"}}}
    once = clean.clean(df, cols, "seq", rules, "_key").data
    twice = clean.clean(once, [c for c in once.columns if c != "seq"], "seq", rules).data
    assert twice.columns == once.columns
    return twice.select("seq", "c_name", "_quality_flag")
