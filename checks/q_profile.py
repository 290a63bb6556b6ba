"""Column and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import naming, numbers, text
from tablewright.operators import cells, histogram
from tablewright.operators.dedupe import duplicate_counts
from tablewright.operators.ranks import long_numbers, statistics
from tablewright.plans import profile
from tablewright.session import stage

from . import constants
from . import sqltext as q
from .base import query
from .q_functions import unpivot_sql
from .views import COLUMNS, ctes, table, view

CUSTOMER = COLUMNS["dirty_customer"]


def names_sql(words):
    return "|".join(words)


def profile_parts(v, cols, prefix=""):
    """CTEs that build ``prof``: one row per column of ``v`` with every count."""
    p = prefix
    return f"""
{p}long AS MATERIALIZED ({unpivot_sql(v, cols)}),
{p}cnt AS (SELECT pos, column_name, count(*) AS total_rows, count(*) FILTER ({q.blank('v')}) AS null_count,
  count(*) FILTER (v <> trim(v)) AS whitespace_count,
  count(DISTINCT CASE WHEN NOT {q.blank('v')} THEN trim(v) END) AS unique_count FROM {p}long GROUP BY 1, 2),
{p}nb AS MATERIALIZED (SELECT *, trim(v) AS s, {q.number('v')} AS num,
  row_number() OVER (PARTITION BY column_name ORDER BY seq) AS rn FROM {p}long WHERE NOT {q.blank('v')}),
{p}lead AS MATERIALIZED (SELECT *, {q.date_format('v')} AS fmt, regexp_matches(s, '{q.EMAIL}') AS is_email,
  regexp_matches(s, '{q.PHONE}') AND NOT regexp_matches(replace(replace(s, ' ', ''), '-', ''), '{q.PLAIN}') AS is_phone
  FROM {p}nb WHERE rn <= 500),
{p}share AS (SELECT column_name, count(fmt) / count(*) AS dates, count(*) FILTER (is_email) / count(*) AS emails,
  count(num) / count(*) AS nums, count(*) FILTER (is_phone) / count(*) AS phones
  FROM {p}lead WHERE rn <= 200 GROUP BY 1),
{p}fmt1 AS (SELECT column_name, fmt, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, min(rn)) AS o
  FROM {p}lead WHERE rn <= 50 AND fmt IS NOT NULL GROUP BY 1, 2),
{p}kind AS (SELECT c.*, CASE WHEN dates > 0.7 THEN 'date' WHEN emails > 0.7 THEN 'email' WHEN nums > 0.85 THEN 'number'
    WHEN phones > 0.7 THEN 'phone' WHEN unique_count BETWEEN 2 AND 20 THEN 'categorical' ELSE 'text' END AS inferred_type,
  (SELECT fmt FROM {p}fmt1 f WHERE f.column_name = c.column_name AND o = 1) AS usual
  FROM {p}cnt c LEFT JOIN {p}share s ON c.column_name = s.column_name),
{p}mixed AS (SELECT l.column_name, count(*) AS n FROM {p}lead l JOIN {p}kind k ON l.column_name = k.column_name
  WHERE k.inferred_type = 'date' AND l.fmt <> k.usual GROUP BY 1),
{p}spell AS (SELECT column_name, lower(s) AS f, s, count(*) AS n FROM {p}nb GROUP BY 1, 2, 3),
{p}cased AS (SELECT column_name, sum(odd) AS n FROM (SELECT column_name, f, sum(n) - max(n) AS odd FROM {p}spell
  GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
{p}mail AS (SELECT column_name, count(*) FILTER (NOT regexp_matches(s, '{q.EMAIL}')) AS n FROM {p}nb GROUP BY 1),
{p}ranked AS (SELECT column_name, num, row_number() OVER (PARTITION BY column_name ORDER BY num) - 1 AS i,
  count(*) OVER (PARTITION BY column_name) AS n FROM {p}nb WHERE num IS NOT NULL),
{p}quart AS (SELECT column_name, any_value(n) AS n, max(num) FILTER (i = n // 4) AS q1, max(num) FILTER (i = 3 * n // 4) AS q3,
  max(num) FILTER (i = n // 2) AS median, avg(num) AS mean FROM {p}ranked GROUP BY 1),
{p}outl AS (SELECT r.column_name, count(*) FILTER (k.n >= 8 AND q3 - q1 <> 0 AND
    (num < q1 - 1.5 * (q3 - q1) OR num > q3 + 1.5 * (q3 - q1))) AS outliers, count(*) FILTER (num < 0) AS negatives
  FROM {p}ranked r JOIN {p}quart k ON r.column_name = k.column_name GROUP BY 1),
{p}prof AS MATERIALIZED (SELECT k.pos, k.column_name, total_rows, null_count, {q.pct('null_count', 'total_rows', 2)} AS null_pct,
  {q.pct('(total_rows - null_count)', 'total_rows', 1)} AS completeness, unique_count, whitespace_count, inferred_type,
  CASE WHEN inferred_type = 'date' THEN usual END AS date_format,
  CAST(coalesce(mixed.n, 0) AS BIGINT) AS format_issues,
  CAST(CASE WHEN inferred_type IN ('text', 'categorical', 'email') THEN coalesce(cased.n, 0) ELSE 0 END AS BIGINT) AS case_issues,
  CAST(CASE WHEN inferred_type = 'email' THEN coalesce(mail.n, 0) ELSE 0 END AS BIGINT) AS email_invalid,
  CAST(CASE WHEN inferred_type = 'number' THEN coalesce(outliers, 0) ELSE 0 END AS BIGINT) AS outlier_count,
  CAST(CASE WHEN inferred_type = 'number' THEN coalesce(negatives, 0) ELSE 0 END AS BIGINT) AS negative_count,
  {q.sensitivity('k.column_name', constants.PROFILE_KEYWORDS)} AS sensitivity
  FROM {p}kind k LEFT JOIN {p}mixed mixed ON mixed.column_name = k.column_name
  LEFT JOIN {p}cased cased ON cased.column_name = k.column_name LEFT JOIN {p}mail mail ON mail.column_name = k.column_name
  LEFT JOIN {p}outl outl ON outl.column_name = k.column_name),
{p}issues AS (
  SELECT pos, column_name, inferred_type, 1 AS ord, 'missing' AS issue, CASE WHEN null_pct > 30 THEN 'high'
    WHEN null_pct > 5 THEN 'medium' ELSE 'low' END AS severity, null_count AS n,
    null_count || ' missing values (' || null_pct || '%)' AS message FROM {p}prof
  UNION ALL SELECT pos, column_name, inferred_type, 2, 'whitespace', 'low', whitespace_count,
    whitespace_count || ' values have extra whitespace' FROM {p}prof
  UNION ALL SELECT pos, column_name, inferred_type, 3, 'case', 'medium', case_issues,
    case_issues || ' values differ only by capitalisation' FROM {p}prof
  UNION ALL SELECT pos, column_name, inferred_type, 4, 'format', 'high', format_issues,
    format_issues || ' dates in mixed formats (expected ' || date_format || ')' FROM {p}prof
  UNION ALL SELECT pos, column_name, inferred_type, 5, 'invalid_email', 'high', email_invalid,
    email_invalid || ' invalid email addresses' FROM {p}prof
  UNION ALL SELECT pos, column_name, inferred_type, 6, 'outliers', 'medium', outlier_count,
    outlier_count || ' numeric outliers detected (IQR rule)' FROM {p}prof
  UNION ALL SELECT pos, column_name, inferred_type, 7, 'negative', 'medium', negative_count,
    negative_count || ' negative values in a column that should be positive' FROM {p}prof
    WHERE regexp_matches(lower(column_name), '{names_sql(constants.POSITIVE_WORDS)}')),
{p}found AS (SELECT * FROM {p}issues WHERE n > 0),
{p}acts AS (SELECT * FROM (VALUES {actions_values()}) a(aord, issue, kind, action, label, is_default)),
{p}sugg AS (SELECT f.pos, f.column_name, CAST(row_number() OVER (PARTITION BY f.column_name ORDER BY aord) - 1 AS INT)
  AS position, action, label, is_default FROM {p}found f JOIN {p}acts a ON a.issue = f.issue
  AND (a.kind IS NULL OR a.kind = f.inferred_type)),
{p}dups AS (SELECT (SELECT count(*) FROM {v}) AS total_rows,
  (SELECT count(*) - count(DISTINCT {q.text_key(cols)}) FROM {v}) AS full_duplicates,
  (SELECT count(*) FROM (SELECT {q.text_key(cols)} AS k, first_value({q.text_key(cols)}) OVER (
     PARTITION BY {q.text_key(cols, True)} ORDER BY seq) AS k1 FROM {v}) WHERE k <> k1) AS near_duplicates),
{p}pk AS (SELECT column_name FROM {p}prof WHERE null_count = 0 AND unique_count = total_rows
  ORDER BY CASE WHEN regexp_matches(lower(column_name), '{names_sql(constants.KEY_WORDS)}') THEN 0 ELSE 1 END, pos LIMIT 1)"""


def actions_values():
    rows = []
    for i, (issue, kind, action, label, default) in enumerate(constants.ACTIONS):
        rows.append(f"({i}, {q.quote(issue)}, {'NULL' if kind is None else q.quote(kind)}, {q.quote(action)}, "
                    f"{q.quote(label)}, CAST({default} AS INT))")
    return ", ".join(rows)


def profile_ctes(v, cols=None, prefix=""):
    return ctes(v) + "," + profile_parts(v, cols or COLUMNS[v], prefix)


PROF = profile_ctes("dirty_customer")
PROF_HR = profile_ctes("dirty_hr")


def customer(spark, sf):
    return view(spark, sf, "dirty_customer")


def report(spark, sf, v="dirty_customer"):
    return profile.analyze(view(spark, sf, v), COLUMNS[v], "seq")


@query("p1_column_profile", PROF + """SELECT column_name, total_rows, null_count, null_pct, completeness, unique_count
FROM prof""")
def p1_column_profile(spark, sf):
    return profile.column_profile(customer(spark, sf), CUSTOMER).drop("position", "whitespace_count")


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem(spark, sf):
    """lineitem as text, in the order of its keys and then of all its columns."""
    return table(spark, sf, "lineitem")


@query("p1_lineitem_profile", "SELECT column_name, total, uniq FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total, count(DISTINCT {c}) AS uniq FROM lineitem" for c in LINE) + ")")
def p1_lineitem_profile(spark, sf):
    df = lineitem(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in LINE])
    out = profile.column_profile(df, LINE)
    return out.select("column_name", F.col("total_rows").alias("total"), F.col("unique_count").alias("uniq"))


@query("p1_documents_profile", f"""SELECT 'text' AS column_name, count(*) AS total_rows,
  count(*) FILTER ({q.blank('text')}) AS null_count, count(DISTINCT trim(text, E' \\t\\n\\r\\x0b\\x0c')) AS unique_count FROM documents""")
def p1_documents_profile(spark, sf):
    out = profile.column_profile(table(spark, sf, "documents").select("text"), ["text"])
    return out.select("column_name", "total_rows", "null_count", "unique_count")


@query("p2_semantic_type", PROF + "SELECT column_name, inferred_type FROM prof")
def p2_semantic_type(spark, sf):
    return profile.types(customer(spark, sf), CUSTOMER, "seq").select("column_name", "inferred_type")


@query("p3_date_format", PROF + "SELECT column_name, date_format FROM prof WHERE inferred_type = 'date'")
def p3_date_format(spark, sf):
    kinds = profile.types(customer(spark, sf), CUSTOMER, "seq")
    return kinds.filter("inferred_type = 'date'").select("column_name", "date_format")


@query("p4_whitespace", PROF + "SELECT column_name, whitespace_count FROM prof")
def p4_whitespace(spark, sf):
    return cells.measure(customer(spark, sf), CUSTOMER,
                         {"whitespace_count": lambda c: F.count_if(c != text.strip(c))}
                         ).select("column_name", "whitespace_count")


def of_type(df, cols, *kinds):
    found = profile.types(df, cols, "seq").filter(F.col("inferred_type").isin(*kinds)).orderBy("position")
    return [r["column_name"] for r in found.select("column_name", "position").collect()]


@query("p5_case", PROF + """SELECT column_name, case_issues FROM prof
WHERE inferred_type IN ('text', 'categorical', 'email')""")
def p5_case(spark, sf):
    df = customer(spark, sf)
    return histogram.case_variants(histogram.value_histogram(df, CUSTOMER), CUSTOMER,
                                   of_type(df, CUSTOMER, *profile.CASE_TYPES))


@query("p6_format", PROF + "SELECT column_name, format_issues FROM prof WHERE inferred_type = 'date'")
def p6_format(spark, sf):
    kinds = profile.types(customer(spark, sf), CUSTOMER, "seq")
    return kinds.filter("inferred_type = 'date'").select("column_name", "format_issues")


@query("p7_email", PROF + "SELECT column_name, email_invalid FROM prof WHERE inferred_type = 'email'")
def p7_email(spark, sf):
    df = customer(spark, sf)
    return histogram.invalid_emails(histogram.value_histogram(df, CUSTOMER), CUSTOMER, of_type(df, CUSTOMER, "email"))


@query("p8_negative", PROF_HR + "SELECT column_name, negative_count FROM prof WHERE inferred_type = 'number'")
def p8_negative(spark, sf):
    df = view(spark, sf, "dirty_hr")
    cols = of_type(df, COLUMNS["dirty_hr"], "number")
    return cells.measure(df, cols, {"negative_count": lambda c: F.count_if(numbers.number(c) < 0)}
                         ).select("column_name", "negative_count")


@query("p9_outliers", PROF_HR + """SELECT q.column_name, q.n, q1, q3, outlier_count
FROM prof JOIN quart q ON q.column_name = prof.column_name WHERE inferred_type = 'number'""")
def p9_outliers(spark, sf):
    df, cols = view(spark, sf, "dirty_hr"), COLUMNS["dirty_hr"]
    values = stage(histogram.numeric_values(histogram.value_histogram(df, cols), cols, of_type(df, cols, "number")), "p9")
    return outliers(spark, values, statistics(values, median=False)).drop("median")


def outliers(spark, values, stats):
    bounds = spark.createDataFrame([(c, s.n, s.q1, s.median, s.q3) for c, s in stats.items()],
                                   "column_name string, n bigint, q1 double, median double, q3 double")
    return profile.number_issues(values, stats).drop("negative_count").join(F.broadcast(bounds), "column_name")


NUMERIC = {"events": ["value", "user_id"],
           "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_partkey", "l_suppkey"]}


def quartile_sql(t):
    return " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, n, q1, median, q3, (SELECT count(*) FROM {t} WHERE q3 <> q1 AND ({c} < q1 - 1.5 * (q3 - q1)
  OR {c} > q3 + 1.5 * (q3 - q1))) AS outlier_count
FROM (SELECT any_value(n) AS n, max(x) FILTER (i = n // 4) AS q1, max(x) FILTER (i = n // 2) AS median,
    max(x) FILTER (i = 3 * n // 4) AS q3 FROM (SELECT CAST({c} AS DOUBLE) AS x,
      row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM {t}))""" for c in NUMERIC[t])


for _t in NUMERIC:
    @query(f"p9_outliers_{_t}", quartile_sql(_t))
    def p9_outliers_table(spark, sf, t=_t):
        values = stage(long_numbers(table(spark, sf, t), {c: F.col(c).cast("double") for c in NUMERIC[t]}), "p9")
        return outliers(spark, values, statistics(values, small=10_000))  # narrows even at test size


@query("p10_full_dup", PROF + "SELECT total_rows, full_duplicates FROM dups")
def p10_full_dup(spark, sf):
    return duplicate_counts(customer(spark, sf), CUSTOMER, "seq").select("total_rows", "full_duplicates")


@query("p11_near_dup", PROF + "SELECT total_rows, near_duplicates FROM dups")
def p11_near_dup(spark, sf):
    return duplicate_counts(customer(spark, sf), CUSTOMER, "seq").select("total_rows", "near_duplicates")


@query("p12_primary_key", profile_ctes("dirty_product") + "SELECT column_name AS primary_key FROM pk")
def p12_primary_key(spark, sf):
    return profile.primary_key(profile.column_profile(view(spark, sf, "dirty_product"), COLUMNS["dirty_product"]))


ANY_PK_SQL = f"""
, along AS ({unpivot_sql('dirty_product', COLUMNS['dirty_product'])})
SELECT column_name AS primary_key FROM (SELECT pos, column_name, count(*) AS n, count(DISTINCT v) AS d
  FROM along WHERE v <> '' GROUP BY 1, 2) WHERE n = d
ORDER BY CASE WHEN regexp_matches(lower(column_name), '{names_sql(constants.ANY_FILE_KEY_WORDS)}') THEN 0 ELSE 1 END, pos
LIMIT 1"""


@query("p13_primary_key_any", ctes("dirty_product") + ANY_PK_SQL)
def p13_primary_key_any(spark, sf):
    from tablewright.plans import anyfile

    return anyfile.primary_key(view(spark, sf, "dirty_product"), COLUMNS["dirty_product"])


@query("p14_issues", PROF + "SELECT column_name, issue, severity, n AS count, message FROM found")
def p14_issues(spark, sf):
    return report(spark, sf).issues_table(spark)


@query("p14_issues_hr", PROF_HR + "SELECT column_name, issue, severity, n AS count, message FROM found")
def p14_issues_hr(spark, sf):
    return report(spark, sf, "dirty_hr").issues_table(spark)


@query("p15_suggestions", PROF + "SELECT column_name, position, action, label, is_default FROM sugg")
def p15_suggestions(spark, sf):
    return report(spark, sf).suggestions_table(spark)


@query("p16_global_rules", PROF + """
SELECT 'remove_full_duplicates' AS rule, 'Remove ' || full_duplicates || ' fully duplicate rows' AS label,
  CAST(1 AS INT) AS is_default, CAST(NULL AS VARCHAR) AS param FROM dups WHERE full_duplicates > 0
UNION ALL SELECT 'remove_near_duplicates', 'Remove ' || near_duplicates ||
  ' near-duplicate rows (differ only by case/whitespace)', 0, NULL FROM dups WHERE near_duplicates > 0
UNION ALL SELECT 'dedupe_by_pk', 'Deduplicate by ''' || column_name || ''' (keep first occurrence)', 1, column_name FROM pk""")
def p16_global_rules(spark, sf):
    return report(spark, sf).rules_table(spark)


HEALTH_SQL = """, tot AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(round(completeness * 10)) AS BIGINT) AS tenths,
  (SELECT count(*) FROM found) AS issues, (SELECT count(DISTINCT column_name) FROM found) AS affected,
  count(*) FILTER (sensitivity = 'PII') AS pii, count(*) FILTER (sensitivity = 'Financial') AS fin,
  count(*) FILTER (sensitivity = 'Public') AS pub, count(*) FILTER (sensitivity = 'Internal') AS internal FROM prof)
SELECT (SELECT total_rows FROM dups) AS total_rows, n AS total_cols, issues AS total_issues, affected AS affected_cols,
  n - affected AS clean_cols, CAST((tenths * 2 + n) // (2 * n) AS DOUBLE) / 10 AS avg_completeness,
  CAST((20 * (6 * tenths + 40 * greatest(0, 100 * n - 8 * issues)) + 100 * n) // (200 * n) AS DOUBLE) / 10 AS health_score,
  pii AS pii_columns, pii AS sens_pii, fin AS sens_financial, pub AS sens_public, internal AS sens_internal FROM tot"""


@query("p17_health", PROF + HEALTH_SQL)
def p17_health(spark, sf):
    return report(spark, sf).stats_table(spark)


@query("p17_health_hr", PROF_HR + HEALTH_SQL)
def p17_health_hr(spark, sf):
    return report(spark, sf, "dirty_hr").stats_table(spark)


@query("p18_samples", PROF + """SELECT column_name, s AS value, CAST(rank AS INT) AS rank FROM (
  SELECT column_name, s, row_number() OVER (PARTITION BY column_name ORDER BY s) AS rank
  FROM (SELECT DISTINCT column_name, s FROM nb)) WHERE rank <= 5""")
def p18_samples(spark, sf):
    df = customer(spark, sf)
    hist = stage(histogram.value_histogram(df, CUSTOMER), "p18")
    return histogram.samples(hist, df, CUSTOMER, 5).select("column_name", "value", "rank")


@query("p18_preview", ctes("dirty_customer") + "SELECT * FROM dirty_customer ORDER BY seq LIMIT 5")
def p18_preview(spark, sf):
    return profile.preview(customer(spark, sf), "seq")
