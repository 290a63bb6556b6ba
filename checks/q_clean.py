"""Cleaning rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import workflows
from tablewright.operators import dedupe
from tablewright.plans import clean as cleaning
from tablewright.plans import profile
from tablewright.session import scratch_path
from tablewright.sources import delimited

from . import constants
from . import sqltext as q
from .base import AS_OF, query
from .q_functions import unpivot_sql
from .q_profile import PROF, profile_parts, report
from .views import COLUMNS, ctes, table, view

ACTIONS = [a for a in dict.fromkeys(row[2] for row in constants.ACTIONS) if not a.startswith("keep")]
CHANGE = {"trim_whitespace": "trimmed", "standardize_lower": "case_normalized", "standardize_upper": "case_normalized",
          "standardize_title": "case_normalized", "standardize_date_iso": "dates_normalized", "null_negative": "nulled",
          "null_invalid_email": "nulled", "cap_outliers": "capped", "abs_values": "abs_applied"}


def cents(x):
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(28,10)), 2) AS DOUBLE) AS VARCHAR)"


def stat(c, what):
    return f'"{what}_{c}"'  # a column of the one-row table strow


def one_row(name, source, cols, values):
    """CTE with one row that holds each value of each column of a table."""
    picks = ", ".join(f"""max({v}) FILTER (column_name = '{c}') AS "{v}_{c}" """ for c in cols for v in values)
    return f"{name} AS MATERIALIZED (SELECT {picks} FROM {source})"


def new_value(c, action):
    v = f'"{c}"'
    num, blank = q.number(v), q.blank(v)
    lo, hi = stat(c, "lo"), stat(c, "hi")
    fill = lambda x: f"CASE WHEN {blank} THEN coalesce({x}, {v}) ELSE {v} END"
    return {
        "trim_whitespace": f"trim({v})",
        "standardize_lower": f"CASE WHEN {blank} THEN {v} ELSE lower(trim({v})) END",
        "standardize_upper": f"CASE WHEN {blank} THEN {v} ELSE upper(trim({v})) END",
        "standardize_title": f"CASE WHEN {blank} THEN {v} ELSE {q.title(f'trim({v})')} END",
        "standardize_date_iso": f"coalesce(strftime({q.date_stamp(v)}, '%Y-%m-%d'), {v})",
        "fill_missing_mean": fill(cents(stat(c, "mean"))),
        "fill_missing_median": fill(stat(c, "median_text")),
        "fill_missing_zero": fill("'0'"),
        "fill_missing_mode": fill(stat(c, "mode")),
        "fill_missing_unknown": fill("'Unknown'"),
        "fill_missing_today": fill(f"'{AS_OF}'"),
        "null_invalid_email": f"CASE WHEN {blank} OR regexp_matches(trim({v}), '{q.EMAIL}') THEN {v} END",
        "cap_outliers": f"CASE WHEN {num} < {lo} THEN {cents(lo)} WHEN {num} > {hi} THEN {cents(hi)} ELSE {v} END",
        "abs_values": f"CASE WHEN {num} < 0 THEN CASE WHEN contains({v}, '.') THEN CAST(abs({num}) AS VARCHAR) "
                      f"ELSE CAST(CAST(abs({num}) AS BIGINT) AS VARCHAR) END ELSE {v} END",
        "null_negative": f"CASE WHEN {num} < 0 THEN NULL ELSE {v} END",
    }.get(action, v)


def drop_test(c, action):
    v = f'"{c}"'
    num = q.number(v)
    return {
        "drop_rows_missing": q.blank(v),
        "drop_rows_invalid_email": f"(NOT {q.blank(v)} AND NOT regexp_matches(trim({v}), '{q.EMAIL}'))",
        "drop_outliers": f"coalesce({num} < {stat(c, 'lo')} OR {num} > {stat(c, 'hi')}, false)",
        "drop_rows_negative": f"coalesce({num} < 0, false)",
    }.get(action, "false")


def change_test(c, action):
    v = f'"{c}"'
    num, blank = q.number(v), q.blank(v)
    iso = f"strftime({q.date_stamp(v)}, '%Y-%m-%d')"
    if action.startswith("fill_"):
        value = {"fill_missing_mean": stat(c, "mean"), "fill_missing_median": stat(c, "median"),
                 "fill_missing_mode": stat(c, "mode")}.get(action, "1")
        return f"({blank} AND {value} IS NOT NULL)"
    if action.startswith("standardize") and action != "standardize_date_iso":
        return f"(NOT {blank})"
    return {
        "trim_whitespace": f"({v} <> trim({v}))",
        "standardize_date_iso": f"coalesce({iso} <> trim({v}), false)",
        "null_invalid_email": drop_test(c, "drop_rows_invalid_email"),
        "cap_outliers": drop_test(c, "drop_outliers"),
        "abs_values": f"coalesce({num} < 0, false)", "null_negative": f"coalesce({num} < 0, false)",
    }.get(action, drop_test(c, action))


def dedupe_parts(v, cols, full, near, pk):
    """CTEs d1, d2, d3: after each table rule."""
    out, src = [], v
    if full:
        out.append(f"d1 AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY {q.text_key(cols)} ORDER BY seq) = 1)")
        src = "d1"
    if near:
        out.append(f"d2 AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY {q.text_key(cols, True)} "
                   "ORDER BY seq) = 1)")
        src = "d2"
    if pk:
        out.append(f"d3 AS (SELECT * FROM {src} QUALIFY trim({pk}) = '' OR row_number() OVER (PARTITION BY trim({pk}) "
                   "ORDER BY seq) = 1)")
        src = "d3"
    out.append(f"dd AS MATERIALIZED (SELECT * FROM {src})")
    return out


def clean_parts(v, cols, actions, full=False, near=False, pk=None):
    """CTEs ``marked`` (new cells, _d, _c<i>) and ``cleaned``.  An action is a
    name, or None for one looked up at run time in ``chosen``."""
    out = dedupe_parts(v, cols, full, near, pk)
    stat_cols = [c for c, a in actions.items() if a is None or a in cleaning.MEAN_ACTIONS + cleaning.MEDIAN_ACTIONS
                 + cleaning.MODE_ACTIONS + cleaning.BAND_ACTIONS] or [cols[0]]
    out.append(f"dnb AS MATERIALIZED (SELECT *, {q.number('v')} AS num FROM ({unpivot_sql('dd', stat_cols)}) "
               f"WHERE NOT {q.blank('v')})")
    out.append("drank AS (SELECT column_name, num, row_number() OVER (PARTITION BY column_name ORDER BY num) - 1 AS i, "
               "count(*) OVER (PARTITION BY column_name) AS n FROM dnb WHERE num IS NOT NULL)")
    out.append("dquart AS (SELECT column_name, any_value(n) AS n, avg(num) AS mean, max(num) FILTER (i = n // 2) AS median, "
               "max(num) FILTER (i = n // 4) AS q1, max(num) FILTER (i = 3 * n // 4) AS q3 FROM drank GROUP BY 1)")
    out.append("dmode AS (SELECT column_name, v AS mode FROM dnb GROUP BY 1, 2 QUALIFY row_number() OVER "
               "(PARTITION BY column_name ORDER BY count(*) DESC, min(seq)) = 1)")
    out.append("""st AS MATERIALIZED (SELECT m.column_name, mode, mean, median, CASE WHEN n >= 8 AND q3 <> q1 THEN q1 - 1.5 * (q3 - q1) END AS lo,
  CASE WHEN n >= 8 AND q3 <> q1 THEN q3 + 1.5 * (q3 - q1) END AS hi,
  CASE WHEN EXISTS (SELECT 1 FROM dnb b WHERE b.column_name = m.column_name AND b.num = median AND NOT contains(b.v, '.'))
    THEN CAST(CAST(median AS BIGINT) AS VARCHAR) ELSE CAST(median AS VARCHAR) END AS median_text
  FROM dmode m LEFT JOIN dquart k ON k.column_name = m.column_name)""")

    facts = ["mean", "median", "median_text", "mode", "lo", "hi"]
    out.append(one_row("strow", "st", stat_cols, facts))
    dynamic = [c for c, a in actions.items() if a is None]
    if dynamic:
        out.append(one_row("actrow", "chosen", dynamic, ["action"]))

    def pick(make, c, default):
        if actions[c] is not None:
            return make(c, actions[c])
        whens = " ".join(f"WHEN '{a}' THEN {make(c, a)}" for a in ACTIONS)
        return f'(CASE "action_{c}" {whens} ELSE {default} END)'

    cells = [f'{pick(new_value, c, chr(34) + c + chr(34))} AS "{c}"' if c in actions else f'"{c}"' for c in cols]
    drops = [f"WHEN {pick(drop_test, c, 'false')} THEN {i}" for i, c in enumerate(actions)]
    flags = [f"{pick(change_test, c, 'false')} AS _c{i}" for i, c in enumerate(actions)]
    dropped = f"CASE {' '.join(drops)} END" if drops else "NULL"
    out.append(f"marked AS MATERIALIZED (SELECT seq, {', '.join(cells)}, {dropped} AS _d"
               + "".join(f", {f}" for f in flags) + f" FROM dd CROSS JOIN strow{' CROSS JOIN actrow' if dynamic else ''})")
    nulls = ", ".join(f"""CASE WHEN NOT {q.blank(f'"{c}"')} THEN "{c}" END AS "{c}" """ for c in cols)
    n = " + ".join(f'CAST("{c}" IS NULL AS INT)' for c in cols)
    out.append(f"kept AS (SELECT seq, {nulls} FROM marked WHERE _d IS NULL)")
    out.append(f"cleaned AS MATERIALIZED (SELECT *, CASE WHEN ({n}) * 10 > {3 * len(cols)} THEN 'POOR' ELSE 'OK' END "
               "AS _quality_flag FROM kept)")
    return ",\n".join(out)


def rule_sql(v, actions, **table_rules):
    return ctes(v) + ",\n" + clean_parts(v, COLUMNS[v], actions, **table_rules) + "\n"


def rules(actions, **table_rules):
    return {"global": table_rules, "columns": {c: {"action": a} for c, a in actions.items()}}


def run(spark, sf, v, actions, key=None, **table_rules):
    return cleaning.clean(view(spark, sf, v), COLUMNS[v], "seq", rules(actions, **table_rules), key, AS_OF)


# --- table rules -------------------------------------------------------------

CUSTOMER = COLUMNS["dirty_customer"]


def dedupe_sql(**table_rules):
    t = {"full": False, "near": False, "pk": None} | table_rules
    return ctes("dirty_customer") + ",\n" + ",\n".join(dedupe_parts("dirty_customer", CUSTOMER, **t)) + "\nSELECT * FROM dd"


@query("c1_full_dedupe", dedupe_sql(full=True))
def c1_full_dedupe(spark, sf):
    return dedupe.drop_full_duplicates(view(spark, sf, "dirty_customer"), CUSTOMER, "seq")


@query("c2_near_dedupe", dedupe_sql(near=True))
def c2_near_dedupe(spark, sf):
    return dedupe.drop_near_duplicates(view(spark, sf, "dirty_customer"), CUSTOMER, "seq")


@query("c3_pk_dedupe", dedupe_sql(pk="customer_id"))
def c3_pk_dedupe(spark, sf):
    return dedupe.drop_key_duplicates(view(spark, sf, "dirty_customer"), "customer_id", "seq")


@query("c3_all_dedupes", dedupe_sql(full=True, near=True, pk="email"))
def c3_all_dedupes(spark, sf):
    return cleaning.deduplicate(
        view(spark, sf, "dirty_customer"), CUSTOMER, "seq",
        {"remove_full_duplicates": True, "remove_near_duplicates": True, "dedupe_by_pk": True}, "email")


STAT_ACTIONS = {"salary": "fill_missing_mean", "performance_score": "fill_missing_median",
                "department": "fill_missing_mode"}


@query("c4_stats", rule_sql("dirty_hr", {c: "cap_outliers" for c in ("salary", "performance_score", "is_active")})
       + f"SELECT column_name, {cents('mean')} AS mean, median_text, mode, lo, hi FROM st")
def c4_stats(spark, sf):
    df = view(spark, sf, "dirty_hr")
    cols = ["salary", "performance_score", "is_active"]
    facts = {}
    for a in ("fill_missing_mean", "fill_missing_median", "fill_missing_mode", "cap_outliers"):
        facts[a] = cleaning.column_facts(df, {c: a for c in cols}, "seq")
    rows = []
    for c in cols:
        band = facts["cap_outliers"][c].band or (None, None)
        rows.append((c, facts["fill_missing_mean"][c].mean, facts["fill_missing_median"][c].median,
                     facts["fill_missing_mode"][c].mode, *band))
    return spark.createDataFrame(
        rows, "column_name string, mean string, median_text string, mode string, lo double, hi double")


# --- one action each ---------------------------------------------------------

SINGLE = {
    "c5_trim": ("dirty_customer", {"full_name": "trim_whitespace"}),
    "c6_lower": ("dirty_customer", {"account_type": "standardize_lower"}),
    "c6_upper": ("dirty_customer", {"country": "standardize_upper"}),
    "c6_title": ("dirty_customer", {"full_name": "standardize_title"}),
    "c7_date_iso": ("dirty_customer", {"dob": "standardize_date_iso"}),
    "c8_fill_mean": ("dirty_hr", {"salary": "fill_missing_mean"}),
    "c8_fill_median": ("dirty_hr", {"salary": "fill_missing_median", "performance_score": "fill_missing_median"}),
    "c8_fill_zero": ("dirty_hr", {"performance_score": "fill_missing_zero"}),
    "c8_fill_mode": ("dirty_hr", {"department": "fill_missing_mode", "manager_id": "fill_missing_mode"}),
    "c8_fill_unknown": ("dirty_hr", {"department": "fill_missing_unknown"}),
    "c8_fill_today": ("dirty_hr", {"join_date": "fill_missing_today"}),
    "c9_drop_missing": ("dirty_customer", {"phone": "drop_rows_missing"}),
    "c10_cap": ("dirty_txn", {"amount": "cap_outliers"}),
    "c10_drop": ("dirty_txn", {"amount": "drop_outliers"}),
    "c11_email_drop": ("dirty_customer", {"email": "drop_rows_invalid_email"}),
    "c11_email_null": ("dirty_customer", {"email": "null_invalid_email"}),
    "c12_abs": ("dirty_txn", {"amount": "abs_values"}),
    "c13_drop_negative": ("dirty_txn", {"amount": "drop_rows_negative"}),
    "c14_null_negative": ("dirty_txn", {"amount": "null_negative"}),
    "c15_keep": ("dirty_customer", {"phone": "keep_missing", "email": "keep_outliers", "absent": "trim_whitespace"}),
}

for _name, (_v, _actions) in SINGLE.items():
    _known = {c: a for c, a in _actions.items() if c in COLUMNS[_v]}

    @query(_name, rule_sql(_v, _known) + "SELECT * FROM cleaned")
    def single(spark, sf, v=_v, actions=_actions):
        return run(spark, sf, v, actions).data


# --- several rules: log, summary, result -------------------------------------

MIXED = {"email": "drop_rows_invalid_email", "full_name": "trim_whitespace", "dob": "standardize_date_iso",
         "phone": "drop_rows_missing", "account_type": "standardize_title", "created_at": "fill_missing_today",
         "city": "fill_missing_mode"}
MIXED_SQL = rule_sql("dirty_customer", MIXED, full=True, near=True, pk="customer_id")
TABLE_RULES = {"remove_full_duplicates": True, "remove_near_duplicates": True, "dedupe_by_pk": True}


def mixed(spark, sf):
    return run(spark, sf, "dirty_customer", MIXED, "customer_id", **TABLE_RULES)


def log_sql(actions):
    rows = []
    for i, (c, a) in enumerate(actions.items()):
        kind = CHANGE.get(a, "filled" if a.startswith("fill_") else "rows_dropped")
        seen = f"_d = {i}" if kind == "rows_dropped" else f"(_d IS NULL OR _d > {i})"
        rows.append(f"SELECT '{c}' AS column_name, '{kind}' AS change, count(*) AS n FROM marked WHERE _c{i} AND {seen}")
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE n > 0"


@query("c16_change_log", MIXED_SQL + log_sql(MIXED))
def c16_change_log(spark, sf):
    return mixed(spark, sf).change_log()


TXN_MIXED = {"amount": "abs_values", "merchant": "fill_missing_mode", "status": "drop_rows_missing",
             "txn_date": "standardize_date_iso"}


@query("c16_change_log_txn", rule_sql("dirty_txn", TXN_MIXED) + log_sql(TXN_MIXED))
def c16_change_log_txn(spark, sf):
    return run(spark, sf, "dirty_txn", TXN_MIXED).change_log()


SUMMARY_SQL = f"""SELECT a AS original_rows, c AS cleaned_rows, a - c AS rows_dropped, e AS poor_rows, b AS original_nulls,
  d AS cleaned_nulls, b - d AS nulls_resolved FROM (SELECT
  (SELECT count(*) FROM dirty_customer) AS a,
  (SELECT CAST(sum({' + '.join(f'CAST({q.blank(c)} AS INT)' for c in CUSTOMER)}) AS BIGINT) FROM dirty_customer) AS b,
  (SELECT count(*) FROM cleaned) AS c,
  (SELECT CAST(sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in CUSTOMER)}) AS BIGINT) FROM cleaned) AS d,
  (SELECT count(*) FROM cleaned WHERE _quality_flag = 'POOR') AS e)"""


@query("c17_summary", MIXED_SQL + SUMMARY_SQL)
def c17_summary(spark, sf):
    return mixed(spark, sf).summary()


@query("c18_col_after", MIXED_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {q.pct(f'count({c})', 'count(*)', 1)} AS completeness, count(*) - count({c}) AS null_count "
    "FROM cleaned" for c in CUSTOMER))
def c18_col_after(spark, sf):
    return mixed(spark, sf).column_completeness()


@query("c18_preview", MIXED_SQL + "SELECT * FROM cleaned ORDER BY seq LIMIT 10")
def c18_preview(spark, sf):
    return mixed(spark, sf).preview()


CHOSEN = """chosen AS (SELECT column_name, action FROM sugg QUALIFY row_number() OVER (PARTITION BY column_name
  ORDER BY is_default DESC, position) = 1)"""


@query("c19_default_rules", PROF + ",\n" + CHOSEN + "\nSELECT column_name, action FROM chosen")
def c19_default_rules(spark, sf):
    columns = report(spark, sf).default_rules()["columns"]
    return spark.createDataFrame([(c, r["action"]) for c, r in columns.items()], "column_name string, action string")


def auto_sql(v):
    # The suggested key is unique in the whole table, so removing its
    # duplicates after the full ones changes nothing.
    return (ctes(v) + "," + profile_parts(v, COLUMNS[v]) + ",\n" + CHOSEN + ",\n"
            + clean_parts(v, COLUMNS[v], dict.fromkeys(COLUMNS[v]), full=True) + "\nSELECT * FROM cleaned")


@query("c20_auto_clean", auto_sql("dirty_customer"))
def c20_auto_clean(spark, sf):
    return cleaning.auto_clean(view(spark, sf, "dirty_customer"), CUSTOMER, "seq", AS_OF)[1].data


@query("c20_auto_clean_hr", auto_sql("dirty_hr"))
def c20_auto_clean_hr(spark, sf):
    return cleaning.auto_clean(view(spark, sf, "dirty_hr"), COLUMNS["dirty_hr"], "seq", AS_OF)[1].data


# --- tables cleaned together: statistics and duplicates of each for itself -------------------

def by_currency(actions, **table_rules):
    """CTEs gst (statistics of the amount and the merchant in each currency) and grow (each row with them)."""
    src = "dirty_txn"
    dedupe = ""
    if table_rules.get("near"):
        cells = [c for c in COLUMNS[src] if c != "currency"]
        dedupe = f"gdd AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY currency, {q.text_key(cells, True)} ORDER BY seq) = 1),"
        src = "gdd"
    return ctes("dirty_txn") + f""", {dedupe}
gnum AS (SELECT currency, amount, {q.number('amount')} AS x FROM {src}),
grank AS (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY currency) AS n
  FROM gnum WHERE x IS NOT NULL),
gquart AS (SELECT currency, any_value(n) AS n, avg(x) AS mean, max(x) FILTER (i = n // 2) AS median, max(x) FILTER (i = n // 4) AS q1,
  max(x) FILTER (i = 3 * n // 4) AS q3 FROM grank GROUP BY 1),
gmode AS (SELECT currency, merchant AS mode FROM {src} WHERE NOT {q.blank('merchant')} GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY currency ORDER BY count(*) DESC, min(seq)) = 1),
gst AS MATERIALIZED (SELECT k.currency, mode, mean, CASE WHEN EXISTS (SELECT 1 FROM gnum g WHERE g.currency = k.currency AND g.x = median
    AND NOT contains(g.amount, '.')) THEN CAST(CAST(median AS BIGINT) AS VARCHAR) ELSE CAST(median AS VARCHAR) END AS median_text,
  CASE WHEN n >= 8 AND q3 <> q1 THEN q1 - 1.5 * (q3 - q1) END AS lo, CASE WHEN n >= 8 AND q3 <> q1 THEN q3 + 1.5 * (q3 - q1) END AS hi
  FROM gquart k LEFT JOIN gmode m ON m.currency = k.currency),
grow AS (SELECT t.seq, t.currency, t.amount, t.merchant, {q.number('t.amount')} AS x, s.* EXCLUDE (currency)
  FROM {src} t LEFT JOIN gst s ON s.currency = t.currency)
"""


def together(spark, sf, actions, **table_rules):
    cols = [c for c in COLUMNS["dirty_txn"] if c != "currency"]
    return cleaning.clean(view(spark, sf, "dirty_txn"), cols, "seq", rules(actions, **table_rules), None, AS_OF, by=["currency"])


def exact_cents(x):
    """``cents`` of all digits of a double, for bounds that end on half a cent."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), 2) AS DOUBLE) AS VARCHAR)"


def given(c):
    return f"CASE WHEN NOT {q.blank(c)} THEN {c} END"


@query("c10_cap_groups", by_currency({}) + f"""SELECT seq, currency, CASE WHEN x < lo THEN {exact_cents('lo')} WHEN x > hi THEN {exact_cents('hi')}
  ELSE {given('amount')} END AS amount FROM grow""")
def c10_cap_groups(spark, sf):
    """Amounts capped at the bounds of their currency."""
    return together(spark, sf, {"amount": "cap_outliers"}).data.select("seq", "currency", "amount")


@query("c8_fill_groups", by_currency({}, near=True) + f"""SELECT seq, currency, coalesce({given('amount')}, median_text) AS amount,
  coalesce({given('merchant')}, mode) AS merchant FROM grow""")
def c8_fill_groups(spark, sf):
    """Medians and commonest values of each currency, after near duplicates within it are gone."""
    found = together(spark, sf, {"amount": "fill_missing_median", "merchant": "fill_missing_mode"}, remove_near_duplicates=True)
    return found.data.select("seq", "currency", "amount", "merchant")


@query("c16_log_groups", by_currency({}) + """SELECT currency, 'amount' AS column_name, 'capped' AS change, count(*) AS n FROM grow
WHERE x < lo OR x > hi GROUP BY 1""")
def c16_log_groups(spark, sf):
    return together(spark, sf, {"amount": "cap_outliers"}).change_log()


# The size of a part is text in a few rows, the code a fraction: neither is lost in the stored types.
STORED_SQL = """SELECT p_partkey AS id, trim(p_name) AS "name", CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
  CASE WHEN p_partkey % 150 = 149 THEN 'XL' ELSE CAST(p_size AS VARCHAR) END AS size,
  CASE WHEN p_partkey % 150 = 148 THEN 2.5::DOUBLE ELSE p_size::DOUBLE END AS code FROM part"""


@query("s9_clean_table", STORED_SQL)
def s9_clean_table(spark, sf):
    """A file cleaned into a table, in the types that its cells fit."""
    part = table(spark, sf, "part").orderBy("p_partkey")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    path, zone = f"{scratch_path(spark, 's9t')}/parts.csv", scratch_path(spark, "s9t-zone")
    delimited.write_delimited(part.select(
        key.alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        F.when(key % 150 == 149, "XL").otherwise(size).alias("size"), F.when(key % 150 == 148, "2.5").otherwise(size).alias("code")), path)
    done = workflows.clean_file(spark, path, scratch_path(spark, "s9t-out"), rules({"name": "trim_whitespace"}), zone=zone)
    return spark.read.parquet(f"{zone}/{done['curated_table']}").drop("_quality_flag")
