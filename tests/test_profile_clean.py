"""Profiles and cleaning of a small hand-made table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import q_clean
from tablewright.operators import cells, dedupe
from tablewright.plans import anyfile, clean, profile, quality
from tablewright.session import scratch_path

TABLE = {
    "id": ["1", "2", "2", "3", "", "", "4", "5", "6", "7"],
    "name": ["Ann ", "bob", "bob", "BOB", "Cy", "Cy", "-", "Dee", "Eve", "Flo"],
    "amount": ["10", "20", "20", "-5", "30", "30", "N/A", "25", "15", "9000"],
    "joined": ["2020-01-01", "02/03/2020", "02/03/2020", "2020-05-06", "2020-01-09", "2020-01-09", "", "2020-02-02",
               "2020-03-03", "2020-04-04"],
}
COLS = list(TABLE)


@pytest.fixture(scope="module")
def table(make):
    return make(TABLE)


@pytest.fixture(scope="module")
def report(table):
    return profile.analyze(table, COLS, "seq")


def test_columns(report):
    by = {c.name: c for c in report.columns}
    assert [by[c].inferred_type for c in COLS] == ["number", "categorical", "number", "date"]
    assert [by[c].null_count for c in COLS] == [2, 1, 1, 1]
    assert [by[c].unique_count for c in COLS] == [7, 7, 7, 7]
    assert by["name"].whitespace_count == 1
    assert by["name"].case_issues == 1  # BOB against bob, bob
    assert by["joined"].date_format == "%Y-%m-%d" and by["joined"].format_issues == 2
    # 9 numbers: -5 10 15 20 20 25 30 30 9000, quartiles 15 and 30
    assert by["amount"].outlier_count == 1 and by["amount"].negative_count == 1
    assert by["name"].samples == ["Ann", "BOB", "Cy", "Dee", "Eve"]


def test_table_facts(report):
    assert (report.total_rows, report.full_duplicates, report.near_duplicates) == (10, 2, 0)
    assert report.primary_key is None
    assert [r["rule"] for r in report.global_rules] == ["remove_full_duplicates"]
    assert report.stats["pii_columns"] == 1
    assert report.default_rules()["columns"] == {
        "id": {"action": "fill_missing_mean"}, "name": {"action": "trim_whitespace"},
        "amount": {"action": "fill_missing_mean"}, "joined": {"action": "standardize_date_iso"}}


def test_order_and_layout_do_not_matter(table, report):
    again = profile.analyze(table.orderBy(F.rand(3)).repartition(7), COLS, "seq")
    assert again == report


def test_long_texts_profile_like_short_ones(make):
    long = "Long text " * 20
    df = make({"t": [long, long.upper(), " " + long, "short", None]})
    col = profile.analyze(df, ["t"], "seq").columns[0]
    assert (col.null_count, col.unique_count, col.case_issues) == (1, 3, 1)
    assert set(col.samples) == {long.strip(), long.strip().upper(), "short"}


def test_sparse_column_is_typed_from_its_own_first_values(make):
    n = 3000
    df = make({"a": [str(i) for i in range(n)], "b": [f"{i}.5" if i % 500 == 499 else "" for i in range(n)]})
    assert [c.inferred_type for c in profile.analyze(df, ["a", "b"], "seq", samples=0).columns] == ["number", "number"]


@pytest.mark.parametrize("as_struct", [False, True])
def test_leading_rows_bound_the_order_first(spark, as_struct):
    df = spark.range(0, 5000, 1, 10).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("a"))
    if as_struct:
        df = df.withColumn("seq", F.struct(F.lit("f").alias("file"), F.col("seq").alias("row")))
    head = cells.head_rows(df, "seq", 200)
    assert "seq" in head.columns and [r["a"] for r in head.collect()] == [str(i) for i in range(200)]
    assert "Filter" in head._sc._jvm.PythonSQLUtils.explainString(head._jdf.queryExecution(), "simple")


def test_empty_table(make):
    with pytest.raises(ValueError):
        profile.analyze(make({"a": ["x"]}).limit(0), ["a"], "seq")


def run(df, actions, key=None, **table_rules):
    rules = {"global": table_rules, "columns": {c: {"action": a} for c, a in actions.items()}}
    return clean.clean(df, COLS, "seq", rules, key, "2025-01-01")


def test_dedupes(table):
    seqs = lambda df: [r["seq"] for r in df.orderBy("seq").collect()]
    full = dedupe.drop_full_duplicates(table, COLS, "seq")
    assert seqs(full) == [0, 1, 3, 4, 6, 7, 8, 9]
    assert seqs(dedupe.drop_full_duplicates(full, COLS, "seq")) == seqs(full)
    assert set(seqs(dedupe.drop_near_duplicates(table, COLS, "seq"))) <= set(seqs(full))
    assert seqs(dedupe.drop_key_duplicates(table, "id", "seq")) == [0, 1, 3, 4, 5, 6, 7, 8, 9]


def test_digest_keeps_cell_borders(make):
    df = make({"a": ["x", "x1", ""], "b": ["1y", "y", "x1y"]})
    assert dedupe.duplicate_counts(df, ["a", "b"], "seq").first()["full_duplicates"] == 0


def test_change_log_stops_at_a_drop(table):
    result = run(table, {"name": "trim_whitespace", "amount": "drop_rows_negative", "joined": "standardize_date_iso",
                         "id": "drop_rows_missing"})
    log = {(r["column_name"], r["change"]): r["n"] for r in result.change_log().collect()}
    assert log == {("name", "trimmed"): 1, ("amount", "rows_dropped"): 1, ("joined", "dates_normalized"): 2,
                   ("id", "rows_dropped"): 2}
    summary = result.summary().first()
    assert (summary["original_rows"], summary["cleaned_rows"], summary["rows_dropped"]) == (10, 7, 3)
    assert (summary["original_nulls"], summary["cleaned_nulls"]) == (5, 3)


def test_written_log_equals_planned_log(spark, table):
    result = run(table, {"amount": "fill_missing_median", "id": "fill_missing_mode", "name": "standardize_title"},
                 remove_full_duplicates=True)
    path = scratch_path(spark, "test")
    got = result.write(path)
    want = {}
    for r in result.change_log().collect():
        want.setdefault(r["column_name"], {})[r["change"]] = r["n"]
    assert got["changes_by_col"] == want
    assert got["cleaned_rows"] == spark.read.parquet(path).count() == result.summary().first()["cleaned_rows"]


def test_fills_and_caps(make, table):
    out = lambda actions, col: [r[col] for r in run(table, actions).data.orderBy("seq").collect()]
    assert out({"amount": "fill_missing_mean"}, "amount")[6] == "1016.11"
    assert out({"amount": "fill_missing_median"}, "amount")[6] == "20"
    assert out({"name": "fill_missing_mode"}, "name")[6] == "bob"
    assert out({"joined": "fill_missing_today"}, "joined")[6] == "2025-01-01"
    assert out({"amount": "cap_outliers"}, "amount")[9] == "52.5"  # 30 + 1.5 x 15
    assert out({"amount": "abs_values"}, "amount")[3] == "5"
    assert out({"amount": "null_negative"}, "amount")[3] is None
    assert len(out({"amount": "drop_outliers"}, "amount")) == 9
    assert out({"amount": "keep_missing", "gone": "trim_whitespace"}, "amount")[6] is None


def test_bounds_on_half_a_cent_are_rounded_as_in_sql(make):
    quartiles = [(n * 12347 % 30_000_000 / 100, n * 7919 % 50_000_000 / 100 + 0.01) for n in range(2000)]
    bounds = [x for q1, reach in quartiles for q3 in [q1 + reach] for x in (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    want = duckdb.sql(f"SELECT {q_clean.cents('x')} FROM (SELECT unnest([{', '.join(repr(str(x)) + '::DOUBLE' for x in bounds)}]) AS x)").fetchall()
    assert [clean.cents_text(x) for x in bounds] == [r[0] for r in want]
    assert (clean.cents_text(1e300), clean.cents_text(float("nan"))) == ("1e+300", "nan")


def test_key_duplicates_after_full_ones(table):
    got = run(table, {}, key="id", remove_full_duplicates=True, dedupe_by_pk=True)
    assert [r["seq"] for r in got.data.orderBy("seq").collect()] == [0, 1, 3, 4, 6, 7, 8, 9]


def test_any_shape(make):
    df = make({"ref": ["a", "b", None, "c"], "grade": ["x", "y", "x", "x"], "at": ["01.02.2020", "", "", ""]})
    shape = anyfile.detect(df, ["ref", "grade", "at"], "seq")
    assert (shape.key, shape.date_cols, shape.storage["ref"]) == ("ref", ["at"], "TEXT")
    curated = anyfile.cleanse(df, shape, "seq", "2025-01-01 00:00:00")
    assert [tuple(r)[1:4] for r in curated.orderBy("seq").collect()] == [
        ("a", "x", "2020-02-01"), ("b", "y", None), ("c", "x", None)]
    assert tuple(anyfile.cleanse_report(df, shape, "seq").first()) == (4, 3, 1, 2)
    top = anyfile.value_distribution(curated, shape, "seq").collect()
    assert [(r["column_name"], r["value"], r["n"]) for r in top] == [("ref", "a", 1), ("ref", "b", 1), ("ref", "c", 1)]


def test_a_given_key_may_repeat(make):
    df = make({"ref": ["a", "b", " a", "", "b"], "grade": ["x", "y", "x", "x", ""]})
    assert anyfile.detect(df, ["ref", "grade"], "seq").key is None
    shape = anyfile.detect(df, ["ref", "grade"], "seq", "ref")
    curated = anyfile.cleanse(df, shape, "seq", "2025-01-01 00:00:00")
    assert [tuple(r)[1:3] for r in curated.orderBy("seq").collect()] == [("a", "x"), ("b", "y")]
    assert tuple(anyfile.cleanse_report(df, shape, "seq").first()) == (5, 2, 3, 0)


def test_scores(make):
    df = make({"amount": ["1", "", "-1", "x"], "status": ["a", "a", "", None]})
    got = quality.scores(df, ["amount", "status"], quality.business_rule("transaction_logs"), {"amount": float}).first()
    assert (got["completeness"], got["uniqueness"], got["accuracy"], got["consistency"]) == (62.5, 100.0, 50.0, 50.0)
    assert got["overall"] == 68.75
    empty = quality.scores(df.limit(0), ["amount", "status"]).first()
    assert empty["overall"] == 0.0 and empty["timeliness"] == 0.0


def test_timeliness(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    start = at("2025-01-01 00:00:00")
    got = [spark.range(1).select(quality.timeliness(start, at(f"2025-01-01 {t}"))).first()[0]
           for t in ("00:09:59", "00:10:00", "00:11:00", "00:10:30", "03:00:00")]
    assert got == [100.0, 100.0, 98.0, 99.0, 0.0]
