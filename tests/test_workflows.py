"""Whole runs over small files."""

from tablewright import workflows
from tablewright.sources import runs


def test_clean_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,city\n1, Rome\n2,rome\n2,rome\n3,Oslo\n4,Bern\n5,n/a\n")
    got = workflows.clean_file(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"), runs=str(tmp_path / "runs"))
    assert (got["original_rows"], got["cleaned_rows"], got["cleaned_nulls"]) == (6, 5, 1)
    assert got["changes_by_col"] == {"city": {"trimmed": 1}}
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "1,Rome,OK" in text and "5,,POOR" in text
    assert runs.latest_runs(spark, str(tmp_path / "runs")).first()["rows"] == 5


def test_curate_file_twice(spark, tmp_path):
    (tmp_path / "My Data.csv").write_text("ref,grade,at\na,x,01.02.2020\na,y,\n,x,\nb,x,2020-03-01\nc,y,\n")
    for _ in range(2):
        got = workflows.curate_file(spark, str(tmp_path / "My Data.csv"), str(tmp_path / "zone"))
    # No column named like a key is unique; ``at`` is, among its given values,
    # so rows without it are dropped.
    assert (got["raw_table"], got["raw_rows"], got["primary_key"]) == ("raw_my_data", 5, "at")
    assert (got["curated_rows"], got["dupes_removed"]) == (2, 3)
    catalog = spark.read.parquet(str(tmp_path / "zone" / "governance_catalog"))
    assert catalog.count() == 3
    assert spark.read.parquet(str(tmp_path / "zone" / "curated_my_data")).count() == 2


def test_warehouse_with_missing_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "customer_profiles.csv").write_text(
        "customer_id,full_name,email,phone,dob,address,city,country,account_type,created_at\n"
        "C1,Ann,a@x.org,1,1990-01-01,s,t,US,Gold,2020-01-01\nC1,Ann,a@x.org,1,1990-01-01,s,t,US,Gold,2020-01-01\n"
        "C2,Bob,b@x.org,,,,,,,\n")
    (tmp_path / "in" / "transaction_logs.csv").write_text(
        "txn_id,customer_id,amount,currency,txn_date,txn_type,merchant,status,account_number,card_last4\n"
        "T1,C1,20000,EUR,2024-05-01,P,m,Completed,1,2\nT2,C1,5,EUR,2024-01-01,P,m,Completed,1,2\n"
        "T3,C2,9,USD,2024-05-02,P,m,Completed,1,2\n")
    got = workflows.run_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "zone"), str(tmp_path / "runs"), "2025-01-01")
    assert (got["total_raw_rows"], got["total_curated_rows"], got["poor_quality_rows"]) == (6, 5, 1)
    assert got["loaded"] == {"cons_active_customers": 1, "cons_high_value_transactions": 1}
    assert set(got["quality_scores"]) == {"curated_customer_profiles", "curated_transaction_logs", "_aggregate"}
    assert runs.latest_runs(spark, str(tmp_path / "runs")).first()["rows"] == 5
    steps = spark.read.json(str(tmp_path / "runs_steps"))
    assert {r["step"]: r["status"] for r in steps.collect()}["ingest"] == "SUCCESS" and steps.count() == 5
    kinds = dict(spark.read.parquet(str(tmp_path / "zone" / "curated_transaction_logs")).dtypes)
    assert (kinds["amount"], kinds["txn_id"], kinds["amount_usd"]) == ("double", "string", "double")


def test_source_without_all_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "hr_records.csv").write_text("emp_id,salary,seq\nE1,10.5,x\nE2,,y\n")
    sources = {"hr_records.csv": "hr_records"}
    got = workflows.run_warehouse(spark, str(tmp_path / "in"), str(tmp_path / "zone"), as_of="2025-01-01", sources=sources)
    assert got["total_curated_rows"] == 2
    rows = spark.read.parquet(str(tmp_path / "zone" / "curated_hr_records")).orderBy("emp_id").collect()
    assert [(r["emp_id"], r["salary"], r["department"], r["is_active"]) for r in rows] == [("E1", 10.5, None, None), ("E2", None, None, None)]


def test_cleaned_table_keeps_every_cell(spark, tmp_path):
    # the leading cells are whole; a later one is a fraction, a text, beyond 64 bits
    rows = [(i, i, i, i, "") for i in range(30)] + [(30, 2.5, "XL", 10 ** 20, "")]
    (tmp_path / "my sizes.csv").write_text("id,a,b,c,d\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    got = workflows.clean_file(spark, str(tmp_path / "my sizes.csv"), str(tmp_path / "out"), {"columns": {}}, zone=str(tmp_path / "zone"))
    assert got["curated_table"] == "curated_my_sizes"
    assert got["col_types"] == {"id": "INTEGER", "a": "REAL", "b": "TEXT", "c": "REAL", "d": "TEXT"}
    table = spark.read.parquet(str(tmp_path / "zone" / "curated_my_sizes"))
    assert dict(table.dtypes) == {"id": "bigint", "a": "double", "b": "string", "c": "double", "d": "string", "_quality_flag": "string"}
    assert tuple(table.filter("id = 30").first())[1:4] == (2.5, "XL", 1e20) and table.count() == 31


def test_file_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id;x y\n1; a\n2;b\n")
    (tmp_path / "in" / "b.csv").write_bytes("id,x y\n3,\u00e9\n3,\u00e9\n".encode("cp1252"))
    got = workflows.file_report(spark, str(tmp_path / "in"))
    assert (got["filename"], got["delimiter"], got["encoding"]) == ("in", "semicolon", "utf-8-sig")
    assert [(d["delimiter"], d["encoding"], d["files"]) for d in got["dialects"]] == [("semicolon", "utf-8-sig", 1), ("comma", "cp1252", 1)]
    assert (got["total_rows"], got["total_cols"], got["fully_duplicate_rows"]) == (4, 2, 1)
    assert got["preview_rows"] == [{"id": "1", "x y": " a"}, {"id": "2", "x y": "b"}, {"id": "3", "x y": "\u00e9"}, {"id": "3", "x y": "\u00e9"}]
    assert [c["name"] for c in got["columns"]] == ["id", "x y"] and got["columns"][1]["whitespace_count"] == 1


def test_any_file_scored_by_the_table_it_is_named_like(spark, tmp_path):
    (tmp_path / "transaction_logs.csv").write_text("txn_id,amount,status\nT1,5,ok\nT2,-5,ok\nT3,x,ok\nT4,,ok\n")
    got = workflows.curate_file(spark, str(tmp_path / "transaction_logs.csv"), str(tmp_path / "zone"))["quality_scores"]
    # -5 and x break the rule; of five expected columns two are lacking and two amounts are no numbers
    assert (got["accuracy"], got["consistency"], got["completeness"]) == (50.0, 50.0, 95.83)


def sheet(sheet_id, rows):
    kinds = {str: "str", int: "int", float: "float", type(None): "null"}
    return [(sheet_id, r, c, None if v is None else str(v), kinds[type(v)]) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]


def test_all_sheets_in_one_run(spark):
    a = [["Id", "Size", "size"]] + [[i, x, "s"] for i, x in enumerate([1, 2, None, 9, 9, 9])]
    b = [["Id", "Size", "size"]] + [[7, 100, " t"], [7, 100, " t"], [8, None, "t"], [9, 300, None]]
    c = [["sheet_id", "row"], ["x", " y "]]
    cells = spark.createDataFrame(sheet("a", a) + sheet("b", b) + sheet("c", c), "sheet_id string, row int, col int, value string, vtype string")
    merges = spark.createDataFrame([], "sheet_id string, min_row int, max_row int, min_col int, max_col int")
    rules = {"global": {"remove_full_duplicates": True}, "columns": {"Size": {"action": "fill_missing_median"}, "row": {"action": "trim_whitespace"}}}
    runs, facts = workflows.clean_sheets(cells, merges, rules)
    assert [r.table.names for r in runs] == [["Id", "Size", "size_2"], ["sheet_id", "row"]] and facts.count() == 3
    got = sorted(map(tuple, runs[0].result.data.collect()))
    assert [r[:4] for r in got] == [("a", i + 2, str(i), x) for i, x in enumerate(["1", "2", "9", "9", "9", "9"])] + [
        ("b", 2, "7", "100"), ("b", 4, "8", "300"), ("b", 5, "9", "300")]
    assert sorted(map(tuple, runs[0].result.change_log().collect())) == [("a", "Size", "filled", 1), ("b", "Size", "filled", 1)]
    assert [tuple(r)[:4] for r in runs[1].result.data.collect()] == [("c", 2, "x", "y")]
    assert runs[1].table.sheet == "sheet_id_" and runs[1].report.total_rows == 1
    assert workflows.clean_sheets(cells.limit(0), merges)[0] == []
    by_default, _ = workflows.clean_sheets(cells, merges)
    assert sum(r.result.data.count() for r in by_default) == 10
