"""Files, run history and worksheets from hand-written inputs."""

import warnings

import pytest
from pyspark.sql import functions as F

from tablewright.operators import sheets
from tablewright.session import scratch_path
from tablewright.sources import delimited, detect, ingest, runs


def read(spark, path, **kw):
    df = delimited.read_delimited(spark, str(path), **kw)
    return df.columns[1:], [tuple(r)[1:] for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    f = tmp_path / "a.csv"
    f.write_text("\n".join(sep.join(r) for r in [["id", "note"], ["1", '"x, y; z|w"'], ["2", ""], [], ["3", "c"]]))
    assert read(spark, f) == (["id", "note"], [("1", "x, y; z|w"), ("2", ""), ("3", "c")])


def test_short_long_and_repeated(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('id,a,A,\n1\n2,x,y,z,extra\n3," p ","say ""hi""\nthere",q\n')
    assert read(spark, f) == (["id", "a", "A_2", "col_4"], [
        ("1", "", "", ""), ("2", "x", "y", "z"), ("3", " p ", 'say "hi"\nthere', "q")])


def test_header_only_and_empty(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert read(spark, tmp_path / "h.csv") == (["a", "b"], [])
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        read(spark, tmp_path / "e.csv")


def test_encodings(spark, tmp_path):
    line = "id,café €\n1,größe “x”\n"
    cases = {
        "utf8": (line.encode(), "utf-8-sig"), "bom": (line.encode("utf-8-sig"), "utf-8-sig"),
        "u16": (line.encode("utf-16"), "utf-16"), "odd": (line.encode("cp1252"), "cp1252"),
        "even": (line.encode("cp1252") + b"\n", "cp1252"), "latin": (b"id,x\n1,\x81\xe9\n", "iso-8859-1"),
        "split": (b"a,b\n" + b"1" * (65_536 - 5) + "é".encode() + b",2\n", "utf-8-sig"),
    }
    for name, (data, _) in cases.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1][:-4]: r["encoding"] for r in detect.detect(spark, str(tmp_path)).collect()}
    assert got == {name: enc for name, (_, enc) in cases.items()}
    for name in ("utf8", "bom", "u16", "odd"):
        assert read(spark, tmp_path / f"{name}.csv") == (["id", "café €"], [("1", "größe “x”")]), name


def test_ingest_skips_missing_and_keeps_empty(spark, tmp_path):
    folder, zone = tmp_path / "in", tmp_path / "zone"
    folder.mkdir()
    (folder / "hr_records.csv").write_text("emp_id,salary\nE1,5\nE2,\n")
    (folder / "audit_trail.csv").write_text("audit_id\n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        counts = ingest.ingest(spark, str(folder), str(zone), "2025-01-01 00:00:00")
    assert counts == {"raw_hr_records": 2, "raw_audit_trail": 0}
    assert sum("not found" in str(w.message) for w in seen) == 4
    again = ingest.ingest(spark, str(folder), str(zone), "2025-01-01 00:00:00", {"hr_records.csv": "hr_records"})
    rows = spark.read.parquet(f"{zone}/raw_hr_records")
    assert again["raw_hr_records"] == rows.count() == 2
    assert rows.select("_source_file").distinct().collect()[0][0] == "hr_records.csv"


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    records = [(f"RUN_{i:02d}", i, None if i % 2 else i - 1) for i in range(25)]
    runs.append_runs(spark.createDataFrame(records, "run_id string, original_rows bigint, cleaned_rows bigint"), path)
    (tmp_path / "runs" / "broken.json").write_text('{"run_id": \n')
    got = runs.latest_runs(spark, path).collect()
    assert [r["run_id"] for r in got] == [f"RUN_{i:02d}" for i in range(24, 4, -1)]
    assert (got[0]["rows"], got[1]["rows"], got[0]["status"], got[0]["filename"]) == (23, 23, "SUCCESS", "—")
    assert runs.get_run(spark, path, "RUN_07").count() == 1 and runs.get_run(spark, path, "nope").isEmpty()


def grid(spark, rows, merges=()):
    cells = [("s", r, c, None if v is None else str(v), {str: "str", int: "int", float: "float", type(None): "null"}[type(v)])
             for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    return (spark.createDataFrame(cells, "sheet_id string, row int, col int, value string, vtype string"),
            spark.createDataFrame([("s", *m) for m in merges] or [("other", 1, 1, 1, 1)],
                                  "sheet_id string, min_row int, max_row int, min_col int, max_col int"))


def test_two_level_header_and_stacked_tables(spark):
    rows = [["Q1", None, "Note"], ["Rev", "Cost", "note"], [1.0, 2.5, "a"], [None, "", " "], [3, 4, "b"], [5, None, "c"],
            [None, None, None], [6, 7, "d"], [8, 9, "e"]]
    cells, merges = grid(spark, rows, [(1, 1, 1, 2), (5, 6, 2, 2)])
    got, facts = sheets.read_sheets(cells, merges)
    assert [(r["row"], dict(r["record"])) for r in got.orderBy("row").collect()] == [
        (5, {"Q1 Rev": "3", "Q1 Cost": "4", "note": "b"}), (6, {"Q1 Rev": "5", "Q1 Cost": "4", "note": "c"})]
    assert tuple(facts.first()) == ("s", 2, True, 3)


def test_no_merge_no_second_level(spark):
    got, facts = sheets.read_sheets(*grid(spark, [["a", "a"], ["x", "y"], ["z", None]]))
    assert [dict(r["record"]) for r in got.orderBy("row").collect()] == [{"a": "x", "a_2": "y"}, {"a": "z", "a_2": ""}]
    assert tuple(facts.filter("sheet_id = 's'").first()) == ("s", 0, False, 1)


def test_blocks_across_buckets(spark):
    rows = [2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 17]
    df = spark.createDataFrame([("s", r) for r in rows], "sheet_id string, row int")
    got = {r["row"]: r["block"] for r in sheets.blocks(df, rows_per_bucket=3).collect()}
    assert got == {r: 2 if r <= 10 else 12 if r == 12 else 15 for r in rows}


def test_cell_text(spark):
    rows = [("5.0", "float", "5"), ("5.5", "float", "5.5"), ("2024-01-01 00:00:00", "datetime", "2024-01-01"),
            ("2024-01-01T10:00:00", "datetime", "2024-01-01 10:00:00"), (None, "null", ""), ("5.0", "str", "5.0")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, t string, want string")
    for r in df.select(sheets.cell_text(df.v, df.t).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_files_that_cannot_be_split_hold_few_rows(spark, monkeypatch):
    monkeypatch.setattr(delimited, "WHOLE_ROWS", 100)
    df = spark.range(1000).select(F.col("id").cast("string").alias("cl\u00e9"), F.concat(F.lit("a\nb "), "id").alias("text")).coalesce(1)
    path = scratch_path(spark, "whole")
    for name, charset, files in (("wide", "UTF-16", 10), ("narrow", "UTF-8", 1)):
        delimited.write_delimited(df, f"{path}/{name}", encoding=charset)
        rows = delimited.read_delimited(spark, f"{path}/{name}")
        assert rows.select("seq.file").distinct().count() == files
        assert sorted(tuple(r) for r in rows.drop("seq").collect()) == sorted(tuple(r) for r in df.collect())
