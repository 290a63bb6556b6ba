"""Columns of any name, sessions without a shared folder, folders of mixed files."""

import pytest

from tablewright import session
from tablewright.functions import naming
from tablewright.plans import clean, profile
from tablewright.sources import delimited

AWKWARD = ["seq_", "_key", "_rank", "_c0", "_s0", "_dropped_by", "a`b", "a.b", "_quality_flag"]


@pytest.mark.parametrize("name", AWKWARD)
def test_cleaning_beside_any_column(spark, name):
    rows = [(1, "x ", "k"), (2, "x", "k"), (3, "y", "")]
    df = spark.createDataFrame(rows, ["seq", name, "other"])
    rules = {"global": {"remove_near_duplicates": True, "dedupe_by_pk": True},
             "columns": {name: {"action": "trim_whitespace"}, "other": {"action": "fill_missing_unknown"}}}
    got = clean.clean(df, [name, "other"], "seq", rules, "other").data.orderBy("seq").collect()
    assert [(r["seq"], r["other"]) for r in got] == [(1, "k"), (3, "Unknown")]
    if name != "_quality_flag":
        assert [r[name] for r in got] == ["x", "y"]
        assert [c.name for c in profile.analyze(df, [name, "other"], "seq").columns] == [name, "other"]


def test_shared_folder_must_be_named(spark, monkeypatch):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Other:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_folder(Other())
    Other.conf = Conf({"spark.master": "local-cluster[2,1,1024]"})
    with pytest.raises(ValueError):
        session.shared_folder(Other())
    Other.conf = Conf({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y"})
    assert session.shared_folder(Other()) == "hdfs://x/y"


def test_folder_of_different_files(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,name,seq\n1,Ann,a\n", encoding="utf-8")
    (tmp_path / "2.csv").write_text("name;id;seq\nBob;2;b\n", encoding="utf-8")
    (tmp_path / "3.csv").write_bytes("id,name,seq\n3,Zoë,c\n".encode("cp1252"))
    (tmp_path / "4.csv").write_text('"na\nme"|id\nx|4|5|6\n', encoding="utf-8")
    (tmp_path / "5.csv").write_text("")
    rows = delimited.read_delimited(spark, str(tmp_path))
    assert rows.columns == ["seq_", "id", "name", "seq", "na\nme"]
    got = [tuple(r)[1:] for r in rows.orderBy("seq_").collect()]
    assert got == [("1", "Ann", "a", None), ("2", "Bob", "b", None), ("3", "Zoë", "c", None), ("4", None, None, "x")]
    assert [r["n"] for r in delimited.dropped_cells(spark, str(tmp_path)).collect()] == [1]


@pytest.mark.parametrize("name, want", [
    ("/x/My File.csv", "my_file"), ("2020.csv", "t_2020"), ("__.csv", "custom_table"), ("a.b.csv", "a_b"), ("Kelvin.csv", "elvin"),
    (".hidden", "hidden"), ("_9.csv", "t_9")])
def test_table_names(name, want):
    assert naming.safe_table_name(name) == want
