"""Delimited files with line breaks in quoted cells, cut into splits of a few bytes."""

import contextlib
import csv
import random

import pytest

from tablewright.sources import delimited, quoted


@contextlib.contextmanager
def splits(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def expected(path, sep, width, encoding="utf-8"):
    with open(path, newline="", encoding=encoding) as file:
        rows = [r for r in csv.reader(file, delimiter=sep) if r][1:]
    return [tuple((r + [""] * width)[:width]) for r in rows]


def rows_of(spark, path, **options):
    df = delimited.read_delimited(spark, str(path), **options)
    return [tuple(r)[1:] for r in df.orderBy(df.columns[0]).collect()]


def made(seed, records, sep, end="\n", stray=False):
    draw = random.Random(seed)
    cells = ["", "a", "b c", "é€", "x" * 40, "1.5", "say \"hi\"", "two\nlines", f"a{sep}b", "\n\n", "\"", "\"\"", f"\"{sep}\n\"", "end\r\nof", "long " * 30 + "\n" + "cell " * 40]
    lines = []
    for _ in range(records):
        row = []
        for c in draw.choices(cells, k=draw.choice([3, 3, 3, 2, 4])):
            wrap = draw.random() < 0.2 or any(x in c for x in f'{sep}\n\r"')
            row.append('"' + c.replace('"', '""') + '"' if wrap else c)
        if stray and draw.random() < 0.3:
            row[draw.randrange(len(row))] = draw.choice(['5" pipe', 'a"', '"ab"cd', '"x" "y"', 'q""q'])
        lines.append(sep.join(row) or "only")
    return "id" + sep + "\"two\nline name\"" + sep + "c" + end + end.join(lines) + draw.choice(["", end])


@pytest.mark.parametrize("case", range(4))
def test_random_files(spark, tmp_path, case):
    sep = ",;|\t"[case % 4]
    path = tmp_path / "a.csv"
    path.write_bytes(made(case, 18, sep, ["\n", "\r\n"][case % 2], stray=case >= 2).encode())
    want = expected(path, sep, 3)
    assert any("\n" in c for r in want for c in r)
    for size in ("73b", "128m") if case < 2 else ("41b",):
        with splits(spark, size):
            df = delimited.read_delimited(spark, str(path), sep=sep)
            got = [tuple(r) for r in df.orderBy("seq").collect()]
        assert [r[1:] for r in got] == want, size
        assert len({r[0] for r in got}) == len(want)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(made(3, 120, ","))
    with splits(spark, "1k"):
        df = delimited.read_delimited(spark, str(path))
        blocks = df.select("seq.block").distinct().count()
    assert blocks > 5


def test_cells_over_many_splits_and_cells_never_closed(spark, tmp_path):
    path = tmp_path / "a.csv"
    giant = "\n".join(f"line {i}, with ''comma" for i in range(40))
    path.write_text(f'id,note,c\n1,"{giant}",x\n2,b,c\n3,"open\nend\n')
    with splits(spark, "100b"):
        assert rows_of(spark, path) == [("1", giant, "x"), ("2", "b", "c"), ("3", "open\nend", "")]


def test_a_cell_that_never_ends_travels_in_pieces(monkeypatch):
    monkeypatch.setattr(quoted, "CHARS", 20)
    split = quoted.Split(tuple(quoted.re.compile(p) for p in quoted.opens(",")), False)
    found = [x for i in range(9) for x in split.add(f"plain {i}\n")] + list(split.end())
    heads = [x for x in found if x[0] == quoted.HEAD]
    assert "".join(x[-1] for x in heads) == "".join(f"plain {i}\n" for i in range(9)) and len(heads) > 2
    assert [x[2] for x in heads] == sorted(x[2] for x in heads)
    assert found[-1][-1] == "010"


def test_old_line_ends_encodings_and_cells_left_over(spark, tmp_path):
    for name, text, encoding in (("cr", 'a,b\r1,"x\ry"\r2,z\r', "utf-8"), ("latin", 'a,b\né,"x\n€"\n2,z,more\n', "cp1252")):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode(encoding))
        with splits(spark, "5b"):
            assert rows_of(spark, path) == expected(path, ",", 2, encoding), name
    assert delimited.dropped_cells(spark, str(tmp_path / "latin.csv")).first()["n"] == 1


def test_several_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text(made(20 + i, 12, ","))
    want = [r for i in range(2) for r in expected(tmp_path / f"{i}.csv", ",", 3)]
    with splits(spark, "200b"):
        assert rows_of(spark, tmp_path) == want


def test_only_lines_that_open_a_cell_ask_for_the_second_reader(spark, tmp_path):
    cases = {'5" pipe,a': False, '"a ""b"" c",d': False, 'a,"b': True, '"a",5",c"': False, '"a",5",7,"b': True, "": False,
             '"' + '""' * 20_000 + '",x': False, '"' + '""' * 20_000: True, ",".join(['"a""b"'] * 20_000): False}
    for i, (line, opens) in enumerate(cases.items()):
        path = tmp_path / f"{i}.csv"
        path.write_text(f"a,b\n{line}\n1,2\n")
        assert quoted.has_quoted_breaks(spark, [str(path)], ",") is opens, line[:50]
        assert bool(quoted.re.match(quoted.opens(",")[0], line + "\n")) is opens
