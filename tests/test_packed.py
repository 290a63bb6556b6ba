"""Counts of columns from packed hashes, against counting cell by cell."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.functions import numbers, text
from tablewright.operators import cells, packed
from tablewright.plans import profile

TEXTS = ["a", " a", "A", "b c", "B C ", "", "  ", None, "NaN", "n/a", "-", "1", "1.0", "1,000", " 7", "x@y.org", "X@Y.org", "bad@", "İ", "straße", "STRASSE", "\u00a0é", "É", "ß" * 90]


def table(spark, seed, n=400, cols=4):
    draw = random.Random(seed)
    rows = [[draw.choice(TEXTS[: 4 + 6 * c]) for c in range(cols)] for _ in range(n)]
    rows += rows[:30] + [[v and v.upper() for v in r] for r in rows[:20]]
    draw.shuffle(rows)
    names = [f"c {i}" for i in range(cols)]
    return rows, names, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq bigint, " + ", ".join(f"`{c}` string" for c in names)).repartition(3)


def stripped(v):
    return (v or "").strip(text.WHITESPACE)


def blank(v):
    return stripped(v).lower() in {"", *text.BLANK_TOKENS}


@pytest.mark.parametrize("bucket, held", [(1 << 19, 1 << 19), (7, 16)])
def test_counts(spark, monkeypatch, bucket, held):
    monkeypatch.setattr(packed, "BUCKET", bucket)
    monkeypatch.setattr(packed, "HELD", held)
    rows, names, df = table(spark, 1)
    p = packed.pack(df, names, len(rows), cased=names[1:], emails=names[2:3], numeric=names[3:], rows=True, least=3)
    facts = packed.sums(p, packed.counted(p, {0: 2, 1: 4, 2: 4, 3: 4, packed.ROWS: 4}))
    for i in range(4):
        column = [r[i] for r in rows]
        full = [stripped(v) for v in column if not blank(v)]
        spellings = Counter(full)
        groups: dict = {}
        for s, n in spellings.items():
            groups.setdefault(s.lower(), []).append(n)
        f = facts[i]
        assert (f["total"], f["blank"], f["distinct"]) == (len(rows), len(rows) - len(full), len(spellings))
        assert f["padded"] == sum(v is not None and v != stripped(v) for v in column)
        if i:
            assert f["odd"] == sum(sum(g) - max(g) for g in groups.values()) and f["mixed"] == sum(len(g) > 1 for g in groups.values())
        if i == 2:
            assert f["invalid"] == sum(not packed.EMAIL.match(s) for s in full)
        assert packed.least_values(p, 3)[i] == sorted(spellings, key=str.encode)[:3]
    found = Counter()
    for r in packed.number_values(p, names).collect():
        found[r["x"]] += r["n"]
    assert found == Counter(x for x in (packed.number(stripped(r[3])) for r in rows if not blank(r[3])) if x == x)
    whole = Counter(tuple(stripped(v) for v in r) for r in rows)
    assert facts[packed.ROWS]["distinct"] == len(whole)
    assert facts[packed.ROWS]["mixed"] == sum(n > 1 for n in Counter(tuple(x.lower() for x in r) for r in whole).values())


def test_rows_that_travel_are_few(spark):
    """A column of ids: a row for each bucket and task, not one for each id."""
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id")).repartition(4)
    p = packed.pack(df, ["id"], 20_000)
    assert p.filter(F.col("kind") == packed.KEYS).count() <= 4
    assert packed.sums(p, packed.counted(p, {0: 2}))[0]["distinct"] == 20_000


def test_few_cells_stand_at_a_time(spark, monkeypatch):
    """Long texts and long batches are taken apart in portions; many columns share what a task holds."""
    batch = pa.record_batch({"v0": ["x" * 400_000] * 5 + ["y" * 3_000_000] + [None] * 5000, "v1": ["z"] * 5006})
    parts = list(packed.portions(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in parts[:4]] == [2, 2, 1, 1] and max(p.num_rows for p in parts) <= packed.SLICE_ROWS
    monkeypatch.setattr(packed, "HELD", 4000)
    monkeypatch.setattr(packed, "FEWEST", 10)
    df = spark.range(8000).select(*[F.concat(F.lit(f"{i}."), "id").alias(f"c{i}") for i in range(8)]).coalesce(1)
    p = packed.pack(df, df.columns, 8000, numeric=df.columns[:1])
    held = p.filter(F.col("kind") == packed.KEYS).agg(F.max(F.length("data"))).first()[0] // 24
    assert held <= packed.SLICE_ROWS + 4000 // 9
    assert packed.sums(p, packed.counted(p, dict.fromkeys(range(8), 2)))[7]["distinct"] == 8000
    found = packed.number_values(p, df.columns).agg(F.sum("n"), F.countDistinct("x"), F.max("name")).first()
    assert tuple(found) == (8000, len({float(f"0.{i}") for i in range(8000)}), "c0")


def test_a_limit_stops_counting(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("many"), (F.col("id") % 20).cast("string").alias("few")).repartition(2)
    p = packed.pack(df, ["many", "few"], 5000, most=21)
    facts = packed.sums(p, packed.counted(p, {0: 2, 1: 2}))
    assert facts[0]["distinct"] >= 21 and facts[1]["distinct"] == 20
    assert facts[0]["total"] == facts[1]["total"] == 5000


def test_numbers_as_spark_reads_them(spark):
    texts = ["1", "-1.5", "+2", "1e5", "1.0e5", ".5", ".", "5.", "1,234.5", " 3 ", "1_0", "inf", "nan", "١", "1.0E-3", "9" * 400 + ".0", ",", "--1", "1.5d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [r[0] for r in df.select(numbers.number(F.col("t"))).collect()]
    assert [x if x == x else None for x in map(packed.number, texts)] == want


def test_first_cells_of_sparse_columns_in_one_pass(spark):
    df = spark.range(3000).select(F.struct((F.col("id") % 7).alias("a"), "id").alias("at"), F.when(F.col("id") % 500 == 3, F.col("id")).cast("string").alias("rare"),
                                  F.col("id").cast("string").alias("full"), F.lit(None).cast("string").alias("none")).repartition(5)
    got = cells.first_values(df.withColumnRenamed("at", "seq"), ["rare", "full", "none"], "seq", 4, lambda v: v.isNotNull())
    got = sorted((r["column_name"], r["rank"], r["value"]) for r in got.collect())
    rare = sorted(((i % 7, i) for i in range(3000) if i % 500 == 3))[:4]
    full = sorted(((i % 7, i) for i in range(3000)))[:4]
    assert got == sorted([("rare", n, str(i)) for n, (_, i) in enumerate(rare, 1)] + [("full", n, str(i)) for n, (_, i) in enumerate(full, 1)])


def test_sparse_columns_take_one_more_pass(spark):
    df = spark.range(6000).select(F.col("id").alias("seq"), *[
        F.when(F.col("id") > 5990 - i, F.lit("2024-01-0") .cast("string") if i % 2 else F.lit("2024-01-05")).alias(f"c{i}") for i in range(12)])
    before = len(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None))
    looks, total = profile.leading_looks(df, [f"c{i}" for i in range(12)], "seq")
    jobs = len(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)) - before
    assert total == 6000 and looks["c0"]["dates"] == 1 and looks["c1"]["dates"] == 0 and looks["c3"]["n"] == 12
    assert jobs <= 12


def test_near_duplicates_only_shuffle_mixed_rows(spark, make):
    df = make({"a": ["x", "X ", "x", "y", "y", "z", None, ""], "b": ["1", "1", "1", "2", "2", "3", "", None]})
    report = profile.analyze(df, ["a", "b"], "seq")
    assert (report.total_rows, report.full_duplicates, report.near_duplicates) == (8, 3, 1)
