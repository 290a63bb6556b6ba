"""Order statistics of many groups against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import group_ranks
from tablewright.plans import clean


@pytest.mark.parametrize("small", [5, 1000])
def test_groups(spark, small):
    rng = random.Random(small)
    numbers = {
        ("a", "hot"): [3.25] * 300 + [rng.uniform(-9, 9) for _ in range(200)], ("a", "wide"): [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        (None, "hot"): [float(rng.randint(0, 9)) for _ in range(7)], (None, None): [1.0, 2.0, 5.0], ("b", "one"): [7.0],
        ("", "eight"): [float(i) for i in range(8)], ("same", "same"): [4.0] * 50}
    rows = [(g, name, x, 1) for (g, name), xs in numbers.items() for x in xs]
    rng.shuffle(rows)
    values = spark.createDataFrame(rows, "what string, name string, x double, n bigint").repartition(5)
    got = {(r["g"], r["name"]): r for r in group_ranks.statistics(values.withColumnRenamed("what", "g"), ["g"], small=small).collect()}
    assert set(got) == set(numbers)
    for key, xs in numbers.items():
        xs, n, r = sorted(xs), len(xs), got[key]
        quarter = (xs[n // 4], xs[3 * n // 4]) if n >= 8 else (None, None)
        assert (r["n"], r["median"], r["q1"], r["q3"]) == (n, xs[n // 2], *quarter), key
        assert r["mean"] == pytest.approx(sum(xs) / n)


def test_copies_and_no_values(spark):
    rows = [("a", "x", 1.0, 10), ("a", "x", 2.0, 1), ("a", "x", 9.0, 30)]
    values = spark.createDataFrame(rows, "g string, name string, x double, n bigint")
    r = group_ranks.statistics(values, ["g"], small=1).first()
    assert (r["n"], r["median"], r["q1"], r["q3"]) == (41, 9.0, 2.0, 9.0)
    assert group_ranks.statistics(values.limit(0), ["g"]).isEmpty()


def test_cleaning_of_tables_told_apart_by_columns_with_awkward_names(spark):
    rows = [("x", 1, "1", "p"), ("x", 2, "", "p"), ("x", 3, "3", ""), ("x", 4, "5", "q"), (None, 5, "", "r"), (None, 6, "7.0", None), ("z", 7, "n/a", "-")]
    df = spark.createDataFrame(rows, "n string, i bigint, name string, x string")
    rules = {"columns": {"name": {"action": "fill_missing_median"}, "x": {"action": "fill_missing_mode"}}}
    got = clean.clean(df, ["name", "x"], "i", rules, by=["n"])
    assert [tuple(r)[:4] for r in got.data.orderBy("i").collect()] == [
        ("x", 1, "1", "p"), ("x", 2, "3", "p"), ("x", 3, "3", "p"), ("x", 4, "5", "q"), (None, 5, "7.0", "r"), (None, 6, "7.0", "r"),
        ("z", 7, None, None)]
    assert {tuple(r) for r in got.change_log().collect()} == {("x", "name", "filled", 1), ("x", "x", "filled", 1), (None, "name", "filled", 1), (None, "x", "filled", 1)}
    capped = clean.clean(spark.createDataFrame([("g", i, str(x)) for i, x in enumerate([*range(10), 1000])] + [("h", 99, "1000")], "g string, i bigint, v string"),
                         ["v"], "i", {"columns": {"v": {"action": "cap_outliers"}}}, by=["g"])
    # quartiles 2 and 8, so the upper bound is 17; one value has no bounds
    assert [r["v"] for r in capped.data.filter("i > 9").orderBy("i").collect()] == ["17.0", "1000"]
    mean = clean.clean(df, ["name"], "i", {"columns": {"name": {"action": "fill_missing_mean"}}}, by=["n"])
    assert [r["name"] for r in mean.data.orderBy("i").collect()] == ["1", "3.0", "3", "5", "7.0", "7.0", None]
    assert clean.clean(df, ["name"], "i", {}, by=["n"]).change_log().columns == ["n", "column_name", "change", "n"]
