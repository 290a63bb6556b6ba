"""Order statistics against sorted lists."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators.ranks import long_numbers, statistics


def expected(xs):
    s, n = sorted(xs), len(xs)
    return s[n // 2], s[n // 4] if n >= 8 else None, s[3 * n // 4] if n >= 8 else None


def check(spark, columns, small):
    n = max(len(v) for v in columns.values())
    rows = [[v[i] if i < len(v) else None for v in columns.values()] for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = statistics(long_numbers(df, {c: F.col(c) for c in columns}), small=small)
    for c, xs in columns.items():
        s = got[c]
        assert (s.median, s.q1, s.q3) == expected(xs), c
        assert s.n == len(xs) and s.mean == pytest.approx(sum(xs) / len(xs))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 10, 11, 12, 50, 203])
def test_small_sets(spark, n):
    rng = random.Random(n)
    check(spark, {"a": [float(rng.randint(-9, 9)) for _ in range(n)]}, small=1000)


def test_constant_has_no_band(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "a double")
    stats = statistics(long_numbers(df, {"a": F.col("a")}))["a"]
    assert stats.band is None and stats.q1 == 5.0


def test_narrowing_with_a_hot_value_and_huge_range(spark):
    rng = random.Random(1)
    hot = [3.25] * 1000 + [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    wide = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3000)]
    check(spark, {"hot": hot, "wide": wide, "skew": [rng.random() ** 9 for _ in range(3000)]}, small=50)


def test_weights_count_as_copies(spark):
    df = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 1), ("a", 9.0, 30)], "name string, x double, n bigint")
    s = statistics(df, small=1)["a"]
    # Ranks 0 to 9 are 1.0, rank 10 is 2.0, the others 9.0; 41 // 4 is 10.
    assert (s.n, s.median, s.q1, s.q3) == (41, 9.0, 2.0, 9.0)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-20, 20).map(float), min_size=8, max_size=80))
def test_any_list(spark, xs):
    check(spark, {"a": xs}, small=10)
