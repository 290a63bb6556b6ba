"""Medians of whole numbers that no double tells apart."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.plans import clean


@pytest.mark.parametrize("sign", [1, -1])
def test_median_of_long_ids(spark, make, sign):
    draw = random.Random(sign)
    base = 12345678901234567 * 10**23
    values = [sign * (base + draw.randrange(10**12)) for _ in range(300)] + [sign * (base + 7)] * 150 + [3, -4]
    df = make({"id": [str(v) for v in values] + [""]}).repartition(3)
    facts = clean.column_facts(df, {"id": "fill_missing_median"}, "seq")
    assert facts["id"].median == str(sorted(values)[len(values) // 2])


def test_every_rank(spark):
    draw = random.Random(4)
    numbers = sorted(draw.choice([draw.randrange(1, 10), draw.randrange(10**18, 10**18 + 30), draw.randrange(10**39, 10**40)]) for _ in range(25))
    rows = spark.createDataFrame([(str(n), 1) for n in numbers], "digits string, n bigint")
    rows = rows.groupBy("digits").agg(F.sum("n").alias("n"))
    for k in (0, 7, 12, 24):
        assert clean._digits_at(rows, k, True) == str(numbers[k])
        assert clean._digits_at(rows, k, False) == str(numbers[::-1][k])
    with pytest.raises(ValueError):
        clean._digits_at(rows, 25, True)
