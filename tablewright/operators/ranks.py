"""Exact order statistics of many columns without sorting a column.

Input is ``values(name, x, n)``: n copies of the number x in the column name.
A rank is found by narrowing.  Quantile sketches propose split points, one pass
counts the values below, at and between them, and the interval that holds the
rank is split again until few enough values are left to order.  Sketches only
propose and counts decide, so the result is exact whatever the sketches say.
Per pass, a handful of counts per column reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 1_000_000  # rows of one interval that one task may order
GROUPS = 64  # tasks that merge sketches
SPLITS = 32  # split points per interval and pass
ACCURACY = 500  # rank error of a sketch is at most 1 / ACCURACY


def long_numbers(df: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """values(name, x, n) of numeric expressions, one row per number."""
    entries = [F.struct(F.lit(name).alias("name"), x.alias("x")) for name, x in numbers.items()]
    cells = df.select(F.inline(F.array(*entries)))
    return cells.filter(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("n", F.lit(1).cast("bigint"))


@dataclass(frozen=True)
class Interval:
    """Open interval of one column that holds a rank; ``below`` numbers are
    smaller, ``rows`` input rows lie inside.  None is unbounded."""

    name: str
    low: float | None
    high: float | None
    below: int
    rows: int

    def holds(self) -> Column:
        inside = F.col("name") == self.name
        if self.low is not None:
            inside = inside & (F.col("x") > self.low)
        if self.high is not None:
            inside = inside & (F.col("x") < self.high)
        return inside


def _numbered(values: DataFrame, intervals: list[Interval]) -> DataFrame:
    """Rows inside the intervals, with the number of theirs.  Intervals of one
    column do not overlap."""
    which = F.coalesce(*[F.when(i.holds(), F.lit(at)) for at, i in enumerate(intervals)])
    return values.withColumn("at", which).filter(F.col("at").isNotNull())


def _split_points(rows: DataFrame) -> dict[int, list[float]]:
    shares = [(i + 1) / (SPLITS + 1) for i in range(SPLITS)]
    groups = rows.groupBy("at", (F.spark_partition_id() % GROUPS).alias("part")).agg(
        F.percentile_approx("x", shares, ACCURACY).alias("points"))
    # The middle answer of the groups is a number that occurs, so a number
    # that fills a third of the column becomes a split point itself.
    points = groups.select("at", F.posexplode("points").alias("i", "point")).groupBy("at", "i").agg(
        F.percentile_approx("point", 0.5).alias("point"))
    out: dict[int, set[float]] = {}
    for r in points.collect():
        out.setdefault(r["at"], set()).add(r["point"])
    return {at: sorted(ps) for at, ps in out.items()}


def _narrow(values: DataFrame, wanted: dict[Interval, list[int]]) -> dict[tuple[Interval, int], Interval | float]:
    intervals = list(wanted)
    rows = _numbered(values, intervals)
    points = _split_points(rows)
    lists = [F.when(F.col("at") == at, F.array(*[F.lit(p) for p in ps])) for at, ps in points.items()]
    placed = rows.withColumn("points", F.coalesce(*lists)).select(
        "at", "n", F.size(F.filter("points", lambda p: p < F.col("x"))).alias("i"),
        F.array_contains("points", F.col("x")).alias("on"))
    found: dict[int, list] = {}
    for r in placed.groupBy("at", "i", "on").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect():
        found.setdefault(r["at"], []).append((r["i"], r["on"], r["n"], r["rows"]))
    out: dict[tuple[Interval, int], Interval | float] = {}
    for at, interval in enumerate(intervals):
        ps, below = points[at], interval.below
        for i, on, n, size in sorted(found[at]):
            for k in wanted[interval]:
                if below <= k < below + n:
                    low = ps[i - 1] if i > 0 else interval.low
                    high = ps[i] if i < len(ps) else interval.high
                    out[interval, k] = ps[i] if on else Interval(interval.name, low, high, below, size)
            below += n
    return out


def _order(values: DataFrame, wanted: dict[Interval, list[int]]) -> dict[tuple[Interval, int], float]:
    intervals = list(wanted)
    counts = _numbered(values, intervals).groupBy("at", "x").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("x"))
    targets = [(at, interval, k) for at, interval in enumerate(intervals) for k in wanted[interval]]
    # One conditional minimum per rank: the ordered numbers stay in their tasks.
    picks = counts.withColumn("upto", upto).agg(*[
        F.min(F.when((F.col("at") == at) & (F.col("upto") > k - interval.below), F.col("x"))).alias(f"k{j}")
        for j, (at, interval, k) in enumerate(targets)
    ]).first()
    return {(interval, k): picks[f"k{j}"] for j, (_, interval, k) in enumerate(targets)}


def select_ranks(values: DataFrame, ranks: dict[str, list[int]], rows: dict[str, int],
                 small: int = SMALL) -> dict[str, dict[int, float]]:
    """{name: {rank: number}} for 0-based ranks in ascending order; ``rows`` are
    the input rows per name."""
    place: dict[tuple[str, int], Interval | float] = {
        (name, k): Interval(name, None, None, 0, rows[name]) for name, ks in ranks.items() for k in ks}

    def pending(test) -> dict[Interval, list[int]]:
        out: dict[Interval, list[int]] = {}
        for (_, k), where in place.items():
            if isinstance(where, Interval) and test(where):
                out.setdefault(where, []).append(k)
        return out

    def settle(results):
        for (name, k), where in list(place.items()):
            if isinstance(where, Interval) and (where, k) in results:
                place[name, k] = results[where, k]

    while wide := pending(lambda i: i.rows > small):
        settle(_narrow(values, wide))
    if left := pending(lambda i: True):
        settle(_order(values, left))
    out: dict[str, dict[int, float]] = {}
    for (name, k), x in place.items():
        out.setdefault(name, {})[k] = x
    return out


@dataclass(frozen=True)
class Stats:
    """Mean, upper median, and the 1.5 x IQR band (from eight values on)."""

    n: int = 0
    mean: float | None = None
    median: float | None = None
    q1: float | None = None
    q3: float | None = None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def band(self) -> tuple[float, float] | None:
        """None with fewer than eight values or without spread."""
        if not self.iqr or math.isnan(self.iqr):
            return None
        return self.q1 - 1.5 * self.iqr, self.q3 + 1.5 * self.iqr


def statistics(values: DataFrame, median: bool = True, quartiles: bool = True, small: int = SMALL) -> dict[str, Stats]:
    """Statistics of every column in ``values``.  It is read several times, so
    pass a stored table if it is expensive to compute."""
    weighted = F.sum(F.col("x") * F.col("n")) / F.sum("n")
    sums = values.groupBy("name").agg(F.sum("n").alias("n"), weighted.alias("mean"), F.count("*").alias("rows")).collect()
    ranks = {}
    for s in sums:
        n = s["n"]
        ks = ({n // 2} if median else set()) | ({n // 4, 3 * n // 4} if quartiles and n >= 8 else set())
        if ks:
            ranks[s["name"]] = sorted(ks)
    found = select_ranks(values, ranks, {s["name"]: s["rows"] for s in sums}, small)
    out = {}
    for s in sums:
        at, n = found.get(s["name"], {}), s["n"]
        quarter = quartiles and n >= 8
        out[s["name"]] = Stats(n, s["mean"], at.get(n // 2) if median else None,
                               at.get(n // 4) if quarter else None, at.get(3 * n // 4) if quarter else None)
    return out
