"""Exact order statistics of many groups at once.

``ranks`` settles the ranks of a few columns with some counts on the driver.  Where there
are as many groups as worksheets or keys, nothing of a group may go there: here the state of
each search is a row of a stored table, a pass narrows all of them by joins, and one number, the
size of the widest interval left, tells the driver whether to go on.

Input is ``values(<keys>, name, x, n)``: n copies of the number x in the column ``name`` of a
group.  Quantile sketches of each group propose split points, one pass counts the values between
and at them, and the interval that holds the rank is searched again until it has few enough
rows for one task.  A number that fills a third of a group becomes a split point itself, and counts
merge before the shuffle, so a hot group is neither ordered nor brought together.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import int_div
from ..session import stage
from .ranks import ACCURACY, GROUPS, SMALL, SPLITS


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equal keys, NULL equal to NULL; the keys and other columns of ``left``, then the others
    of ``right``."""
    free = text.free_prefix([*left.columns, *right.columns])
    others = [text.quoted(c) for c in right.columns if c not in keys]
    renamed = right.select(*[text.quoted(k).alias(f"{free}{i}") for i, k in enumerate(keys)], *others)
    same = functools.reduce(Column.__and__, [text.quoted(k).eqNullSafe(F.col(f"{free}{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, same, how).drop(*[f"{free}{i}" for i in range(len(keys))])


def _inside(values: DataFrame, searches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, what, x, n of the values in the open interval of each search."""
    bounds = searches.select(*_cols(keys), "what", "low", "high")
    above = F.col("low").isNull() | (F.col("x") > F.col("low"))
    below = F.col("high").isNull() | (F.col("x") < F.col("high"))
    return joined(values, bounds, keys).filter(above & below).select(*_cols(keys), "what", "x", "n")


def _cols(keys: list[str]) -> list[Column]:
    return [text.quoted(k) for k in keys]


STATE = ["what", "k", "low", "high", "below", "rows", "answer"]


def _narrowed(values: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Each search one pass further on: its answer, or the interval between two split points."""
    every = [*keys, "what"]
    rows = _inside(values, wide, keys)
    shares = [(i + 1) / (SPLITS + 1) for i in range(SPLITS)]
    sketches = rows.groupBy(*_cols(every), (F.spark_partition_id() % GROUPS).alias("part")).agg(
        F.percentile_approx("x", shares, ACCURACY).alias("points"))
    middle = sketches.select(*_cols(every), F.posexplode("points").alias("i", "point")).groupBy(*_cols(every), "i").agg(
        F.percentile_approx("point", 0.5).alias("point"))
    points = stage(middle.groupBy(*_cols(every)).agg(F.array_sort(F.collect_set("point")).alias("points")), "points")
    placed = joined(rows, points, every).select(
        *_cols(every), "n", F.size(F.filter("points", lambda p: p < F.col("x"))).alias("i"),
        F.array_contains("points", F.col("x")).alias("on"))
    slots = placed.groupBy(*_cols(every), "i", "on").agg(F.sum("n").alias("n"), F.count("*").alias("size"))
    # at most two slots for each split point
    upto = F.sum("n").over(Window.partitionBy(*_cols(every)).orderBy("i", "on"))
    counted = joined(joined(slots.withColumn("upto", upto), wide, every), points, every)
    hit = counted.filter((F.col("k") < F.col("below") + F.col("upto")) & (F.col("k") >= F.col("below") + F.col("upto") - F.col("n")))
    at, before = F.get("points", F.col("i")), F.get("points", F.col("i") - 1)
    return hit.select(
        *_cols(keys), "what", "k", F.coalesce(before, "low").alias("low"), F.coalesce(at, "high").alias("high"),
        (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("size").alias("rows"), F.when(F.col("on"), at).alias("answer"))


def select_ranks(values: DataFrame, wanted: DataFrame, keys: list[str], small: int = SMALL) -> DataFrame:
    """keys, what, answer for ``wanted``(keys, what, k, rows): the k-th (from 0) of the ``rows``
    values of a group in ascending order.  ``what`` tells apart the ranks of one group."""
    none = F.lit(None).cast("double")
    state = stage(wanted.select(*_cols(keys), "what", F.col("k").cast("bigint").alias("k"), none.alias("low"), none.alias("high"),
                                F.lit(0).cast("bigint").alias("below"), F.col("rows").cast("bigint").alias("rows"),
                                none.alias("answer")), "ranks")
    open_ = F.col("answer").isNull()
    while (state.filter(open_).agg(F.max("rows")).first()[0] or 0) > small:
        wide = open_ & (F.col("rows") > small)
        state = stage(state.filter(~wide).unionByName(_narrowed(values, state.filter(wide), keys)), "ranks")
    every = [*keys, "what"]
    left = state.filter(open_).drop("answer")
    counts = _inside(values, left, keys).groupBy(*_cols(every), "x").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_cols(every)).orderBy("x"))
    past = joined(counts.withColumn("upto", upto), left, every).filter(F.col("below") + F.col("upto") > F.col("k"))
    ordered = past.groupBy(*_cols(every)).agg(F.min("x").alias("answer"))
    return state.filter(~open_).select(*_cols(every), "answer").unionByName(ordered)


def statistics(values: DataFrame, by: list[str], median: bool = True, quartiles: bool = True, small: int = SMALL) -> DataFrame:
    """<by>, name, n, mean, median, q1, q3, stored: the same as ``ranks.statistics`` for every
    group; quartiles from eight values on.  ``values`` is read several times."""
    keys = [*by, "name"]
    weighted = F.sum(F.col("x") * F.col("n")) / F.sum("n")
    sums = stage(values.groupBy(*_cols(keys)).agg(F.sum("n").alias("n"), weighted.alias("mean"), F.count("*").alias("rows")), "group-sums")
    n = F.col("n")
    rank = lambda what, k, when=F.lit(True): F.when(when, F.struct(F.lit(what).alias("what"), k.alias("k")))
    ranks = [rank("median", int_div(n, 2))] if median else []
    if quartiles:
        ranks += [rank("q1", int_div(n, 4), n >= 8), rank("q3", int_div(n * 3, 4), n >= 8)]
    out = sums.drop("rows")
    names = ["median", "q1", "q3"]
    if not ranks:
        return out.withColumns({w: F.lit(None).cast("double") for w in names})
    wanted = sums.select(*_cols(keys), "rows", F.inline(F.array_compact(F.array(*ranks))))
    found = select_ranks(values, wanted, keys, small)
    wide = found.groupBy(*_cols(keys)).agg(*[F.max(F.when(F.col("what") == w, F.col("answer"))).alias(w) for w in names])
    return stage(joined(out, wide, keys, "left"), "group-statistics")
