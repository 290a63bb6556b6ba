"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled (ordered by a digest of their id).  Within its source a
document's virtual finish time is the source's cumulative words up to and
including it, divided by the source's target; a second pass over a source goes
on counting where the first ended.  All sources are then served in the order of
finish time until the total budget is spent; the document at the end is cut to
what is left.  Targets share the budget by weight; none exceeds ``max_passes``
times its source, and the excess is shared again.

Running sums over a hot source or over all rows are taken in two levels: sums of
buckets of the order first, then rows within a bucket, so no task orders a
source.  Null text has size 0; null source is a source of its own, the last;
repeated rows are served each for itself.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablewright.session import stage

from .common import WORD, free_name, quoted

WEIGHTS = (3, 1, 2)
BUCKETS = 1024          # of each source's shuffled order
FINISH_STEPS = 4096     # buckets per unit of virtual time


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sources: DataFrame, weights=WEIGHTS, percent: int = 150, max_passes: int = 2) -> DataFrame:
    """(src, size) to (src, size, target).  Shares by weight, filled up in the
    order of ratio of cap to weight: a source is capped if its ratio is under the
    level that the rest would reach.  One row per source."""
    by_name = W.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = (sources.withColumn("weight", weight).withColumn("cap", max_passes * F.col("size").cast("double"))
            .withColumn("budget", F.sum("size").over(W.partitionBy()) * percent / F.lit(100.0)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "src")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("budget") - before) / left)
    rows = rows.withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    # the level of the first source that is not capped holds for all after it
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(W.partitionBy())
    rows = rows.withColumn("final", level.level)
    return rows.select("src", "size", F.when(F.col("final").isNull(), F.col("cap"))
                       .otherwise(F.least("cap", F.col("weight") * F.col("final"))).alias("target"))


def source_key(source: Column) -> Column:
    """Sorts as the sources do by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def shuffle_key(doc_id: Column, src: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), src))


def _placed(docs: DataFrame, weights, percent, max_passes, row: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with their words up to and including them in their source's order, and
    the sources with their targets; both stored."""
    src = source_key(F.col("source"))
    sized = docs.select("doc_id", "source", row.alias("row"), word_count(F.col("text")).alias("size"), src.alias("src"),
                        shuffle_key(F.col("doc_id"), src).alias("turn"))
    # the leading bits of the digest, so buckets are ranges of the order
    bucket = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("bigint") * BUCKETS / (1 << 32)).cast("int")
    sized = stage(sized.withColumn("bucket", bucket), "mix-sizes")

    # cumulative words: of buckets within a source, then of rows within a bucket
    per_bucket = sized.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    in_source = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
    shares = stage(targets(sized.groupBy("src").agg(F.sum("size").alias("size")), weights, percent, max_passes), "mix-targets")
    offsets = stage(offsets.join(shares.select("src", F.col("size").alias("source_size"), "target"), "src").drop("words"), "mix-offsets")
    in_bucket = W.partitionBy("src", "bucket").orderBy("turn", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    placed = (sized.join(offsets, ["src", "bucket"])
              .withColumn("upto", F.col("offset") + F.sum("size").over(in_bucket)).drop("offset", "bucket"))
    return stage(placed, "mix-placed"), shares


def _passes(placed: DataFrame, max_passes: int) -> DataFrame:
    rows = placed.select("src", "turn", "size", "upto", "row", "source_size", "target",
                         F.explode(F.array(*[F.lit(i) for i in range(max_passes)])).alias("pass"))
    return rows.withColumn("finish", finish(F.col("pass"))).filter("size > 0 AND finish IS NOT NULL")


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = 150, max_passes: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size,
    source_size, target, taken."""
    placed, shares = _placed(docs, weights, percent, max_passes, F.lit(0))
    end = last_served(_passes(placed, max_passes), shares)
    here = [_served(F.lit(i), end) for i in range(max_passes)]
    taken = sum(here[1:], here[0])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, percent: int = 150, max_passes: int = 2) -> DataFrame:
    """The rows of ``docs`` that the mix takes anything of, with their columns and
    ``taken`` (or the next free name): the words it takes, repeats counted.

    What is served of a source in a pass is a beginning of its shuffled order, so
    the last row of each tells of every row what is taken; no text is shuffled."""
    row, out = free_name(docs, "row"), free_name(docs, "taken")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    placed, shares = _placed(rows, weights, percent, max_passes, quoted(row))
    passes = _passes(placed, max_passes)
    end = last_served(passes, shares)
    served = passes if end is None else passes.filter(_key(F.col("pass")) <= _last(end))
    place = F.struct("turn", "size", "row")
    lasts = [F.max(F.when(F.col("pass") == i, place)).alias(f"last{i}") for i in range(max_passes)]
    of = free_name(rows, "src_of_end")
    ends = stage(served.groupBy(F.col("src").alias(of)).agg(*lasts), "mix-ends")

    src = source_key(F.col("source"))
    mine = F.struct(shuffle_key(F.col("doc_id"), src).alias("turn"), word_count(F.col("text")).alias("size"), quoted(row).alias("row"))
    place, prefix = free_name(rows, "place"), free_name(rows, "ends")
    ends = ends.select(of, F.struct(*[f"last{i}" for i in range(max_passes)]).alias(prefix))
    joined = rows.withColumn(place, mine).join(ends, src == F.col(of))
    taken = F.lit(0).cast("bigint")
    for i in range(max_passes):
        last = quoted(prefix)[f"last{i}"]
        cut = F.lit(False) if end is None or end["pass"] != i else (F.col(of) == end["src"]) & (quoted(place) == last)
        taken = taken + F.when(cut, F.lit(None if end is None else end["left"])).when(
            quoted(place) <= last, quoted(place).size).otherwise(F.lit(0))
    return joined.withColumn(out, taken).filter(quoted(out) > 0).select(*[quoted(c) for c in docs.columns], quoted(out))


def finish(turn: Column) -> Column:
    """Virtual finish time of a document in a pass over its source."""
    return F.when(F.col("target") > 0, (F.col("upto") + turn * F.col("source_size")) / F.col("target"))


def last_served(passes: DataFrame, shares: DataFrame):
    """The row at which the budget ends in the order of finish times, and how much
    of it is still taken; None if the budget outlasts all rows."""
    step = F.floor(F.col("finish") * FINISH_STEPS)
    passes = passes.withColumn("step", step)
    budget = shares.agg(F.floor(F.round(F.sum("target"), 3)).alias("budget")).first().budget
    if budget is None:
        return None
    steps = passes.groupBy("step").agg(F.sum("size").alias("words"))
    # sums of ranges of steps first, so that no task orders all steps
    wide = steps.groupBy(F.floor(F.col("step") / FINISH_STEPS * 64).alias("range")).agg(F.sum("words").alias("words"))
    first = _first_over(wide, ["range"], "words", budget)
    if first is None:
        return None
    budget -= first.before
    inside = steps.filter(F.floor(F.col("step") / FINISH_STEPS * 64) == first.range)
    first = _first_over(inside, ["step"], "words", budget)
    row = _first_over(passes.filter(F.col("step") == first.step), ["finish", "src", "turn", "upto", "pass"], "size",
                      budget - first.before)
    return row.asDict() | {"left": budget - first.before - row.before}


def _first_over(rows: DataFrame, order: list[str], size: str, budget: int):
    """First row in the order whose running sum exceeds ``budget``; ``before``: the sum before it."""
    upto = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (rows.withColumn("before", upto - F.col(size)).filter(F.col("before") + F.col(size) > budget)
            .orderBy(*order).first())


FIELDS = {"finish": "double", "src": "string", "turn": "string", "upto": "bigint", "pass": "int"}


def _key(turn: Column) -> Column:
    """Place of a row's pass in the order of service."""
    mine = (finish(turn), F.col("src"), F.col("turn"), F.col("upto"), turn)
    return F.struct(*[c.cast(kind).alias(n) for c, (n, kind) in zip(mine, FIELDS.items())])


def _last(end: dict) -> Column:
    return F.struct(*[F.lit(end[n]).cast(kind).alias(n) for n, kind in FIELDS.items()])


def _served(turn: Column, end) -> Column:
    """Words taken of a row in one pass."""
    if end is None:
        return F.col("size")
    none = (F.col("size") == 0) | finish(turn).isNull()
    return (F.when(none, F.lit(0)).when(_key(turn) < _last(end), F.col("size"))
            .when(_key(turn) == _last(end), F.lit(end["left"])).otherwise(F.lit(0)))
