"""Operators over the cells of a table, one result row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import dates, naming, numbers, text
from .packed import first_of


def by_name(name: Column, values: dict[str, object]) -> Column:
    """Value looked up by column name, as a literal chain of comparisons."""
    expr = None
    for k, v in values.items():
        expr = F.when(name == k, F.lit(v)) if expr is None else expr.when(name == k, F.lit(v))
    return expr


def measure(df: DataFrame, cols: list[str], measures: dict[str, callable], totals: dict[str, Column] | None = None,
            name: str = "column_name") -> DataFrame:
    """Aggregate every column in a single pass; one result row per column.

    ``measures`` maps a name to a function from the column's expression to an
    aggregate; ``totals`` are aggregates of the whole table, repeated on each
    row.  The wide aggregate moves one row per task, however many columns."""
    totals = totals or {}
    aggs = [fn(text.quoted(c)).alias(f"{m}__{i}") for i, c in enumerate(cols) for m, fn in measures.items()]
    row = df.agg(*[a.alias(f"total__{t}") for t, a in totals.items()], *aggs)
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias(name), *[F.col(f"{m}__{i}").alias(m) for m in measures])
        for i, c in enumerate(cols)
    ])
    return row.select(*[F.col(f"total__{t}").alias(t) for t in totals], F.inline(entries))


def filled_counts(df: DataFrame, cols: list[str], missing=text.is_empty) -> DataFrame:
    """column_name, filled: number of cells that are not missing."""
    out = measure(df, cols, {"filled": lambda c: F.count_if(~missing(c))})
    return out.select("column_name", "filled")


def long_cells(df: DataFrame, cols: list[str], seq: str | None = None, keep=None) -> DataFrame:
    """(position, column_name, value[, seq]) for every cell.  Prune ``cols``
    first: the result has one row per cell."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), text.quoted(c).alias("value"))
        for i, c in enumerate(cols)
    ])
    extra = [] if seq is None else [F.col(seq).alias("seq")]
    out = df.select(*extra, F.inline(pairs))
    return out if keep is None else out.filter(keep(F.col("value")))


def _literal(value) -> Column:
    """Literal of a value of the order column, which may be a struct."""
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(k) for k, v in value.asDict().items()])
    return F.lit(value)


def head_and_total(df: DataFrame, seq: str, k: int) -> tuple[DataFrame, int]:
    """The first k rows in arrival order, and how many rows there are.

    A bound is found first, reading only the order: the last row of some partition
    that holds k rows.  The top-k then reads that far and not the k first rows of
    every partition.
    """
    order = text.quoted(seq)
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.max(order).alias("last"))
    total, bound = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min(F.when(F.col("n") >= k, F.col("last")))).first()
    if bound is not None:
        df = df.filter(order <= _literal(bound))
    return df.orderBy(order).limit(k), total


def head_rows(df: DataFrame, seq: str, k: int) -> DataFrame:
    return head_and_total(df, seq, k)[0]


def first_values(df: DataFrame, cols: list[str], seq: str, k: int, keep) -> DataFrame:
    """(column_name, value, rank): the first k cells of each column in arrival
    order, of those that satisfy ``keep``.  One pass, however many columns: a task holds
    and passes on k cells of each."""
    order = Window.partitionBy("column_name").orderBy("seq")
    found = first_of(df, cols, seq, k, keep).withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= k).select("column_name", "value", "rank")


def date_columns(df: DataFrame, cols: list[str], seq: str) -> DataFrame:
    """column_name, is_date: by name, or by one of the first five values."""
    head = head_rows(df.select(seq, *[text.quoted(c) for c in cols]), seq, 5)
    out = measure(head, cols, {"seen": lambda c: F.max(dates.looks_like_date(c).cast("int"))})
    named = by_name(F.col("column_name"), {c: int(naming.has_word(c, naming.ANY_FILE_DATE_WORDS)) for c in cols})
    return out.select("column_name", F.greatest(named, F.coalesce("seen", F.lit(0))).alias("is_date"))


def storage_types(df: DataFrame, cols: list[str], seq: str, missing=text.is_empty) -> DataFrame:
    """column_name, storage_type: INTEGER, REAL or TEXT from the first twenty
    filled cells among the first two hundred rows."""
    head = head_rows(df.select(seq, *[text.quoted(c) for c in cols]), seq, 200)
    order = Window.partitionBy("column_name").orderBy("seq")
    filled = long_cells(head, cols, seq).withColumn("filled", ~missing(F.col("value")))
    seen = filled.filter("filled").withColumn("rank", F.row_number().over(order)).filter("rank <= 20")
    tested = seen.groupBy("column_name").agg(
        F.bool_and(text.strip(F.col("value")).rlike(numbers.INT_PATTERN)).alias("whole"),
        F.bool_and(text.strip(F.col("value")).rlike(numbers.FLOAT_OR_SPECIAL_PATTERN)).alias("real"))
    names = measure(head, cols, {"n": lambda c: F.count(c)}).select("position", "column_name")
    kind = F.when(F.col("whole"), "INTEGER").when(F.col("real"), "REAL").otherwise("TEXT")
    return names.join(F.broadcast(tested), "column_name", "left").select(
        "position", "column_name", kind.alias("storage_type"))
