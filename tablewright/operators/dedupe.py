"""Keep-first deduplication and duplicate counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def keep_first(df: DataFrame, keys: list[Column], seq: str) -> DataFrame:
    """First row, in arrival order, of every key.

    Spark turns ``row_number = 1`` into a group limit on both sides of the
    shuffle: a task forwards one row per key, so a key that holds a third of
    the table reaches its reducer as one row per task.
    """
    order = Window.partitionBy(*keys).orderBy(seq)
    rank = text.free_prefix(df.columns) + "rank"
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)


def with_row_keys(df: DataFrame, cols: list[str], exact: str | None = None, folded: str | None = None) -> DataFrame:
    """Add digests of the stripped row, as it is and in lower case.

    A digest shuffles 64 characters in place of a second copy of the row.  The
    cells are stripped and folded in projections of their own, once each.
    """
    free = text.free_prefix(df.columns) + "s"
    names = [f"{free}{i}" for i in range(len(cols))]
    out = df.withColumns({n: text.strip(text.quoted(c)) for n, c in zip(names, cols)})
    out = out.withColumns({n: F.coalesce(n, F.lit("")) for n in names})
    digest = lambda: text.row_digest([F.col(n) for n in names])
    if exact:
        out = out.withColumn(exact, digest())
    if folded:
        out = out.withColumns({n: F.lower(n) for n in names}).withColumn(folded, digest())
    return out.drop(*names)


def drop_full_duplicates(df: DataFrame, cols: list[str], seq: str, by: list[str] = ()) -> DataFrame:
    """``by``: columns whose values are tables of their own, as for all functions here."""
    key = text.free_prefix(df.columns) + "key"
    return keep_first(with_row_keys(df, cols, exact=key), [*map(text.quoted, by), F.col(key)], seq).drop(key)


def drop_near_duplicates(df: DataFrame, cols: list[str], seq: str, by: list[str] = ()) -> DataFrame:
    """Rows that differ only in case and outer whitespace count as one."""
    key = text.free_prefix(df.columns) + "key"
    return keep_first(with_row_keys(df, cols, folded=key), [*map(text.quoted, by), F.col(key)], seq).drop(key)


def drop_key_duplicates(df: DataFrame, key: str, seq: str, by: list[str] = ()) -> DataFrame:
    """Rows with an empty key are all kept: each is a group of its own, so they
    are spread over all tasks."""
    value = F.coalesce(text.strip(text.quoted(key)), F.lit(""))
    return keep_first(df, [*map(text.quoted, by), value, F.when(value == "", text.quoted(seq))], seq)


def duplicate_counts(df: DataFrame, cols: list[str], seq: str) -> DataFrame:
    """One row: total_rows, full_duplicates, near_duplicates.

    A near duplicate equals an earlier row but for case and outer whitespace,
    and is not spelled like the first of them.  Digests with counts are
    shuffled, never rows; identical rows merge before the shuffle.
    """
    free = text.free_prefix(df.columns)
    keyed = with_row_keys(df, cols, exact=free + "exact", folded=free + "folded")
    spelled = keyed.select(F.col(free + "folded").alias("norm"), F.col(free + "exact").alias("exact"), text.quoted(seq).alias("seq"))
    spellings = spelled.groupBy("norm", "exact").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    groups = spellings.groupBy("norm").agg(
        F.sum("n").alias("rows"), F.count("*").alias("spellings"), F.min_by("n", "first").alias("first_n"))
    return groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("rows") - F.col("spellings")), F.lit(0)).alias("full_duplicates"),
        F.coalesce(F.sum(F.col("rows") - F.col("first_n")), F.lit(0)).alias("near_duplicates"),
    )
