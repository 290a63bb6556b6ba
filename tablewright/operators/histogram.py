"""Value histograms and what follows from them: blanks, distinct counts, case
variants, invalid e-mails, numbers, modes, samples.

Counts merge before the shuffle, so a value that fills a third of a column
travels as one row per task, and everything derived later looks at each distinct
value once instead of at every cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from .cells import by_name, long_cells


def filled(value):
    return ~text.is_blank(value)


def value_histogram(df: DataFrame, cols: list[str]) -> DataFrame:
    """position, key, n, padded, and for long texts fold, email, number.

    One row per distinct stripped value of each column, blanks included: ``n``
    cells, ``padded`` of them with outer whitespace.  A text over 64 characters
    is represented by a digest, next to which stands what can no longer be read
    off the key.
    """
    cells = long_cells(df, cols).select("position", "value", text.strip(F.col("value")).alias("s"))
    s = F.col("s")
    long = F.length(s) > text.KEY_LENGTH
    keyed = cells.select(
        "position", F.coalesce(text.compact_key(s), F.lit("")).alias("key"),
        F.when(long, text.compact_key(F.lower(s))).alias("fold"),
        F.when(long, text.is_email(s)).alias("email"),
        F.when(long, numbers.number(s)).alias("number"),
        F.coalesce((F.col("value") != s).cast("int"), F.lit(0)).alias("padded"))
    return keyed.groupBy("position", "key", "fold", "email", "number").agg(
        F.count("*").alias("n"), F.sum("padded").alias("padded"))


def _blank():
    # Keys are stripped and never NULL.
    return F.lower("key").isin("", *text.BLANK_TOKENS)


def column_counts(hist: DataFrame) -> DataFrame:
    """position, total_rows, null_count, unique_count, whitespace_count."""
    return hist.groupBy("position").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(_blank(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(~_blank()).alias("unique_count"),
        F.sum("padded").alias("whitespace_count"))


def _of(hist: DataFrame, cols: list[str], names: list[str]) -> DataFrame:
    """Filled values of some of the columns, by name."""
    places = {cols.index(c): c for c in names}
    return hist.filter(F.col("position").isin(list(places)) & ~_blank()).withColumn(
        "column_name", by_name(F.col("position"), places))


def case_variants(hist: DataFrame, cols: list[str], names: list[str]) -> DataFrame:
    """column_name, case_issues: cells that are not in the commonest spelling
    of their value, spellings differing only in case."""
    spellings = _of(hist, cols, names).select("column_name", F.coalesce("fold", F.lower("key")).alias("fold"), "n")
    folded = spellings.groupBy("column_name", "fold").agg((F.sum("n") - F.max("n")).alias("odd"))
    return folded.groupBy("column_name").agg(F.sum("odd").alias("case_issues"))


def invalid_emails(hist: DataFrame, cols: list[str], names: list[str]) -> DataFrame:
    """column_name, email_invalid."""
    valid = F.coalesce("email", F.col("key").rlike(text.EMAIL_PATTERN))
    return _of(hist, cols, names).groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("email_invalid"))


def numeric_values(hist: DataFrame, cols: list[str], names: list[str]) -> DataFrame:
    """values(name, x, n) of the numbers in number columns."""
    x = F.coalesce("number", numbers.number(F.col("key")))
    return _of(hist, cols, names).select(F.col("column_name").alias("name"), x.alias("x"), "n").filter("x IS NOT NULL")


def distinct_counts(df: DataFrame, cols: list[str], keep=filled, raw: bool = False) -> DataFrame:
    """column_name, filled, distinct over the cells that satisfy ``keep``;
    stripped unless ``raw``.  Long texts are counted by digest."""
    cells = long_cells(df, cols, keep=keep)
    value = F.col("value") if raw else text.strip(F.col("value"))
    keyed = cells.select("column_name", value.alias("value")).select("column_name", text.compact_key(F.col("value")).alias("key"))
    counts = keyed.groupBy("column_name", "key").agg(F.count("*").alias("n"))
    return counts.groupBy("column_name").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct"))


def modes(df: DataFrame, cols: list[str], seq: str) -> DataFrame:
    """column_name, mode: commonest raw text of each column, the first seen
    among equals."""
    cells = long_cells(df, cols, seq, keep=filled)
    counts = cells.groupBy("column_name", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("value"))).alias("best")
    return counts.groupBy("column_name").agg(best).select("column_name", F.col("best.value").alias("mode"))


def samples(hist: DataFrame, df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """position, column_name, value, rank: the k smallest values of each column.

    Short texts are their own keys.  Columns that also hold long texts are asked
    for their least value, then for the least above it, k times: a wide aggregate
    over all of them that moves one row per task, so no long text is shuffled."""
    filled_ = _of(hist, cols, cols)
    long = {r["column_name"] for r in filled_.filter(F.col("key").startswith("\0")).select("column_name").distinct().collect()}
    order = Window.partitionBy("position", "column_name").orderBy("value")
    schema = "position int, column_name string, value string, rank int"
    out = (filled_.filter(~F.col("column_name").isin(list(long))).select("position", "column_name", F.col("key").alias("value"))
           .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    if not long:
        return out
    names, found, last = [c for c in cols if c in long], [], {}
    for rank in range(1, k + 1):
        least = []
        for i, c in enumerate(names):
            value = text.strip(text.quoted(c))
            above = F.lit(True) if rank == 1 else F.lit(False) if last[c] is None else value > F.lit(last[c])
            least.append(F.min(F.when(filled(text.quoted(c)) & above, value)).alias(f"v{i}"))
        row = df.agg(*least).first()
        last = {c: row[f"v{i}"] for i, c in enumerate(names)}
        found += [(cols.index(c), c, v, rank) for c, v in last.items() if v is not None]
    return out.unionByName(hist.sparkSession.createDataFrame(found, schema))
