"""Repairs of worksheets kept as cells, over any number of sheets.

``cells(sheet_id, row, col, value, vtype)`` holds the text of each cell and the
type it had: null, str, int, float, bool, date or datetime.  ``merges(sheet_id,
min_row, max_row, min_col, max_col)`` holds the merged ranges.  Rows and
columns count from 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.naming import column_names
from ..session import stage

ROWS_PER_BUCKET = 65_536  # rows of one sheet that one task orders


def unmerge(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of a merged range takes the value of its top-left cell.

    Ranges are expanded to the cells they cover, so the join is on the cell's
    place and needs no range comparison; a sheet with a third of all cells is
    spread by row and column.
    """
    corner = cells.select("sheet_id", F.col("row").alias("min_row"), F.col("col").alias("min_col"),
                          F.col("value").alias("top_value"), F.col("vtype").alias("top_type"))
    filled = merges.join(corner, ["sheet_id", "min_row", "min_col"])
    covered = (
        filled.withColumn("row", F.explode(F.sequence("min_row", "max_row")))
        .withColumn("col", F.explode(F.sequence("min_col", "max_col")))
        .select("sheet_id", "row", "col", "top_value", "top_type", F.lit(True).alias("covered"))
    )
    joined = cells.join(covered, ["sheet_id", "row", "col"], "left")
    pick = lambda new, old: F.when(F.col("covered"), F.col(new)).otherwise(F.col(old))
    return joined.select("sheet_id", "row", "col", pick("top_value", "value").alias("value"),
                         pick("top_type", "vtype").alias("vtype"))


def cell_text(value: Column, vtype: Column) -> Column:
    """Nothing for null, the day for a midnight, no fraction for a whole float."""
    number = value.try_cast("double")
    whole = number == F.floor(number)
    return (
        F.when(value.isNull() | (vtype == "null"), "")
        .when((vtype == "datetime") & value.rlike(r"[ T]00:00:00(\.0+)?$"), F.left(value, F.lit(10)))
        .when(vtype == "datetime", F.regexp_replace(value, "T", " "))
        # floats from 1e38 on have no fraction to drop: they stay as written
        .when((vtype == "float") & whole, F.coalesce(value.try_cast("decimal(38,0)").cast("string"), value))
        .otherwise(value)
    )


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def header_shape(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """sheet_id, merged_cells_filled, multi_level_header: whether the second
    row is a second level of the header.  Only two rows per sheet are read."""
    top = cells.filter("row <= 2")
    first, second = F.col("row") == 1, F.col("row") == 2
    counts = top.groupBy("sheet_id").agg(
        F.count_if(first & _given(F.col("value"))).alias("first_given"),
        F.count_if(second & _given(F.col("value"))).alias("second_given"),
        F.count_if(second & ~F.col("vtype").isin("null", "str")).alias("second_other"))
    merged = merges.groupBy("sheet_id").agg(F.count("*").alias("merged"))
    n = F.coalesce("merged", F.lit(0))
    two = ((F.col("second_given") > 0) & (F.col("second_other") == 0) & (n > 0)
           & (F.col("second_given") >= F.greatest(F.lit(2), F.col("first_given") - 1)))
    return counts.join(merged, "sheet_id", "left").select(
        "sheet_id", n.alias("merged_cells_filled"), two.alias("multi_level_header"))


def headers(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """sheet_id, col, header."""
    level = lambda r: F.max(F.when(F.col("row") == r, text.strip(F.col("value"))))
    levels = cells.filter("row <= 2").groupBy("sheet_id", "col").agg(level(1).alias("top"), level(2).alias("sub"))
    top, sub = F.coalesce("top", F.lit("")), F.coalesce("sub", F.lit(""))
    folded = F.when((top != "") & (sub != "") & (F.lower(top) != F.lower(sub)), F.concat(top, F.lit(" "), sub)).otherwise(
        F.when(sub != "", sub).otherwise(top))
    name = F.when(F.col("multi_level_header"), folded).otherwise(top)
    return levels.join(shape, "sheet_id").select(
        "sheet_id", "col", F.when(name == "", F.concat(F.lit("col_"), F.col("col").cast("string"))).otherwise(name)
        .alias("header"))


def body_rows(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """sheet_id, row of every row below the header that is not blank."""
    filled = cells.filter(F.col("value").isNotNull() & (text.strip(F.col("value")) != ""))
    rows = filled.select("sheet_id", "row").distinct()
    below = F.when(F.col("multi_level_header"), 2).otherwise(1)
    return rows.join(shape, "sheet_id").filter(F.col("row") > below).select("sheet_id", "row")


def blocks(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """sheet_id, row, block: consecutive rows share a block, which is named by
    its first row.

    Rows are ordered in buckets of bounded size, and the last block of each
    bucket is carried to the next, so no task orders a whole sheet.
    """
    placed = rows.withColumn("bucket", F.floor(F.col("row") / rows_per_bucket))
    inside = Window.partitionBy("sheet_id", "bucket").orderBy("row")
    starts = placed.withColumn("prev", F.lag("row").over(inside)).withColumn(
        "start", F.when(F.col("prev") != F.col("row") - 1, F.col("row")))
    buckets = starts.groupBy("sheet_id", "bucket").agg(
        F.min("row").alias("first"), F.max("row").alias("last"), F.max("start").alias("last_start"))
    along = Window.partitionBy("sheet_id").orderBy("bucket")
    goes_on = F.coalesce(F.lag("last").over(along) == F.col("first") - 1, F.lit(False))
    chained = buckets.withColumn("goes_on", goes_on).withColumn(
        "own", F.coalesce("last_start", F.when(~F.col("goes_on"), F.col("first"))))
    earlier = F.max("own").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opening = chained.select("sheet_id", "bucket",
                             F.when(F.col("goes_on"), earlier).otherwise(F.col("first")).alias("opening"))
    return starts.withColumn("latest", F.max("start").over(inside)).join(opening, ["sheet_id", "bucket"]).select(
        "sheet_id", "row", F.coalesce("latest", "opening").alias("block"))


def block_sizes(blocked: DataFrame) -> DataFrame:
    """sheet_id, block, n."""
    return blocked.groupBy("sheet_id", "block").agg(F.count("*").alias("n"))


def chosen_blocks(sizes: DataFrame) -> DataFrame:
    """sheet_id, block, tables_detected: the longest block, the first if tied."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("block"))).alias("best")
    return sizes.groupBy("sheet_id").agg(best, F.count("*").alias("tables_detected")).select(
        "sheet_id", "best.block", "tables_detected")


def read_sheets(cells: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, facts).  Rows: sheet_id, row, record, a map from header to text;
    a repeated header gets _2.  Facts: one row per sheet."""
    # Both are read several times: join and order once.
    filled = stage(unmerge(cells, merges), "cells")
    shape = header_shape(filled, merges)
    blocked = stage(blocks(body_rows(filled, shape)), "blocks")
    chosen = chosen_blocks(block_sizes(blocked))
    again = F.row_number().over(Window.partitionBy("sheet_id", "header").orderBy("col"))
    # Stored, so that a join on a sheet that holds a third of all cells can be split.
    named = stage(headers(filled, shape).withColumn("again", again).select(
        "sheet_id", "col",
        F.when(F.col("again") > 1, F.concat("header", F.lit("_"), F.col("again").cast("string")))
        .otherwise(F.col("header")).alias("header")), "headers")
    chosen = stage(chosen, "chosen")
    rows = blocked.join(chosen, ["sheet_id", "block"], "left_semi").select("sheet_id", "row")
    texts = filled.join(rows, ["sheet_id", "row"], "left_semi").join(named, ["sheet_id", "col"]).select(
        "sheet_id", "row", F.struct("col", "header", cell_text(F.col("value"), F.col("vtype")).alias("text")).alias("cell"))
    # A group is one row of a sheet, so a list of its cells is bounded by the
    # width of the sheet.
    lists = texts.groupBy("sheet_id", "row").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    record = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["header"], c["text"])))
    facts = shape.join(chosen.drop("block"), "sheet_id", "left").select(
        "sheet_id", "merged_cells_filled", "multi_level_header",
        F.coalesce("tables_detected", F.lit(0)).alias("tables_detected"))
    return lists.select("sheet_id", "row", record.alias("record")), facts


def sheet_table(rows: DataFrame, sheet_id) -> tuple[DataFrame, list[str]]:
    """(row and a text column per header, the headers) of one sheet of
    ``read_sheets``: a table to profile and clean, with ``row`` (or the next free
    name) as its arrival order.  Every row holds all headers, so the first tells them."""
    own = rows.filter(F.col("sheet_id") == sheet_id)
    first = own.select(F.map_keys("record").alias("names")).first()
    names = list(first["names"]) if first else []
    row = "row"
    while row in {n.lower() for n in names}:
        row += "_"
    return own.select(F.col("row").alias(row), *[F.col("record")[n].alias(n) for n in names]), names


@dataclass(frozen=True)
class SheetTable:
    """The rows of all sheets that have one header, as text columns; ``sheet`` and ``row`` name
    the columns that tell the sheet and the arrival order within it."""

    data: DataFrame
    names: list[str]
    sheet: str
    row: str


def header_tables(rows: DataFrame) -> list[SheetTable]:
    """The sheets of ``read_sheets`` by header, in the order of the headers: as many tables as there
    are headers, however many sheets.  ``rows`` is read once more for each header, so pass a
    stored table.  Headers that differ only in case get _2, as repeated ones do."""
    heads = sorted(r["names"] for r in rows.select(F.map_keys("record").alias("names")).distinct().collect())
    out = []
    for names in heads:
        cols = column_names(names)
        taken = {c.lower() for c in cols}
        free = lambda name: name if name not in taken else free(name + "_")
        sheet, row = free("sheet_id"), free("row")
        own = rows.filter(F.map_keys("record") == F.array(*[F.lit(n) for n in names]))
        data = own.select(F.col("sheet_id").alias(sheet), F.col("row").alias(row),
                          *[F.col("record")[n].alias(c) for n, c in zip(names, cols)])
        out.append(SheetTable(data, cols, sheet, row))
    return out
