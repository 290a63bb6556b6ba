"""Files, worksheets and run history, all derived from the given tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import workflows
from tablewright.operators import sheets
from tablewright.plans import zones
from tablewright.session import scratch_path
from tablewright.sources import delimited, detect, ingest, runs

from . import sqltext as q
from .base import query
from .q_clean import MIXED_SQL, mixed
from .q_zones import RUN_TIME, curated, curated_ctes
from .views import COLUMNS, ZONE_TABLE, ctes, table, view

CUSTOMER = COLUMNS["dirty_customer"]
PRODUCT = COLUMNS["dirty_product"]


@query("s1_read_delimited", ctes("dirty_customer") + "SELECT * FROM dirty_customer")
def s1_read_delimited(spark, sf):
    path = scratch_path(spark, "s1")
    delimited.write_delimited(view(spark, sf, "dirty_customer"), path, sep=";")
    back = delimited.read_delimited(spark, path, seq="_arrival")
    return back.drop("_arrival").withColumn("seq", F.col("seq").cast("bigint"))


@query("s1_read_documents", "SELECT doc_id, length(text) AS chars, md5(text) AS digest, lang, source, n_chars FROM documents")
def s1_read_documents(spark, sf):
    """Whole texts with quotes and line breaks through a delimited file."""
    path = scratch_path(spark, "s1d")
    delimited.write_delimited(table(spark, sf, "documents"), path)
    back = delimited.read_delimited(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("chars"),
                       F.md5("text").alias("digest"), "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


FOLDERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}


# Four delimiters, three encodings and two column orders in one folder; the files
# of the last kind lack a column.
KINDS = {0: (",", "UTF-8", False), 1: (";", "ISO-8859-1", True), 2: ("\t", "UTF-16", False), 3: ("|", "UTF-8", True)}


@query("s1_mixed_folder", """SELECT p_partkey AS id, p_name || ' é' AS "name", CASE WHEN p_partkey % 4 <> 3 THEN p_brand END AS brand,
  p_size AS size FROM part""")
def s1_mixed_folder(spark, sf):
    path = scratch_path(spark, "s1m")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" é")).alias("name"),
                                           F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    for k, (sep, charset, turned) in KINDS.items():
        # an accent in the header would end each file's plain ASCII head; the names hold one anyway
        cols = ["size", "name", "id"] if k == 3 else ["brand", "size", "name", "id"] if turned else ["id", "name", "brand", "size"]
        delimited.write_delimited(part.filter(F.col("id") % 4 == k).select(*cols), f"{path}/{k}", sep, charset)
    back = delimited.read_delimited(spark, path)
    return back.select(F.col("id").cast("bigint").alias("id"), "name", "brand", F.col("size").cast("int").alias("size"))


@query("s1_dropped_cells", """SELECT 'wide' AS folder, count(*) AS n FROM part WHERE p_size % 7 = 0""")
def s1_dropped_cells(spark, sf):
    """Rows with a cell beyond the header are counted."""
    path = scratch_path(spark, "s1w")
    # the header names two columns; what is too much stands unquoted in the second
    more = F.when(F.col("p_size") % 7 == 0, F.concat("p_brand", F.lit(",more"))).otherwise(F.col("p_brand"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), more.alias("brand"))
    rows.write.options(header=True, quote="").csv(f"{path}/wide")
    found = delimited.dropped_cells(spark, f"{path}/wide", sep=",")
    return found.groupBy(F.lit("wide").alias("folder")).agg(F.sum("n").alias("n"))


@query("s2_delimiter_profile", ctes("dirty_product") + " UNION ALL ".join(
    f"SELECT '{name}' AS folder, '{name}' AS delimiter, count(*) AS n FROM dirty_product WHERE seq % 4 = {i}"
    for i, name in enumerate(FOLDERS)))
def s2_delimiter_profile(spark, sf):
    base = scratch_path(spark, "s2")
    df = view(spark, sf, "dirty_product")
    for i, (name, sep) in enumerate(FOLDERS.items()):
        delimited.write_delimited(df.filter(F.col("seq") % 4 == i), f"{base}/{name}", sep)
    found = detect.detect(spark, base)
    names = {sep: name for name, sep in FOLDERS.items()}
    kinds = found.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder"), "delimiter").distinct()
    rows = None
    for name in FOLDERS:
        one = delimited.read_delimited(spark, f"{base}/{name}", seq="_arrival").groupBy(F.lit(name).alias("folder")).agg(
            F.count("product_name").alias("n"))
        rows = one if rows is None else rows.unionAll(one)
    label = F.coalesce(*[F.when(F.col("delimiter") == sep, F.lit(name)) for sep, name in names.items()])
    return kinds.join(rows, "folder").select("folder", label.alias("delimiter"), "n")


REPORT_SQL = """SELECT 'kind_{k}' AS filename, 'csv' AS file_kind, '{delimiter}' AS delimiter, '{encoding}' AS encoding, count(*) AS total_rows,
  CAST(2 AS BIGINT) AS total_cols, (SELECT string_agg(p_partkey, ',' ORDER BY p_partkey) FROM (SELECT p_partkey FROM part WHERE p_partkey % 3 = {k}
  ORDER BY p_partkey LIMIT 5)) AS preview FROM part WHERE p_partkey % 3 = {k}"""
REPORTS = {0: (",", "UTF-8", "comma", "utf-8-sig"), 1: (";", "ISO-8859-1", "semicolon", "cp1252"), 2: ("|", "UTF-16", "pipe", "utf-16")}


@query("s4_file_report", " UNION ALL ".join(
    REPORT_SQL.format(k=k, delimiter=name, encoding=found) for k, (_, _, name, found) in REPORTS.items()))
def s4_file_report(spark, sf):
    """How files are written, their size and their first rows, as the report of an analysis tells."""
    base, rows = scratch_path(spark, "s4"), []
    for k, (sep, charset, _, _) in REPORTS.items():
        part = table(spark, sf, "part").filter(F.col("p_partkey") % 3 == k).orderBy("p_partkey")
        delimited.write_delimited(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("pièce")), f"{base}/kind_{k}", sep, charset)
        r = workflows.file_report(spark, f"{base}/kind_{k}")
        rows.append((*[r[n] for n in ("filename", "file_kind", "delimiter", "encoding", "total_rows", "total_cols")],
                     ",".join(p["id"] for p in r["preview_rows"])))
    return spark.createDataFrame(rows, "filename string, file_kind string, delimiter string, encoding string, total_rows bigint, "
                                       "total_cols bigint, preview string")


ENCODINGS = {"utf8": ("UTF-8", "utf-8-sig"), "utf16": ("UTF-16", "utf-16"), "latin": ("ISO-8859-1", "cp1252")}


@query("s3_encoding", " UNION ALL ".join(
    f"SELECT '{f}' AS folder, '{found}' AS encoding, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents"
    for f, (_, found) in ENCODINGS.items()))
def s3_encoding(spark, sf):
    base = scratch_path(spark, "s3")
    # An accent in the header puts one into the head of every file.
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("clé"), "text")
    for f, (charset, _) in ENCODINGS.items():
        delimited.write_delimited(df, f"{base}/{f}", encoding=charset)
    kinds = detect.detect(spark, base).select(
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder"), "encoding").distinct()
    rows = None
    for f in ENCODINGS:
        one = delimited.read_delimited(spark, f"{base}/{f}").groupBy(F.lit(f).alias("folder")).agg(
            F.count("clé").alias("n"), F.sum(F.length("text")).alias("chars"))
        rows = one if rows is None else rows.unionAll(one)
    return kinds.join(rows, "folder")


@query("s5_ingest_counts", ctes(*COLUMNS) + " UNION ALL ".join(
    f"SELECT 'raw_{ZONE_TABLE[v]}' AS table_name, count(*) AS \"rows\" FROM {v}" for v in COLUMNS))
def s5_ingest_counts(spark, sf):
    folder, zone = scratch_path(spark, "s5-in"), scratch_path(spark, "s5-out")
    for v, cols in COLUMNS.items():
        delimited.write_delimited(view(spark, sf, v).select(*[f"`{c}`" for c in cols]), f"{folder}/{ZONE_TABLE[v]}.csv")
    counts = ingest.ingest(spark, folder, zone, RUN_TIME)
    return zones.row_counts({t: spark.read.parquet(f"{zone}/{t}") for t in counts})


def hash_sql(null_empty):
    cell = (lambda c: f"coalesce(nullif(\"{c}\", ''), 'None')") if null_empty else (lambda c: f"coalesce(\"{c}\", 'None')")
    return f"sha256(concat_ws('|', {', '.join(cell(c) for c in CUSTOMER)}))"


@query("s6_row_hash", ctes("dirty_customer") + f"""SELECT seq, 'customers.csv' AS _source_file, {hash_sql(False)} AS _row_hash
FROM dirty_customer""")
def s6_row_hash(spark, sf):
    return zones.stamp(view(spark, sf, "dirty_customer"), CUSTOMER, F.lit("customers.csv"), RUN_TIME).select(
        "seq", "_source_file", "_row_hash")


@query("s7_row_hash_any", ctes("dirty_customer") + f"SELECT seq, {hash_sql(True)} AS _row_hash FROM dirty_customer")
def s7_row_hash_any(spark, sf):
    return view(spark, sf, "dirty_customer").select("seq", zones.row_hash(CUSTOMER, empty_as_none=True).alias("_row_hash"))


@query("s8_overwrite_idempotent", ctes("dirty_product") + "SELECT * FROM dirty_product")
def s8_overwrite_idempotent(spark, sf):
    path = scratch_path(spark, "s8")
    for _ in range(2):
        ingest.overwrite(view(spark, sf, "dirty_product"), path)
    return spark.read.parquet(path)


@query("s9_clean_sink", MIXED_SQL + f"""SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in CUSTOMER)}, _quality_flag
FROM cleaned""")
def s9_clean_sink(spark, sf):
    path = scratch_path(spark, delimited.cleaned_name("customers.csv", "20250101_000000"))
    mixed(spark, sf).write(path, "csv", header=True, emptyValue="", quote='"', escape='"',
                           ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return delimited.read_delimited(spark, path, sep=",").drop("seq")


HR_TYPED = {"salary": "real", "performance_score": "int", "is_active": "int"}


@query("s11_typed_curated", curated_ctes("dirty_hr") + "SELECT seq, " + ", ".join(
    f"{q.real(c)} AS {c}" if HR_TYPED.get(c) == "real" else
    f"CASE WHEN regexp_matches({c}, '{q.INT}') THEN try_cast({c} AS BIGINT) END AS {c}" if c in HR_TYPED else c
    for c in COLUMNS["dirty_hr"]) + ", _quality_flag FROM cur_dirty_hr")
def s11_typed_curated(spark, sf):
    return zones.typed(curated(spark, sf, "dirty_hr"), "hr_records").drop("_cleansed_at", "_is_duplicate")


# --- worksheets --------------------------------------------------------------

# One sheet per brand: a merged two-level header over four columns, body rows
# in stacked tables with a blank row after every 30th part, and a fifth column
# without a header that holds the brand, merged over pairs of rows.
GRID = """
gbody AS (SELECT p_brand AS sheet_id, p_partkey, p_name, p_size, p_retailprice,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM {part}),
gplace AS (SELECT *, CAST(2 + rn + floor((rn - 1) / 30) AS INT) AS r FROM gbody),
gsheet AS (SELECT DISTINCT sheet_id FROM gbody),
cells AS (
  SELECT sheet_id, 1 AS "row", 1 AS col, 'Product' AS "value", 'str' AS vtype FROM gsheet
  UNION ALL SELECT sheet_id, 1, 2, NULL, 'null' FROM gsheet
  UNION ALL SELECT sheet_id, 1, 3, 'size', 'str' FROM gsheet
  UNION ALL SELECT sheet_id, 1, 4, 'Price', 'str' FROM gsheet
  UNION ALL SELECT sheet_id, 1, 5, NULL, 'null' FROM gsheet
  UNION ALL SELECT sheet_id, 2, 1, 'ID', 'str' FROM gsheet
  UNION ALL SELECT sheet_id, 2, 2, ' Name ', 'str' FROM gsheet
  UNION ALL SELECT sheet_id, 2, 3, 'Size', 'str' FROM gsheet
  UNION ALL SELECT sheet_id, 2, 4, NULL, 'null' FROM gsheet
  UNION ALL SELECT sheet_id, 2, 5, NULL, 'null' FROM gsheet
  UNION ALL SELECT sheet_id, r, 1, CAST(p_partkey AS STRING) || '.0', 'float' FROM gplace
  UNION ALL SELECT sheet_id, r, 2, p_name, 'str' FROM gplace
  UNION ALL SELECT sheet_id, r, 3, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS STRING) END,
    CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE 'int' END FROM gplace
  UNION ALL SELECT sheet_id, r, 4, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-0' || CAST(1 + p_partkey % 9 AS STRING) || ' 00:00:00'
    ELSE '2024-01-01 10:30:0' || CAST(p_partkey % 10 AS STRING) END, 'datetime' FROM gplace
  UNION ALL SELECT sheet_id, r, 5, CASE WHEN rn % 2 = 1 THEN sheet_id END, CASE WHEN rn % 2 = 1 THEN 'str' ELSE 'null' END FROM gplace
  UNION ALL SELECT sheet_id, r + 1, c, '  ', 'str' FROM gplace CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2 UNION ALL SELECT 3
    UNION ALL SELECT 4 UNION ALL SELECT 5) k WHERE rn % 30 = 0),
merges AS (
  SELECT sheet_id, 1 AS min_row, 1 AS max_row, 1 AS min_col, 2 AS max_col FROM gsheet
  UNION ALL SELECT sheet_id, r, r + 1, 5, 5 FROM gplace WHERE rn % 2 = 1 AND rn % 30 <> 0
    AND EXISTS (SELECT 1 FROM gplace o WHERE o.sheet_id = gplace.sheet_id AND o.rn = gplace.rn + 1))
"""


def grid(spark, sf):
    sql = GRID.replace('"', "`").replace(
        "gplace CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2 UNION ALL SELECT 3\n    UNION ALL SELECT 4 UNION ALL SELECT 5) k",
        "gplace LATERAL VIEW explode(array(1, 2, 3, 4, 5)) k AS c")
    part = table(spark, sf, "part")
    out = []
    for name in ("cells", "merges"):
        path = scratch_path(spark, name)
        ingest.overwrite(spark.sql(f"WITH {sql} SELECT * FROM {name}", part=part), path)
        out.append(spark.read.parquet(path))
    return tuple(out)


GRID_SQL = "WITH " + GRID.replace("{part}", "part").replace("cells AS (", "cells AS MATERIALIZED (").replace(
    "merges AS (", "merges AS MATERIALIZED (")
FILL_SQL = GRID_SQL + """, mrows AS (SELECT sheet_id, min_row, min_col, max_col, unnest(range(min_row, max_row + 1)) AS "row" FROM merges),
covered AS MATERIALIZED (SELECT sheet_id, min_row, min_col, "row", unnest(range(min_col, max_col + 1)) AS col FROM mrows),
filled AS MATERIALIZED (SELECT c.sheet_id, c."row", c.col,
  CASE WHEN m.sheet_id IS NOT NULL THEN t."value" ELSE c."value" END AS "value",
  CASE WHEN m.sheet_id IS NOT NULL THEN t.vtype ELSE c.vtype END AS vtype
FROM cells c LEFT JOIN covered m ON c.sheet_id = m.sheet_id AND c."row" = m."row" AND c.col = m.col
LEFT JOIN cells t ON t.sheet_id = m.sheet_id AND t."row" = m.min_row AND t.col = m.min_col),
texts AS (SELECT sheet_id, "row", col, CASE WHEN "value" IS NULL THEN '' WHEN vtype = 'datetime' AND "value" LIKE '% 00:00:00'
  THEN left("value", 10) WHEN vtype = 'float' AND CAST(try_cast("value" AS DOUBLE) AS BIGINT) = try_cast("value" AS DOUBLE)
  THEN CAST(CAST(try_cast("value" AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE "value" END AS text FROM filled),
shape AS (SELECT sheet_id, (SELECT count(*) FROM merges m WHERE m.sheet_id = f.sheet_id) AS merged,
  count(*) FILTER ("row" = 1 AND "value" <> '') AS g1, count(*) FILTER ("row" = 2 AND "value" <> '') AS g2,
  count(*) FILTER ("row" = 2 AND vtype NOT IN ('null', 'str')) AS other FROM filled f WHERE "row" <= 2 GROUP BY 1),
shaped AS (SELECT sheet_id, merged, g2 > 0 AND other = 0 AND merged > 0 AND g2 >= greatest(2, g1 - 1) AS two FROM shape),
heads AS (SELECT a.sheet_id, a.col, coalesce(trim(a."value"), '') AS t, coalesce(trim(b."value"), '') AS s, two FROM filled a
  JOIN filled b ON a.sheet_id = b.sheet_id AND a.col = b.col AND a."row" = 1 AND b."row" = 2
  JOIN shaped ON shaped.sheet_id = a.sheet_id),
named AS (SELECT sheet_id, col, CASE WHEN h = '' THEN 'col_' || col ELSE h END AS header FROM (SELECT sheet_id, col,
  CASE WHEN NOT two THEN t WHEN t <> '' AND s <> '' AND lower(t) <> lower(s) THEN t || ' ' || s WHEN s <> '' THEN s ELSE t END
  AS h FROM heads)),
body AS (SELECT DISTINCT f.sheet_id, f."row" FROM filled f JOIN shaped s ON s.sheet_id = f.sheet_id
  WHERE trim("value") <> '' AND f."row" > CASE WHEN two THEN 2 ELSE 1 END),
isl AS (SELECT sheet_id, "row", "row" - row_number() OVER (PARTITION BY sheet_id ORDER BY "row") AS g FROM body),
blk AS (SELECT sheet_id, "row", min("row") OVER (PARTITION BY sheet_id, g) AS block FROM isl),
siz AS (SELECT sheet_id, block, count(*) AS n FROM blk GROUP BY 1, 2),
cho AS (SELECT sheet_id, block FROM siz QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, block) = 1)
"""


@query("x1_unmerge", FILL_SQL + 'SELECT sheet_id, "row", col, "value", vtype FROM filled')
def x1_unmerge(spark, sf):
    return sheets.unmerge(*grid(spark, sf))


@query("x2_cell_text", FILL_SQL + 'SELECT sheet_id, "row", col, text FROM texts')
def x2_cell_text(spark, sf):
    return sheets.unmerge(*grid(spark, sf)).select(
        "sheet_id", "row", "col", sheets.cell_text(F.col("value"), F.col("vtype")).alias("text"))


@query("x3_header_fold", FILL_SQL + "SELECT * FROM named")
def x3_header_fold(spark, sf):
    cells, merges = grid(spark, sf)
    filled = sheets.unmerge(cells, merges)
    return sheets.headers(filled, sheets.header_shape(filled, merges))


@query("x4_blocks", FILL_SQL + 'SELECT sheet_id, "row", block FROM blk')
def x4_blocks(spark, sf):
    cells, merges = grid(spark, sf)
    filled = sheets.unmerge(cells, merges)
    # Small buckets, so that blocks run across them even at test size.
    return sheets.blocks(sheets.body_rows(filled, sheets.header_shape(filled, merges)), rows_per_bucket=16)


@query("x4_chosen", FILL_SQL + """SELECT cho.sheet_id, cho.block, count(*) AS tables_detected FROM cho JOIN siz
  ON siz.sheet_id = cho.sheet_id GROUP BY 1, 2""")
def x4_chosen(spark, sf):
    cells, merges = grid(spark, sf)
    filled = sheets.unmerge(cells, merges)
    blocked = sheets.blocks(sheets.body_rows(filled, sheets.header_shape(filled, merges)))
    return sheets.chosen_blocks(sheets.block_sizes(blocked))


@query("x5_rows", FILL_SQL + """SELECT t.sheet_id, t."row", string_agg(header || '=' || text, '|' ORDER BY t.col) AS record
FROM texts t JOIN named n ON n.sheet_id = t.sheet_id AND n.col = t.col
JOIN blk b ON b.sheet_id = t.sheet_id AND b."row" = t."row" JOIN cho ON cho.sheet_id = b.sheet_id AND cho.block = b.block
GROUP BY 1, 2""")
def x5_rows(spark, sf):
    rows, _ = sheets.read_sheets(*grid(spark, sf))
    pairs = F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("sheet_id", "row", F.array_join(pairs, "|").alias("record"))


SHEET_ROWS_SQL = FILL_SQL + """, srow AS (SELECT t.sheet_id, b."row" AS seq, max(text) FILTER (t.col = 1) AS id,
  max(text) FILTER (t.col = 2) AS "name", nullif(max(text) FILTER (t.col = 3), '') AS size FROM texts t
  JOIN blk b ON b.sheet_id = t.sheet_id AND b."row" = t."row"
  JOIN cho ON cho.sheet_id = b.sheet_id AND cho.block = b.block GROUP BY 1, 2)
"""


def clean_grid(spark, sf, **actions):
    done, _ = workflows.clean_sheets(*grid(spark, sf), {"columns": {c.replace("_", " "): {"action": a} for c, a in actions.items()}})
    return done


def all_runs(done, table_of):
    return functools.reduce(DataFrame.unionByName, [table_of(one) for one in done])


@query("x5_clean_sheet", SHEET_ROWS_SQL + """SELECT sheet_id, seq, id AS "Product ID", trim("name") AS "Product Name",
  coalesce(size, 'Unknown') AS "Size" FROM srow""")
def x5_clean_sheet(spark, sf):
    """The rows of all worksheets as columns, profiled and cleaned in one run."""
    done = clean_grid(spark, sf, Size="fill_missing_unknown", Product_Name="trim_whitespace")
    assert all([c.name for c in one.report.columns] == one.table.names for one in done)
    return all_runs(done, lambda one: one.result.data.select(
        F.col(one.table.sheet).alias("sheet_id"), F.col(one.table.row).alias("seq"), "Product ID", "Product Name", "Size"))


@query("x5_sheet_medians", SHEET_ROWS_SQL + """, sized AS (SELECT sheet_id, CAST(size AS INT) AS x,
  row_number() OVER (PARTITION BY sheet_id ORDER BY CAST(size AS INT)) - 1 AS i, count(*) OVER (PARTITION BY sheet_id) AS n
  FROM srow WHERE size IS NOT NULL),
med AS (SELECT sheet_id, CAST(x AS VARCHAR) AS median FROM sized WHERE i = n // 2)
SELECT s.sheet_id, seq, id AS "Product ID", coalesce(size, median) AS "Size" FROM srow s LEFT JOIN med m ON m.sheet_id = s.sheet_id""")
def x5_sheet_medians(spark, sf):
    """Missing sizes filled with the median of their own sheet."""
    return all_runs(clean_grid(spark, sf, Size="fill_missing_median"), lambda one: one.result.data.select(
        F.col(one.table.sheet).alias("sheet_id"), F.col(one.table.row).alias("seq"), "Product ID", "Size"))


@query("x5_sheet_log", SHEET_ROWS_SQL + """SELECT sheet_id, 'Size' AS column_name, 'filled' AS change, count(*) AS n FROM srow
WHERE size IS NULL AND sheet_id IN (SELECT sheet_id FROM srow WHERE size IS NOT NULL) GROUP BY 1""")
def x5_sheet_log(spark, sf):
    return all_runs(clean_grid(spark, sf, Size="fill_missing_mode"), lambda one: one.result.change_log()
                    .withColumnRenamed(one.table.sheet, "sheet_id"))


@query("x5_facts", FILL_SQL + """SELECT shaped.sheet_id, merged AS merged_cells_filled, CAST(two AS INT) AS multi_level_header,
  (SELECT count(*) FROM siz WHERE siz.sheet_id = shaped.sheet_id) AS tables_detected FROM shaped""")
def x5_facts(spark, sf):
    _, facts = sheets.read_sheets(*grid(spark, sf))
    return facts.withColumn("multi_level_header", F.col("multi_level_header").cast("int"))


# --- run history: one cleaning run per order day ------------------------------

DAYS = """SELECT 'RUN_' || replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') AS run_id, count(*) AS original_rows,
  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS rows_dropped, min(o_custkey) % 5 AS k
FROM {orders} GROUP BY substr(CAST(o_orderdate AS STRING), 1, 10)"""
RUNS = f"""SELECT run_id, CASE WHEN k <> 0 THEN run_id || '.csv' END AS filename, CASE WHEN k = 1 THEN 'FAILED'
  WHEN k = 2 THEN 'SUCCESS' END AS status, original_rows, CASE WHEN k <> 3 THEN original_rows - rows_dropped END AS cleaned_rows,
  CASE WHEN k <> 4 THEN rows_dropped END AS rows_dropped, CAST(original_rows AS DOUBLE) / 4 AS elapsed_sec FROM ({DAYS}) d"""
RUNS_SQL = RUNS.replace("{orders}", "orders")
LIST_SQL = f"""SELECT run_id, coalesce(filename, '—') AS filename, coalesce(cleaned_rows, original_rows) AS "rows",
  coalesce(rows_dropped, 0) AS dropped, elapsed_sec AS elapsed, coalesce(status, 'SUCCESS') AS status FROM ({RUNS_SQL}) r"""


def run_log(spark, sf):
    path = scratch_path(spark, "runs")
    records = spark.sql(RUNS, orders=table(spark, sf, "orders"))
    even = F.col("run_id").rlike("[02468]$")
    runs.append_runs(records.filter(even), path)
    runs.append_runs(records.filter(~even), path)
    return path


@query("r1_runs", LIST_SQL + " ORDER BY run_id DESC LIMIT 20")
def r1_runs(spark, sf):
    return runs.latest_runs(spark, run_log(spark, sf))


@query("r2_run", f"""SELECT run_id, filename, status, original_rows, cleaned_rows, rows_dropped, CAST(NULL AS BIGINT) AS poor_rows,
  elapsed_sec FROM ({RUNS_SQL}) r WHERE run_id = (SELECT max(run_id) FROM ({RUNS_SQL}) m)""")
def r2_run(spark, sf):
    path = run_log(spark, sf)
    last = runs.read_runs(spark, path).agg(F.max("run_id")).first()[0]
    return runs.get_run(spark, path, last)


@query("r3_append", RUNS_SQL)
def r3_append(spark, sf):
    return runs.read_runs(spark, run_log(spark, sf)).drop("poor_rows")
