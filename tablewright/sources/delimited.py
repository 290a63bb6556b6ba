"""Reading and writing delimited text with an arrival order."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.naming import column_names
from . import detect, quoted

# Names Spark knows the detected encodings by.
CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf-16": "UTF-16", "cp1252": "ISO-8859-1",
            "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1"}


def arrival() -> Column:
    """Order of rows as they stand in their files.  Use it right on a file scan."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))


# The first record of a text, which may hold line breaks inside quotes.
FIRST_RECORD = r'''^\ufeff?((?:[^"\r\n]|"(?:[^"]|"")*")*)'''


@dataclass(frozen=True)
class Dialect:
    """Files that are read alike: how, and what their columns are called."""

    encoding: str
    sep: str
    header: str
    paths: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        cells = next(csv.reader(io.StringIO(self.header, newline=""), delimiter=self.sep), [])
        fix = (lambda s: s.translate(detect.HIGH_1252)) if self.encoding == "cp1252" else (lambda s: s)
        return column_names([fix(c) for c in cells])


def dialects(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> list[Dialect]:
    """The files under ``path`` by encoding, delimiter and header, in the order of
    their first files.  Only heads of files are read; empty files are left out."""
    heads = detect.file_heads(detect.list_files(spark, path).filter("length > 0"))
    enc = F.lit(encoding) if encoding else detect.encoding(F.col("head"), F.col("length"))
    heads = heads.withColumn("enc", enc).withColumn("top", detect.head_text(F.col("head"), F.col("enc")))
    found = heads.select("path", "enc", (F.lit(sep) if sep else detect.delimiter(F.col("top"))).alias("sep"),
                         F.regexp_extract("top", FIRST_RECORD, 1).alias("header"))
    groups = found.groupBy("enc", "sep", "header").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()
    return [Dialect(g["enc"], g["sep"], g["header"], tuple(g["paths"])) for g in sorted(groups, key=lambda g: g["paths"][0])]


def _scan(spark: SparkSession, d: Dialect, multi_line: bool | None, seq: str, over: str | None) -> DataFrame:
    charset = CHARSETS.get(d.encoding, d.encoding)
    paths = list(d.paths)
    splittable = charset != "UTF-16" and len(d.sep) == 1
    if multi_line is None:
        multi_line = not splittable or quoted.has_quoted_breaks(spark, paths, d.sep)
    if multi_line and splittable:
        return _quoted_scan(spark, d, charset, seq, over)
    # One column more than the header: it holds something where cells are left over.
    beyond = text.free_prefix(d.names) + "beyond"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*d.names, beyond]])
    rows = spark.read.options(
        sep=d.sep, encoding=charset, multiLine=multi_line, quote='"', escape='"', emptyValue="", nullValue="\u0000",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxColumns=100_000, maxCharsPerColumn=-1,
        header=True, enforceSchema=True).schema(schema).csv(paths)

    more = [text.quoted(beyond).isNotNull().alias(over)] if over else []
    return rows.select(arrival().alias(seq), *[_meant(F.coalesce(text.quoted(n), F.lit("")), d).alias(n) for n in d.names], *more)


def _meant(c: Column, d: Dialect) -> Column:
    """Windows-1252 is read as Latin-1, then the bytes 0x80-0x9F get their meaning."""
    if d.encoding != "cp1252":
        return c
    return F.translate(c, "".join(map(chr, detect.HIGH_1252)), "".join(detect.HIGH_1252.values()))


def _quoted_scan(spark: SparkSession, d: Dialect, charset: str, seq: str, over: str | None) -> DataFrame:
    value = F.col("value")
    value = F.make_valid_utf8(value) if charset == "UTF-8" else F.decode(value.cast("binary"), charset)
    rows = quoted.parsed(spark, list(d.paths), d.sep, len(d.names), _meant(value, d))
    more = [F.col("over").alias(over)] if over else []
    return rows.select(F.struct("file", "block", "row").alias(seq), *[F.col(f"c{i}").alias(n) for i, n in enumerate(d.names)], *more)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   multi_line: bool | None = None, seq: str = "seq", over: str | None = None) -> DataFrame:
    """Every column as text, after the arrival order, which is the first column:
    ``seq``, or the next free name if a file has a column so named.

    Files are split among tasks, also where quoted cells hold line breaks (see
    ``quoted``; such files are stored once); only files in UTF-16 that have such cells are
    read by one task each.  What is not given is detected for each file.  Files that are read alike share a
    scan, and scans are put together by the names of their columns; a column that
    a file lacks is NULL there.  A missing cell reads as ''.  Cells beyond the
    header are dropped; ``over`` names a column that says in which rows (see
    ``dropped_cells``).  A file of over 100,000 columns is an error.
    """
    found = dialects(spark, path, sep, encoding)
    if not found:
        raise ValueError(f"No data in {path}")
    taken = {n.lower() for d in found for n in d.names}
    while seq.lower() in taken:
        seq += "_"
    out = None
    for d in found:
        one = _scan(spark, d, multi_line, seq, over)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def dropped_cells(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, n: rows with cells beyond the header, of files that have any."""
    rows = read_delimited(spark, path, over="_over", **options)
    return rows.filter("_over").groupBy(text.quoted(rows.columns[0])["file"].alias("file")).agg(F.count("*").alias("n"))


WHOLE_ROWS = 10_000  # most rows of a file that has to be read by one task


def write_delimited(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """One file a task; files in UTF-16, which can't be split when they are read, of at most ``WHOLE_ROWS`` rows."""
    whole = {"maxRecordsPerFile": WHOLE_ROWS} if CHARSETS.get(encoding.lower(), encoding).upper().startswith("UTF-16") else {}
    df.write.mode("overwrite").options(
        **whole, header=True, sep=sep, encoding=encoding, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def cleaned_name(filename: str, stamp: str) -> str:
    """Name of a cleaned copy: <stem>_cleaned_<stamp>."""
    return f"{filename.rsplit('/', 1)[-1].rsplit('.', 1)[0]}_cleaned_{stamp}"
