"""Encoding and delimiter of delimited files, from the head of each file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_BYTES = 65_536
SAMPLE_CHARS = 8_192

# Delimiters that are looked for, and the one used if none fits.
DELIMITERS = [",", ";", "\t", "|"]

# Bytes that mean nothing in Windows-1252.
UNDEFINED_1252 = "[\u0081\u008d\u008f\u0090\u009d]"

# What the bytes 0x80 to 0x9F stand for in Windows-1252; the
# other bytes are as in ISO-8859-1.
HIGH_1252 = {b: bytes([b]).decode("cp1252", errors="replace") for b in range(0x80, 0xA0)}


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def file_heads(files: DataFrame, size: int = SAMPLE_BYTES) -> DataFrame:
    """Add ``head``: the first bytes of each file.  Tasks read that much of
    each of their files and no more."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import quote

        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch["path"]:
                if uri.startswith("file:/") and not uri.startswith("file://"):
                    uri = "file://" + uri[len("file:"):]
                if uri.startswith(("s3a://", "s3n://")):
                    uri = "s3" + uri[3:]
                system, where = fs.FileSystem.from_uri(quote(uri, safe="/:@"))
                with system.open_input_stream(where, compression=None) as stream:
                    out.append(stream.read(size))
            yield batch.assign(head=out)

    return files.mapInPandas(heads, "path string, length bigint, head binary")


def encoding(head: Column, length: Column, size: int = SAMPLE_BYTES) -> Column:
    """Byte-order mark first, then UTF-8, then Windows-1252, then Latin-1.

    A sample may end inside a character, so up to three bytes are given up
    when the file goes on.  Plain UTF-8 and ASCII are named utf-8-sig, which
    reads them with or without a mark.
    """
    valid = lambda b: F.is_valid_utf8(b.cast("string"))
    n = F.length(head)
    utf8 = valid(head)
    for cut in (1, 2, 3):
        utf8 = utf8 | ((length > size) & valid(F.substr(head, F.lit(1), F.greatest(n - cut, F.lit(0)))))
    mark = F.hex(F.substring(head, 1, 3))
    return (
        F.when(mark == "EFBBBF", "utf-8-sig")
        .when(F.left(mark, F.lit(4)).isin("FFFE", "FEFF"), "utf-16")
        .when(utf8, "utf-8-sig")
        .when(~F.decode(head, "ISO-8859-1").rlike(UNDEFINED_1252), "cp1252")
        .otherwise("iso-8859-1")
    )


def head_text(head: Column, enc: Column) -> Column:
    return (
        F.when(enc == "utf-16", F.decode(head, "UTF-16"))
        .when(enc == "utf-8-sig", F.make_valid_utf8(head.cast("string")))
        .otherwise(F.decode(head, "ISO-8859-1"))
    )


def _occurrences(lines: Column, d: str) -> Column:
    return F.transform(lines, lambda x: (F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))).cast("double"))


def delimiter(sample: Column) -> Column:
    """The delimiter that occurs on every line alike: least spread of its count
    per line, then most occurrences.  Quoted text is ignored."""
    unquoted = F.regexp_replace(F.left(sample, F.lit(SAMPLE_CHARS)), r'"[^"]*("|$)', "")
    lines = F.split(unquoted, r"\r\n|\r|\n")
    # The last line of a cut sample is not whole.
    whole = F.when((F.length(sample) > SAMPLE_CHARS) & (F.size(lines) > 1), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    whole = F.filter(whole, lambda x: F.trim(x) != "")
    n = F.size(whole).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    scored = []
    for place, d in enumerate(DELIMITERS):
        counts = _occurrences(whole, d)
        mean = total(counts) / n
        spread = total(F.transform(counts, lambda x: x * x)) / n - mean * mean
        scored.append(F.when((F.size(whole) > 0) & (total(counts) > 0), F.struct(
            F.round(spread, 9).alias("spread"), (-mean).alias("mean"), F.lit(place).alias("place"), F.lit(d).alias("delimiter"))))
    return F.coalesce(F.array_min(F.array_compact(F.array(*scored)))["delimiter"], F.lit(DELIMITERS[0]))


def detect(spark: SparkSession, path: str) -> DataFrame:
    """path, length, encoding, delimiter of every file under ``path``."""
    heads = file_heads(list_files(spark, path)).withColumn("encoding", encoding(F.col("head"), F.col("length")))
    return heads.select("path", "length", "encoding",
                        delimiter(head_text(F.col("head"), F.col("encoding"))).alias("delimiter"))
