"""Raw zone: load source files, one table each, idempotently."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..catalog.tables import SOURCE_FILES
from ..plans.zones import stamp
from .delimited import read_delimited


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a stored table; running it twice leaves the same table.  The new one
    is written beside the old, which goes only when the new one is whole."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(at(old), True)
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    files.rename(at(new), at(path))
    files.delete(at(old), True)


def ingest(spark: SparkSession, folder: str, zone: str, run_time: str,
           sources: dict[str, str] = SOURCE_FILES) -> dict[str, int]:
    """Load each source into ``zone``/raw_<table> and return rows per table.

    A missing source is skipped with a warning and one without rows counts 0;
    both leave their table as it was.  Rows are counted while they are written.
    """
    counts: dict[str, int] = {}
    for filename, name in sources.items():
        path = f"{folder}/{filename}"
        if not path_exists(spark, path):
            warnings.warn(f"{filename} not found, skipped", stacklevel=2)
            continue
        try:
            rows = read_delimited(spark, path, sep=",")
        except ValueError:
            counts[f"raw_{name}"] = 0
            continue
        if rows.isEmpty():
            counts[f"raw_{name}"] = 0
            continue
        cols = rows.columns[1:]
        seen = Observation(name)
        stamped = stamp(rows, cols, F.lit(filename), run_time).observe(seen, F.count(F.lit(1)).alias("rows"))
        overwrite(stamped, f"{zone}/raw_{name}")
        counts[f"raw_{name}"] = seen.get["rows"]
    return counts
