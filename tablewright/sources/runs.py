"""Run history: an append-only table of JSON records."""

from __future__ import annotations

import contextlib
import datetime
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("run_id string, filename string, status string, original_rows bigint, cleaned_rows bigint, "
          "rows_dropped bigint, poor_rows bigint, elapsed_sec double")

# Record of one step of a run.
STEP_SCHEMA = ("run_id string, step string, status string, rows_in bigint, rows_out bigint, elapsed_sec double, "
               "started_at timestamp, message string")


class Steps:
    """Records of a run's steps: name, rows, status, time."""

    def __init__(self, run_id: str):
        self.run_id, self.rows = run_id, []

    @contextlib.contextmanager
    def step(self, name: str):
        """Records the enclosed work; set ``rows_in`` and ``rows_out`` in the dict."""
        clock, seen = time.time(), {}
        started = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        status, message = "SUCCESS", None
        try:
            yield seen
        except Exception as e:
            status, message = "FAILED", str(e)[:500]
            raise
        finally:
            self.rows.append((self.run_id, name, status, seen.get("rows_in"), seen.get("rows_out"),
                              round(time.time() - clock, 2), started, message))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, STEP_SCHEMA)


def append_runs(records: DataFrame, path: str) -> None:
    """Add run records; previews are not kept."""
    records.drop("preview", "preview_headers").write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All readable records; broken lines are left out."""
    broken = "_broken"
    rows = spark.read.schema(f"{SCHEMA}, {broken} string").option("columnNameOfCorruptRecord", broken).json(path)
    return rows.filter(F.col(broken).isNull()).drop(broken)


def latest_runs(spark: SparkSession, path: str, k: int = 20) -> DataFrame:
    """The k latest runs; a top-k keeps k rows per task."""
    return read_runs(spark, path).orderBy(F.desc("run_id")).limit(k).select(
        "run_id",
        F.coalesce("filename", F.lit("—")).alias("filename"),
        F.coalesce("cleaned_rows", "original_rows", F.lit(0)).alias("rows"),
        F.coalesce("rows_dropped", F.lit(0)).alias("dropped"),
        F.coalesce("elapsed_sec", F.lit(0.0)).alias("elapsed"),
        F.coalesce("status", F.lit("SUCCESS")).alias("status"),
    )


def get_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return read_runs(spark, path).filter(F.col("run_id") == run_id)
