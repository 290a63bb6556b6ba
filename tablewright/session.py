"""Session settings and shared scratch space."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "tablewright", memory: str = "8g") -> SparkSession:
    """Session for tests and benches.  On a cluster use the session given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # HotSpot compiles no method over 8000 bytes: wide tables run faster
        # as split projections than as one fused stage that is interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the session names in
    ``spark.checkpoint.dir``.  Only a session whose executors are this machine's
    threads (tests) may name none: it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tablewright-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path for an intermediate table in the shared folder."""
    return "/".join([shared_folder(spark).rstrip("/"), f"tablewright-{name}-{uuid.uuid4().hex}"])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Compute once into a columnar table in the shared folder and read it from
    there: later passes prune columns, skip row groups, and survive the loss of
    any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
