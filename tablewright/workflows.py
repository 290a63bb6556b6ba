"""Whole runs: clean a file, curate a file of any shape, run the warehouse.

Each is a few lines over the plans; all data stays in stored tables, and what is
returned is a summary.
"""

from __future__ import annotations

import datetime
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import governance
from .catalog.tables import SOURCE_FILES, ZONE_TABLES
from .functions.naming import safe_table_name
from .operators import sheets
from .plans import anyfile, quality, zones
from .plans.clean import Cleaned, clean, stored_types, typed, without_idle
from .plans.profile import Report, analyze, preview
from .session import stage
from .sources.delimited import dialects, read_delimited
from .sources.ingest import ingest, overwrite, path_exists
from .sources.runs import SCHEMA, Steps, append_runs

STAMPS = ["_cleansed_at", "_is_duplicate", "_quality_flag"]

# What a report calls the delimiters.
DELIMITER_NAMES = {",": "comma", "\t": "tab", ";": "semicolon", "|": "pipe"}


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)


def _record(spark: SparkSession, path: str | None, summary: dict) -> None:
    if path:
        fields = [f.split()[0] for f in SCHEMA.split(", ")]
        append_runs(spark.createDataFrame([tuple(summary.get(f) for f in fields)], SCHEMA), path)


def analyze_file(spark: SparkSession, path: str, **options) -> tuple[DataFrame, list[str], Report]:
    """(rows, columns, report) of a delimited file or folder; its text is parsed once."""
    rows = stage(read_delimited(spark, path, **options), "rows")
    seq, *cols = rows.columns
    return rows, cols, analyze(rows, cols, seq)


def file_report(spark: SparkSession, path: str, rows_shown: int = 5, **options) -> dict:
    """All that is found out about a delimited file or folder: how it is written, its profile
    and its first rows.  ``dialects`` has an entry for every way in which the files of a folder
    are written; ``delimiter`` and ``encoding`` are those of its first file."""
    kinds = [{"delimiter": DELIMITER_NAMES.get(d.sep, d.sep), "encoding": d.encoding, "columns": d.names, "files": len(d.paths)}
             for d in dialects(spark, path, options.get("sep"), options.get("encoding"))]
    rows, cols, report = analyze_file(spark, path, **options)
    shown = preview(rows, rows.columns[0], rows_shown).select(*[F.col(f"`{c.replace('`', '``')}`") for c in cols]).collect()
    return {
        "filename": path.rstrip("/").rsplit("/", 1)[-1], "file_kind": "csv", "total_rows": report.total_rows, "total_cols": len(cols),
        "delimiter": kinds[0]["delimiter"], "encoding": kinds[0]["encoding"], "dialects": kinds,
        "columns": [asdict(c) | {"sensitivity": c.sensitivity, "is_pii": c.is_pii, "issues": c.issues, "suggestions": c.suggestions}
                    for c in report.columns],
        "fully_duplicate_rows": report.full_duplicates, "near_duplicate_rows": report.near_duplicates,
        "recommended_rules": report.global_rules, "primary_key": report.primary_key, "stats": report.stats,
        "preview_rows": [dict(zip(cols, r)) for r in shown]}


def store_typed(result: Cleaned, path: str) -> dict[str, str]:
    """Replace the table at ``path`` by the cleaned rows, each column in the type that its cells
    fit.  Returns the types."""
    rows = stage(result.data, "cleaned")
    kinds = stored_types(rows, result.cols, result.seq)
    names = [*result.by, *result.cols, "_quality_flag"]
    overwrite(typed(rows, kinds).select(*[F.col(f"`{n.replace('`', '``')}`") for n in names]), path)
    return kinds


def clean_file(spark: SparkSession, path: str, out: str, rules: dict | None = None, runs: str | None = None,
               as_of: datetime.date | str | None = None, zone: str | None = None, **options) -> dict:
    """Profile a file, clean it by ``rules`` or the default ones, and write it
    to ``out`` as delimited text; with ``zone`` also to its table curated_<name>, in
    the types that the cleaned cells fit."""
    start, run_id = time.time(), f"RUN_{_now():%Y%m%d_%H%M%S}"
    rows, cols, report = analyze_file(spark, path, **options)
    result = clean(rows, cols, rows.columns[0], rules or report.default_rules(), report.primary_key, as_of)
    written = result.write(out, "csv", header=True, emptyValue="", quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                           ignoreTrailingWhiteSpace=False)
    if zone:
        table = f"curated_{safe_table_name(path)}"
        written |= {"curated_table": table, "col_types": store_typed(result, f"{zone}/{table}")}
    nulls = sum(c.null_count for c in report.columns)
    summary = {
        "run_id": run_id, "status": "SUCCESS", "filename": path.rsplit("/", 1)[-1], "original_rows": report.total_rows,
        "rows_dropped": report.total_rows - written["cleaned_rows"], "original_nulls": nulls,
        "nulls_resolved": nulls - written["cleaned_nulls"], "elapsed_sec": round(time.time() - start, 2), **written}
    _record(spark, runs, summary)
    return summary


@dataclass(frozen=True)
class SheetRun:
    """The cleaning of all sheets that have one header."""

    table: sheets.SheetTable
    report: Report
    result: Cleaned


def clean_sheets(cells: DataFrame, merges: DataFrame, rules: dict | None = None,
                 as_of: datetime.date | str | None = None) -> tuple[list[SheetRun], DataFrame]:
    """(runs, facts of the sheets): profile and clean every worksheet of a source.

    All sheets of one header are one run: types and issues are told from all their rows, and
    ``rules``, or the default ones of that profile, hold for all of them.  Duplicates are
    sought and fills and bounds computed sheet by sheet.  The number of jobs grows with the
    headers, not with the sheets."""
    rows, facts = sheets.read_sheets(cells, merges)
    runs = []
    for table in sheets.header_tables(stage(rows, "sheet-rows")):
        report = analyze(table.data, table.names, table.row, samples=0)
        chosen = rules or without_idle(report.default_rules(), report)
        runs.append(SheetRun(table, report, clean(table.data, table.names, table.row, chosen, report.primary_key, as_of, [table.sheet])))
    return runs, facts


def curate_file(spark: SparkSession, path: str, zone: str) -> dict:
    """Curate a file of any shape into ``zone``: raw and curated tables, scores,
    and its entries in the governance catalog.  A file named like a table that has a business
    rule or expected types is scored by them."""
    started = _now()
    run_time, name = str(started), safe_table_name(path)
    rows = read_delimited(spark, path, sep=",")
    seq, *cols = rows.columns
    overwrite(zones.stamp(rows, cols, F.lit(path.rsplit("/", 1)[-1]), run_time, empty_as_none=True), f"{zone}/raw_{name}")
    raw = spark.read.parquet(f"{zone}/raw_{name}")
    shape = anyfile.detect(raw, cols, seq)
    overwrite(anyfile.cleanse(raw, shape, seq, run_time), f"{zone}/curated_{name}")
    curated = spark.read.parquet(f"{zone}/curated_{name}")
    entries = governance.classified(anyfile.catalog_entries(shape, f"raw_{name}", spark), run_time)
    update_catalog(entries, f"{zone}/governance_catalog")
    expected = quality.EXPECTED_TYPES.get(name, {})
    scores = quality.scores(_with_columns(curated, name) if expected else curated, cols + STAMPS, quality.business_rule(name), expected,
                            started=F.lit(run_time).cast("timestamp_ntz"), now=F.lit(str(_now())).cast("timestamp_ntz"))
    report = anyfile.cleanse_report(raw, shape, seq).first().asDict()
    top = anyfile.value_distribution(curated, shape, seq).collect()
    return {
        "raw_table": f"raw_{name}", "curated_table": f"curated_{name}", "primary_key": shape.key,
        "date_columns": shape.date_cols, "col_types": shape.storage, **report, "quality_scores": scores.first().asDict(),
        "col_completeness": {r["column_name"]: r["completeness"] for r in anyfile.completeness(curated, cols).collect()},
        "value_dist": {r["value"]: r["n"] for r in top},
        "governance": [r.asDict() for r in entries.drop("last_classified_at").collect()]}


def update_catalog(entries: DataFrame, path: str) -> None:
    """Replace the named tables' entries in the stored catalog."""
    spark = entries.sparkSession
    if path_exists(spark, path):
        # The new catalog reads the old one, so it is stored before it replaces it.
        entries = stage(governance.replace_tables(spark.read.parquet(path), entries), "catalog")
    overwrite(entries, path)


def _with_columns(df: DataFrame, name: str) -> DataFrame:
    """A raw table with all columns of its schema; what the source lacks is NULL."""
    here = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast("string") for c in ZONE_TABLES[name].names if c.lower() not in here})


def run_warehouse(spark: SparkSession, folder: str, zone: str, runs: str | None = None,
                  as_of: datetime.date | str | None = None, sources: dict[str, str] = SOURCE_FILES) -> dict:
    """Ingest, cleanse, derive, publish, classify, score; tables go to ``zone``,
    curated ones in their stored types.  The run's steps are recorded beside ``runs``."""
    started, clock = _now(), time.time()
    run_time, as_of = str(started), str(as_of or datetime.date.today())
    steps = Steps(f"RUN_{started:%Y%m%d_%H%M%S}")
    try:
        return _warehouse(spark, folder, zone, runs, as_of, sources, run_time, steps, clock)
    finally:
        if runs and steps.rows:
            steps.table(spark).write.mode("append").json(f"{runs.rstrip('/')}_steps")


def _warehouse(spark, folder, zone, runs, as_of, sources, run_time, steps, clock) -> dict:
    with steps.step("ingest") as seen:
        counts = ingest(spark, folder, zone, run_time, sources)
        seen["rows_out"] = sum(counts.values())
    names = [n for n in ZONE_TABLES if path_exists(spark, f"{zone}/raw_{n}")]
    raw = {n: _with_columns(spark.read.parquet(f"{zone}/raw_{n}"), n) for n in names}
    for n in names:
        with steps.step(f"cleanse {n}"):
            rows = zones.with_derived(zones.cleanse(raw[n], n, raw[n].columns[0], run_time), n, as_of)
            overwrite(zones.typed(rows, n), f"{zone}/curated_{n}")
    curated = {n: zones.as_text(spark.read.parquet(f"{zone}/curated_{n}"), n) for n in names}
    published = zones.publish(curated)
    for n, df in published.items():
        with steps.step(f"publish {n}"):
            overwrite(df, f"{zone}/{n}")
    overwrite(governance.classified(governance.registry(spark), run_time), f"{zone}/governance_catalog")
    scores = None
    for n in names:
        one = quality.table_scores(curated[n], n, F.lit(run_time).cast("timestamp_ntz"),
                                   F.lit(str(_now())).cast("timestamp_ntz"))
        scores = one if scores is None else scores.unionAll(one)
    overwrite(quality.with_aggregate(scores), f"{zone}/quality_scores")
    total = zones.run_summary(raw, curated, governance.pii_columns()).first().asDict()
    loaded = zones.row_counts({n: spark.read.parquet(f"{zone}/{n}") for n in published}).collect()
    elapsed = round(time.time() - clock, 2)
    summary = {
        "run_id": steps.run_id, "status": "SUCCESS", "ingested": counts, **total,
        "loaded": {r["table_name"]: r["rows"] for r in loaded}, "elapsed_sec": elapsed,
        "ingestion_rate": round(total["total_raw_rows"] / max(elapsed, 1)),
        "quality_scores": {r["table_name"]: r.asDict() for r in spark.read.parquet(f"{zone}/quality_scores").collect()}}
    _record(spark, runs, summary | {"original_rows": total["total_raw_rows"], "cleaned_rows": total["total_curated_rows"],
                                    "poor_rows": total["poor_quality_rows"]})
    return summary
