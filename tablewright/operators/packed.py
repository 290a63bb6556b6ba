"""Counts of many columns from one pass, without a row for every distinct value.

A task turns the cells of a column into hashes, drops repeats, and packs what is left into
arrays: a row for each bucket of hashes and task travels in place of a row for each value.
Where a bucket meets, it is counted exactly.  Values and rows are told apart by 128 bits of
hash, and so are their spellings in lower case.

Buckets hold about ``BUCKET`` rows of the table, so no task gets more than that of one column
however large the table; a value that fills a third of it is one entry a task.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..session import stage

BUCKET = 1 << 18   # rows of the table for each bucket
HELD = 1 << 19     # entries that a task holds before it passes them on, of all columns
FEWEST = 1 << 13   # entries of a column that it may hold in any case
SLICE_BYTES = 1 << 20  # of text that a task takes apart at a time
SLICE_ROWS = 1 << 11

COUNTS, KEYS, NUMBERS, LEAST = 0, 1, 2, 3
PACKED = ("kind int, col int, bucket int, data binary, total bigint, blank bigint, padded bigint, invalid bigint, "
          "numbers array<struct<x double, n bigint>>")
ROWS = -1          # stands for a column: whole rows

EMAIL = re.compile(text.EMAIL_PATTERN)
NUMBER = re.compile(numbers.NUMBER_PATTERN.strip("^$"), re.ASCII)
_MISSING = {"", *text.BLANK_TOKENS}
_KEYS = ("tablewright-one--", "tablewright-two--")  # of the two hashes
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashes(values: list[str]) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each text."""
    held = np.array(values, object) if values else np.zeros(0, object)
    return [pd.util.hash_array(held, hash_key=k[:16], categorize=False) for k in _KEYS]


class Cells:
    """The cells of one column in one batch, each distinct one looked at once."""

    def __init__(self, column: pa.Array, cased: bool):
        coded = column.dictionary_encode()
        self.codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        trimmed = pc.utf8_trim(coded.dictionary, characters=text.WHITESPACE)
        self.stripped = [*trimmed.to_pylist(), ""]  # the last stands for NULL
        self.n = np.bincount(self.codes, minlength=len(self.stripped))
        self.padded = np.append(pc.not_equal(coded.dictionary, trimmed).to_numpy(zero_copy_only=False), False)
        folded = [s.lower() for s in self.stripped]
        self.blank = np.array([s in _MISSING for s in folded])
        self.keys = hashes(self.stripped)
        self.folds = hashes(folded) if cased else []


def number(s: str) -> float:
    """What ``numbers.number`` makes of a cell; NaN if it is no number."""
    s = s.replace(",", "").strip(text.WHITESPACE)
    if NUMBER.fullmatch(s):
        try:
            return float(s)
        except ValueError:  # a dot alone
            pass
    return float("nan")


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of each row from the hashes of its cells."""
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ (out >> np.uint64(29))) * _ODD + p
    return out


def row_hashes(cols: list[str]) -> Column:
    """r0 to r3, the hashes of a row as ``pack`` makes them: two of the row as it is, two
    in lower case."""
    names = ["r0", "r1", "r2", "r3"]

    @F.arrow_udf(", ".join(f"{n} bigint" for n in names))
    def hash_rows(*columns: pa.Array) -> pa.Array:
        each = [[k[x.codes] for k in x.keys + x.folds] for x in (Cells(c, True) for c in columns)]
        return pa.StructArray.from_arrays([pa.array(combined(list(k)).view(np.int64)) for k in zip(*each)], names=names)

    return hash_rows(*[text.quoted(c) for c in cols])


def merged(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries in order of their keys, equal ones as one."""
    if not len(n):
        return keys, n
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(n, at)


def portions(batch: pa.RecordBatch):
    """The batch in portions of at most ``SLICE_ROWS`` rows and ``SLICE_BYTES`` of text, a longer row
    alone: Python objects of few cells stand at a time, however long the cells are."""
    sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns),
                np.zeros(batch.num_rows, np.int64))
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        stop = min(max(at + 1, fits), at + SLICE_ROWS)
        yield batch.slice(at, stop - at)
        at = stop


class Entries:
    """Distinct entries of one column, within bounds."""

    def __init__(self, width: int):
        self.parts: list[list[np.ndarray]] = []
        self.size, self.width = 0, width

    def add(self, keys: list[np.ndarray], n: np.ndarray | None = None) -> None:
        self.parts.append([*keys, np.ones(len(keys[0]), np.int64) if n is None else n])
        self.size += len(keys[0])

    def merge(self) -> tuple[list[np.ndarray], np.ndarray]:
        empty = [np.zeros(0, np.int64)] * (self.width + 1)
        *keys, n = [np.concatenate(c) for c in zip(empty, *self.parts)]
        keys, n = merged(keys, n)
        self.parts, self.size = [[*keys, n]], len(n)
        return keys, n


def pack(df: DataFrame, cols: list[str], total: int, cased=(), emails=(), numeric=(), rows: bool = False, most: int | None = None,
         least: int = 0) -> DataFrame:
    """PACKED, stored: one pass over the table.  ``total``: rows of the table, by which
    buckets are chosen.  ``most``: a task may stop at that many distinct values of a column, for
    those who only ask whether there are more.  ``least``: how many of the smallest values of
    each column are wanted."""
    cased, emails, numeric = set(cased), set(emails), set(numeric)
    buckets = max(1, -(-total // BUCKET))
    every = [text.quoted(c).alias(f"v{i}") for i, c in enumerate(cols)]
    schema = pa.schema([("kind", pa.int32()), ("col", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()),
                        *[(n, pa.int64()) for n in ("total", "blank", "padded", "invalid")],
                        ("numbers", pa.list_(pa.struct([("x", pa.float64()), ("n", pa.int64())])))])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def keys_out(col: int, held: Entries) -> pa.RecordBatch:
        keys, n = held.merge()
        held.parts, held.size = [], 0
        spread = keys[-2].view(np.uint64) % np.uint64(buckets)
        order = np.argsort(spread, kind="stable")
        edges = np.searchsorted(spread[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
        return out([(KEYS, col, b, np.stack([*(k[order[lo:hi]] for k in keys), n[order[lo:hi]]]).tobytes(), *[None] * 5)
                    for b, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo])

    def numbers_out(col: int, held: Entries) -> pa.RecordBatch:
        (x,), n = held.merge()
        held.parts, held.size = [], 0
        pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.float64)), pa.array(n)], names=["x", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(n), SLICE_ROWS), len(n)), pa.int32()), pairs)
        k = len(lists)
        columns = [pa.array([v] * k, pa.int32()) for v in (NUMBERS, col, 0)] + [pa.nulls(k, f.type) for f in list(schema)[3:-1]]
        return pa.RecordBatch.from_arrays([*columns, lists], schema=schema)

    def run(batches):
        held = {i: Entries(4 if c in cased else 2) for i, c in enumerate(cols)}
        held |= {ROWS: Entries(4)} if rows else {}
        values: dict[int, Entries] = {i: Entries(1) for i, c in enumerate(cols) if c in numeric}
        sums, closed, smallest = np.zeros((len(cols), 4), np.int64), set(), [[] for _ in cols]
        most_held = max(HELD // max(1, len(held) + len(values)), min(HELD, FEWEST))
        for batch in (part for whole in batches for part in portions(whole)):
            each = []
            for i, c in enumerate(cols):
                cells = Cells(batch[f"v{i}"], rows or c in cased)
                bad = [not (b or EMAIL.match(s)) for s, b in zip(cells.stripped, cells.blank)] if c in emails else False
                sums[i] += (batch.num_rows, cells.n[cells.blank].sum(), cells.n[cells.padded].sum(), cells.n[bad].sum() if c in emails else 0)
                there = ~cells.blank & (cells.n > 0)
                if i not in closed:
                    held[i].add([k[there].view(np.int64) for k in (cells.keys + cells.folds if c in cased else cells.keys)], cells.n[there])
                if i in values:
                    x = np.array([number(s) if ok else np.nan for s, ok in zip(cells.stripped, there.tolist())])
                    values[i].add([x[~np.isnan(x)]], cells.n[~np.isnan(x)])
                if least:
                    found = {cells.stripped[j] for j in np.flatnonzero(there).tolist()}
                    if len(smallest[i]) == least:
                        last = smallest[i][-1]
                        found = {s for s in found if s < last}
                    smallest[i] = sorted(found.union(smallest[i]))[:least] if found else smallest[i]
                if rows:
                    each.append([k[cells.codes] for k in cells.keys + cells.folds])
            if rows:
                held[ROWS].add([combined(list(k)).view(np.int64) for k in zip(*each)])
            for i, entries in held.items():
                if entries.size > most_held or most and i not in closed:
                    if len(entries.merge()[1]) > most_held // 2:
                        yield keys_out(i, entries)
                    elif most and entries.size >= most:
                        closed.add(i)
            for i, entries in values.items():
                if entries.size > most_held and len(entries.merge()[1]) > most_held // 2:
                    yield numbers_out(i, entries)
        for i, entries in held.items():
            yield keys_out(i, entries)
        for i, entries in values.items():
            yield numbers_out(i, entries)
        yield out([(COUNTS, i, 0, None, *s, None) for i, s in enumerate(sums.tolist())])
        yield out([(LEAST, i, 0, s.encode(), *[None] * 5) for i, found in enumerate(smallest) for s in found])

    return stage(df.select(*every).mapInArrow(run, PACKED), "packed")


COUNTED = "col int, distinct bigint, odd bigint, mixed array<bigint>"


def counted(packed: DataFrame, width: dict[int, int]) -> DataFrame:
    """COUNTED, a row for each bucket: its distinct values; ``odd``, the cells not in the
    commonest spelling of their value; ``mixed``, a hash of each value spelled in more ways
    than one.  ``width``: number of keys of each column."""
    def count(table: pa.Table) -> pa.Table:
        col = table["col"][0].as_py()
        parts = [np.frombuffer(d.as_buffer(), np.int64).reshape(width[col] + 1, -1) for d in table["data"]]
        *keys, n = np.concatenate(parts, axis=1)
        half = width[col] // 2
        keys, n = merged([*keys[half:], *keys[:half]] if width[col] == 4 else keys, n)
        odd, mixed = 0, np.zeros(0, np.int64)
        if width[col] == 4:  # in order of the folded value
            new = np.ones(len(n), bool)
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
            at = np.flatnonzero(new)
            odd = int((np.add.reduceat(n, at) - np.maximum.reduceat(n, at)).sum())
            mixed = keys[0][at[np.diff(np.append(at, len(n))) > 1]]
        return pa.table({"col": pa.array([col], pa.int32()), "distinct": [len(n)], "odd": [odd], "mixed": pa.array([mixed], pa.list_(pa.int64()))})

    return packed.filter(F.col("kind") == KEYS).select("col", "bucket", "data").groupBy("col", "bucket").applyInArrow(count, COUNTED)


def sums(packed: DataFrame, buckets: DataFrame) -> dict[int, dict]:
    """Per column: total, blank, padded, invalid, distinct, odd, mixed (a number)."""
    zero = F.lit(0).cast("bigint")
    facts = packed.filter(F.col("kind") == COUNTS).select("col", "total", "blank", "padded", "invalid", *[zero.alias(n) for n in ("distinct", "odd", "mixed")])
    found = buckets.select("col", *[zero.alias(n) for n in ("total", "blank", "padded", "invalid")], "distinct", "odd", F.size("mixed").cast("bigint").alias("mixed"))
    both = facts.unionAll(found)
    return {r["col"]: r.asDict() for r in both.groupBy("col").agg(*[F.sum(n).alias(n) for n in both.columns[1:]]).collect()}


def number_values(packed: DataFrame, cols: list[str]) -> DataFrame:
    """values(name, x, n) of the numbers, repeats of a task as one row."""
    names = F.array(*[F.lit(c) for c in cols])
    return packed.filter(F.col("kind") == NUMBERS).select(names[F.col("col")].alias("name"), F.inline("numbers"))


def first_of(df: DataFrame, cols: list[str], order: str, k: int, keep) -> DataFrame:
    """column_name, value, seq: of every column the first k cells in the order that satisfy
    ``keep``, as far as each task can tell: one pass over all columns, k rows of each a task."""
    names = [f"v{i}" for i in range(len(cols))]
    kept = df.select(text.quoted(order).alias("seq"), *[F.when(keep(text.quoted(c)), text.quoted(c)).alias(n) for n, c in zip(names, cols)])
    kept = kept.filter(F.coalesce(*names).isNotNull())
    kind = kept.schema["seq"].dataType.simpleString()
    rank = lambda seq: tuple(seq.values()) if isinstance(seq, dict) else (seq,)

    def run(batches):
        best: list[list[tuple]] = [[] for _ in cols]
        schema = None
        for batch in batches:
            schema = batch.schema.field("seq").type
            for i, n in enumerate(names):
                column = batch[n]
                if column.null_count == len(column):
                    continue
                at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                seqs = batch["seq"].take(pa.array(at)).to_pylist()
                if len(best[i]) == k:  # what comes after the last of k is not looked at
                    pairs = [(j, s) for j, s in zip(at.tolist(), seqs) if rank(s) < rank(best[i][-1][0])]
                else:
                    pairs = list(zip(at.tolist(), seqs))
                pairs = sorted(pairs, key=lambda p: rank(p[1]))[:k]
                best[i] = sorted(best[i] + [(s, column[j].as_py()) for j, s in pairs], key=lambda p: rank(p[0]))[:k]
        if schema is not None:
            rows = [(cols[i], v, s) for i, found in enumerate(best) for s, v in found]
            c, v, s = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(v, pa.string()), pa.array(s, schema)], names=["column_name", "value", "seq"])

    return kept.mapInArrow(run, f"column_name string, value string, seq {kind}")


def few_values(df: DataFrame, cols: list[str], most: int, keep) -> dict[str, int]:
    """Distinct cells of each column that satisfy ``keep``, as far as ``most`` + 1: one pass, of
    which a task passes on that many hashes of a column, whatever the column holds."""
    every = [F.when(keep(text.quoted(c)), text.quoted(c)).alias(f"v{i}") for i, c in enumerate(cols)]

    def run(batches):
        seen: list[set] = [set() for _ in cols]
        for batch in batches:
            for i, found in enumerate(seen):
                if len(found) <= most:
                    values = pc.unique(batch[f"v{i}"].drop_null()).to_pylist()
                    found.update(zip(*(k.view(np.int64).tolist() for k in hashes(values))))
        rows = [(i, a, b) for i, found in enumerate(seen) for a, b in sorted(found)[:most + 1]]
        i, a, b = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["col", "a", "b"])

    counts = df.select(*every).mapInArrow(run, "col int, a bigint, b bigint").distinct().groupBy("col").agg(
        F.least(F.count("*"), F.lit(most + 1)).alias("n"))
    return {cols[r["col"]]: r["n"] for r in counts.collect()}


def least_values(packed: DataFrame, k: int) -> dict[int, list[str]]:
    """Of each column the k smallest distinct stripped cells that are not blank."""
    order = Window.partitionBy("col").orderBy("value")
    found = packed.filter(F.col("kind") == LEAST).select("col", F.col("data").cast("string").alias("value")).distinct()
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).orderBy("col", "rank")
    out: dict[int, list[str]] = {}
    for r in found.collect():
        out.setdefault(r["col"], []).append(r["value"])
    return out
