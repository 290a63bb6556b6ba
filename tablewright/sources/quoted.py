"""Delimited files whose quoted cells hold line breaks, read by many tasks.

Where a split of a file begins, only what stands before it tells whether that place
lies inside a quoted cell.  So each split is parsed under both states at once, and the right
parse is kept when the states of all splits are known:

1. Every task goes over the lines of its splits once and stores the records it finds.  Under
   the state "outside" the first line begins a record; under "inside" the lines up to a closing
   quote belong to a record that an earlier split began.  From the first line on that begins
   a record under both, there is one parse.  The stored rows say under which state they
   hold, a last row for each split says in which state it ends for either state at its start.
2. These last rows, one a split, are composed file by file: the state at the start of a file
   is known, so that of every split is, and so is the split that began a record which
   reaches into it.
3. Records that hold under both states need nothing more.  The few before the two parses met
   are kept if their state is the right one.  Pieces of records that cross splits are
   brought together by the split that began them.

The scan is stored, so all of it rests on one and the same division into splits, and later
passes read columns.  A quoted cell may reach over any number of splits.  Cells are
cut as by the csv module: a quote inside an unquoted cell is a plain character, and a cell that is
never closed ends with its file, less a last line feed.  Records end at a line feed, a carriage return or both;
empty lines are no records.  Only encodings in which a line feed is one byte can be split.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

OUTSIDE, INSIDE, BOTH = 0, 1, 2          # under which state at the start of its split a row holds
RECORD, HEAD, TAIL, END = 0, 1, 2, 3     # whole record, end of an earlier one, begun record, facts of the split
ROWS, CHARS = 10_000, 1 << 22            # what a task holds before it passes it on

FACTS = "file string, block bigint, kind int, holds int, row bigint, opening boolean, text string, over boolean"


def opens(sep: str, end: str = r"\Z") -> tuple[str, str]:
    """Patterns of lines that end in an open quoted cell: from the start of a record,
    and from within a quoted cell.  ``end``: how the dialect of patterns writes the end."""
    s = re.escape(sep)
    inside = '(?:[^"]++|"")*+'
    whole = f'(?:"{inside}"[^{s}]*+|(?!")[^{s}]*+){s}'
    begun = f'(?:{whole})*+"{inside}{end}'
    return begun, f'{inside}(?:{end}|"[^{s}]*+{s}{begun})'


def has_quoted_breaks(spark: SparkSession, paths: list[str], sep: str) -> bool:
    """Some quoted cell holds a line break: as long as no line opens one and leaves it
    open, every line begins a record.  Stops at the first such line."""
    line = F.col("value")
    opened = line.contains('"') & line.rlike("^" + opens(sep, r"\z")[0])
    return not spark.read.text(paths).filter(opened).isEmpty()


class Track:
    """One parse of a split: the records found under one state at its start, or both."""

    def __init__(self, holds: int, inside: bool, first: bool):
        self.holds, self.inside, self.first = holds, inside, first
        self.piece: list[str] = []   # of the record that is not complete
        self.row, self.size = -1, 0
        self.kind = HEAD if inside else TAIL
        self.begun = not inside      # a record began in this split

    def facts(self, kind: int, row: int, text: str, opening: bool) -> tuple:
        return kind, self.holds, row, opening, text


class Split:
    """The lines of one split, in order, turned into rows (kind, holds, row, opening, text)."""

    def __init__(self, patterns: tuple[re.Pattern, re.Pattern], at_start: bool):
        self.outside_opens, self.inside_opens = patterns
        self.tracks = [Track(BOTH, False, True)] if at_start else [Track(OUTSIDE, False, False), Track(INSIDE, True, False)]
        self.begun_inside = False    # does any record begin here if the split begins inside a quoted cell?
        self.lines = 0

    def add(self, line: str) -> Iterator[tuple]:
        row = self.lines
        self.lines += 1
        if len(self.tracks) == 2 and not any(t.inside for t in self.tracks) and not any(t.piece for t in self.tracks):
            # both parses begin a record here: from now on they are one
            self.begun_inside = True
            self.tracks = [Track(BOTH, False, False)]
        quoted = '"' in line
        for t in self.tracks:
            if not t.inside and not quoted:
                if t.first:
                    t.first = False
                    yield t.facts(RECORD, row, line, True)
                elif line.strip("\r\n"):
                    yield t.facts(RECORD, row, line, False)
                t.begun = True
                continue
            if not t.piece and not t.inside:
                t.kind, t.row, t.begun = TAIL, row, True
            elif t.row < 0:
                t.row = row
            stays = (self.inside_opens if t.inside else self.outside_opens).match(line) if quoted else t.inside
            t.piece.append(line)
            t.size += len(line)
            t.inside = bool(stays)
            if not t.inside:
                kind = RECORD if t.kind == TAIL else HEAD
                yield t.facts(kind, t.row, "".join(t.piece), t.first and kind == RECORD)
                t.first = t.first and kind != RECORD
                t.piece, t.size, t.row, t.kind = [], 0, -1, TAIL
            elif t.size > CHARS and t.kind == HEAD:
                # a cell that began earlier goes on and on: pass on what there is
                yield t.facts(HEAD, t.row, "".join(t.piece), False)
                t.piece, t.size, t.row = [], 0, -1

    def end(self) -> Iterator[tuple]:
        """What is not complete, and the facts: state at the end for either state at
        the start, and whether a record begins here if the start lies inside."""
        for t in self.tracks:
            if t.piece:
                yield t.facts(t.kind, t.row, "".join(t.piece), t.first)
        ends = [t.inside for t in self.tracks]
        begun = self.begun_inside or (len(self.tracks) == 2 and self.tracks[1].begun)
        yield END, BOTH, -1, False, "".join("01"[x] for x in (ends[0], ends[-1], begun))


def lines_of(value: str) -> Iterator[str]:
    """A line of text, cut at carriage returns that stand alone."""
    value += "\n"
    if "\r" not in value[:-2]:
        yield value
    else:
        yield from re.findall(r"[^\r\n]*(?:\r\n|\r|\n)", value)


class Out:
    """Rows on their way out of a task; whole records are cut into cells."""

    def __init__(self, sep: str, width: int, schema: pa.Schema):
        csv.field_size_limit(1 << 31)
        self.sep, self.width, self.schema = sep, width, schema
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, file: str, block: int, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append((file, block, *row))
        self.size += len(row[-1])
        if len(self.rows) >= ROWS or self.size >= CHARS:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.size = self.rows, [], 0
        facts = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]
        cells, over = cut([t if k == RECORD else "" for k, t in zip(facts[2], facts[6])], self.sep, self.width)
        facts[6] = [None if k == RECORD else t for k, t in zip(facts[2], facts[6])]
        columns = [*facts, over, *cells]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def cut(records: list[str], sep: str, width: int) -> tuple[list[list[str]], list[bool]]:
    """The cells of each record by column, '' where there are too few, and whether
    there are too many."""
    found = list(csv.reader(records, delimiter=sep))
    held = [row if len(row) == width else (row + [""] * width)[:width] for row in found]
    return [list(c) for c in zip(*held)] if held else [[] for _ in range(width)], [len(r) > width for r in found]


def _schema(width: int) -> tuple[str, pa.Schema]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    ddl = ", ".join([FACTS, *[f"c{i} string" for i in range(width)]])
    return ddl, pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _composed(splits: pd.DataFrame) -> pd.DataFrame:
    """State at the start of each split of a file, and the split in which the record
    began that reaches into it."""
    splits = splits.sort_values("block")
    inside, owner, starts, owners = False, 0, [], []
    for block, facts in zip(splits["block"], splits["text"]):
        starts.append(int(inside))
        owners.append(owner)
        if not inside or facts[2] == "1":
            owner = block
        inside = facts[int(inside)] == "1"
    return pd.DataFrame({"file": splits["file"], "block": splits["block"], "start": starts, "owner": owners})


def parsed(spark: SparkSession, paths: list[str], sep: str, width: int, text: Column) -> DataFrame:
    """file, block, row (the number of each record's first line in its split), over (it has too many
    cells), c0 ...: all records of the files but the first of each.  ``text``: what to make of
    the column ``value`` of a line, its bytes as they are."""
    ddl, schema = _schema(width)
    patterns = tuple(re.compile(p) for p in opens(sep))

    def run(batches):
        out, split, at = Out(sep, width, schema), None, None
        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    if split:
                        for found in split.end():
                            yield from out.add(*at, found)
                    at, split = (file, block), Split(patterns, block == 0)
                for line in lines_of(value):
                    for found in split.add(line):
                        yield from out.add(*at, found)
        if split:
            for found in split.end():
                yield from out.add(*at, found)
        yield out.batch()

    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("value"))
    held = stage(lines.mapInArrow(run, ddl), "quoted-records")
    ends = held.filter(F.col("kind") == END).select("file", "block", "text")
    states = stage(ends.groupBy("file").applyInPandas(_composed, "file string, block bigint, start int, owner bigint"), "quoted-states")
    cells = [f"c{i}" for i in range(width)]
    place = ["file", "block", "row", "over", *cells]
    records = held.filter((F.col("kind") == RECORD) & ~F.col("opening"))
    sure = records.filter(F.col("holds") == BOTH).select(place)
    # what holds under one state only: the states are a row a split, these rows few
    early = records.filter(F.col("holds") != BOTH).join(states, ["file", "block"]).filter("holds = start").select(place)

    def join_pieces(batches):
        for batch in batches:
            texts = [re.sub(r"\n\Z", "", t) for t in batch["text"].to_pylist()]
            cells, over = cut(texts, sep, width)
            columns = [*(batch[n] for n in ("file", "block", "row")), pa.array(over, pa.bool_()), *[pa.array(c, pa.string()) for c in cells]]
            yield pa.RecordBatch.from_arrays(columns, names=place)

    pieces = held.filter(F.col("kind").isin(HEAD, TAIL)).join(states, ["file", "block"]).filter((F.col("holds") == BOTH) | (F.col("holds") == F.col("start")))
    begun = F.when(F.col("kind") == HEAD, F.col("owner")).otherwise(F.col("block"))
    order = F.struct("block", "row", "kind", "opening", "text")
    crossing = pieces.groupBy("file", begun.alias("begun")).agg(F.sort_array(F.collect_list(order)).alias("parts"))
    whole = crossing.filter("NOT parts[0].opening").select(
        "file", F.col("begun").alias("block"), F.col("parts")[0]["row"].alias("row"),
        F.array_join(F.transform("parts", lambda p: p.text), "").alias("text"))
    kinds = ", ".join(["file string, block bigint, row bigint, over boolean", *[f"{c} string" for c in cells]])
    return sure.unionAll(early).unionAll(whole.mapInArrow(join_pieces, kinds))
