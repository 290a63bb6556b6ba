"""SimHash near-duplicates by an inverted index on byte positions.

Two fingerprints that differ in at most ``distance`` = 4 of 64 bits agree in at
least 4 of their 8 bytes.  Every four positions hold one of 20 fixed triples, so
posting lists of the bytes at each triple bring every such pair together.  Within
a list the bytes that a pair shares are tallied, pairs that reach the guaranteed
four are verified by their bits, and only links that join two classes found so
far are passed on: a list of n fingerprints yields at most n - 1 rows.  Lists
longer than ``LIST`` are dealt out as pairs of blocks to as many tasks.

Null text is a text without words: fingerprint 0, linked as any other.  Repeated
rows share a fingerprint and so a class.  A class whose ids are all null has a
null id.  Texts of any length are read whole.  An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.session import stage

from .common import free_name, quoted
from .fingerprints import fingerprints

DISTANCE = 4
LIST = 4096
HELD = 1 << 18  # links held before they are joined


def triples() -> list[tuple[int, int, int]]:
    """Turan's triples on 8 places: any 4 places hold one of them.  Places fall
    into groups of 3, 3 and 2; a triple lies in one group or takes two of a group
    and one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in combinations(g, 3)]
    for g, following in zip(groups, groups[1:] + groups[:1]):
        out += [tuple(sorted((*pair, one))) for pair in combinations(g, 2) for one in following]
    return sorted(out)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> tuple[DataFrame, str]:
    @F.arrow_udf("bigint")
    def compute(texts: pa.Array) -> pa.Array:
        return fingerprints(texts)

    out = free_name(docs, out)
    return docs.withColumn(out, compute.asNondeterministic()(quoted(text))), out


def postings(nodes: DataFrame) -> DataFrame:
    """(list, fp) for each of the 20 lists a fingerprint stands in."""
    def key(number, places):
        value = F.lit(number)
        for p in places:
            value = value * 256 + F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(255)
        return value.cast("bigint")

    lists = F.explode(F.array(*[key(i, t) for i, t in enumerate(triples())]))
    return nodes.select(lists.alias("list"), "fp")


def dealt(rows: DataFrame, limit: int = LIST) -> DataFrame:
    """(list, cell, fp): lists up to ``limit`` have one cell; longer ones are cut
    into blocks and have a cell for each pair of blocks."""
    long = stage(rows.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
                 .select("list", F.ceil(F.col("n") / limit).cast("int").alias("blocks")), "simhash-long")
    rows = rows.join(long, "list", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda other: F.least(mine, other) * F.col("blocks") + F.greatest(mine, other))
    return rows.select("list", F.explode(F.coalesce(cells, F.array(F.lit(-1)))).alias("cell"), "fp")


class Links:
    """Links of one batch of lists, thinned to those that join classes."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        self.held.append((a[new], b[new]))
        self.size += int(new.sum())
        if self.size > HELD:
            self.join()

    def join(self) -> None:
        if self.size:
            a, b = (np.concatenate(x) for x in zip(*self.held))
            while True:
                la, lb = self.label[a], self.label[b]
                open_ = la != lb
                if not open_.any():
                    break
                a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
                np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
                while (nxt := self.label[self.label]).tobytes() != self.label.tobytes():
                    self.label = nxt
        self.held, self.size = [], 0


def linked(keys: np.ndarray, cells: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, the first of its class) within lists given in order."""
    links, bits = Links(len(fps)), fps.view(np.uint64)  # signed numbers would count the bits of their absolute value
    as_bytes = fps.view(np.uint8).reshape(-1, 8)
    least = 8 - distance
    at = np.arange(len(fps) - 1) if len(fps) else np.zeros(0, int)
    step = 1
    while True:
        at = at[at + step < len(fps)]
        at = at[(keys[at] == keys[at + step]) & (cells[at] == cells[at + step])]
        if not len(at):
            break
        shared = (as_bytes[at] == as_bytes[at + step]).sum(axis=1)
        close = at[shared >= least]
        close = close[np.bitwise_count(bits[close] ^ bits[close + step]) <= distance]
        links.add(close, close + step)
        step += 1
    links.join()
    member = np.flatnonzero(links.label != np.arange(len(fps)))
    return fps[member], fps[links.label[member]]


def links(nodes: DataFrame, distance: int = DISTANCE, limit: int = LIST) -> DataFrame:
    """Links (a, b) whose transitive closure is that of all pairs within
    ``distance``.  ``nodes``: distinct fingerprints, column fp."""
    rows = dealt(postings(nodes), limit)

    def work(batches):
        rest = None
        for batch in batches:
            keys, cells, fps = (batch[c].to_numpy(zero_copy_only=False) for c in ("list", "cell", "fp"))
            if rest is not None:
                keys, cells, fps = (np.concatenate(x) for x in zip(rest, (keys, cells, fps)))
            if not len(keys):
                continue
            # the last list may go on in the next batch
            whole = int(np.flatnonzero((keys != keys[-1]) | (cells != cells[-1]))[-1]) + 1 if (
                (keys[0], cells[0]) != (keys[-1], cells[-1])) else 0
            rest = (keys[whole:], cells[whole:], fps[whole:])
            if whole:
                yield out(keys[:whole], cells[:whole], fps[:whole])
        if rest is not None and len(rest[0]):
            yield out(*rest)

    def out(keys, cells, fps):
        a, b = linked(keys, cells, np.ascontiguousarray(fps), distance)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (rows.repartition("list", "cell").sortWithinPartitions("list", "cell")
            .mapInArrow(work, "a bigint, b bigint").distinct())


def followed(least: DataFrame) -> DataFrame:
    """(old, new) where ``new`` is the end of the chain of names that begins at ``old``:
    each round doubles the length of what is followed, so a chain of n takes log n."""
    while True:
        ahead = least.select(F.col("old").alias("new"), F.col("new").alias("far"))
        longer = least.join(ahead, "new").select("old", F.col("far").alias("new"), (F.col("far") != F.col("new")).alias("moved"))
        longer = stage(longer, "followed")
        least = longer.select("old", "new")
        if longer.filter("moved").isEmpty():
            return least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b).  Each round points every node
    to its smallest neighbour, follows these pointers to their ends and renames the
    links, until none is left.  A chain in order of its names is done in one round, and a
    round leaves at most half of the names that have links."""
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b"), "links")
    names = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    names = stage(names, "names")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("old")).agg(F.min("b").alias("b")).select("old", F.least("old", "b").alias("new"))
        least = followed(stage(least, "renamed"))
        names = stage(names.join(least, names.component == least.old, "left")
                      .select("node", F.coalesce("new", "component").alias("component")), "names")
        left = least.select(F.col("old").alias("a"), F.col("new").alias("x"))
        right = least.select(F.col("old").alias("b"), F.col("new").alias("y"))
        edges = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = stage(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return names


def classes(prints: DataFrame, distance: int = DISTANCE, limit: int = LIST) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint; ``prints``: (doc_id, fp),
    stored.  component_id: smallest id in the class."""
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    joined = components(links(nodes.select("fp"), distance, limit))
    named = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = stage(named, "simhash-named")
    least = stage(named.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-least")
    return named.join(least, "component").select("fp", "component_id", "component")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, limit: int = LIST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits),
    component_id (smallest id that links lead to, its own included)."""
    prints, name = with_fingerprint(docs.select("doc_id", "text"))
    prints = stage(prints.select("doc_id", quoted(name).alias("fp")), "simhash-prints")
    found = classes(prints, distance, limit)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, limit: int = LIST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, nulls last, and
    any one of rows with that id."""
    row, fp = free_name(docs, "row"), free_name(docs, "fp")
    prints, fp = with_fingerprint(docs, text, fp)
    rows = stage(prints.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    narrow = rows.select(quoted(row).alias("row"), quoted(id_col).alias("doc_id"), quoted(fp).alias("fp"))
    found = stage(narrow.join(classes(narrow, distance, limit), "fp"), "simhash-found")
    # the first row of a class, found by a sum that merges before the shuffle
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("n"))
    # stored, so that the join on a large class is split
    first = stage(first.filter("n > 1").select("component", F.col("first.row").alias("kept")), "simhash-first")
    gone = stage(found.join(first, "component").filter("row <> kept").select(F.col("row").alias(row)), "simhash-gone")
    return rows.join(gone, row, "left_anti").select(*[quoted(c) for c in docs.columns])
