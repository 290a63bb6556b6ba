"""Hard negatives by inner product, exactly, from cover trees.

For an anchor and each of its positives (the first ``positives`` other rows of its label),
the first ``negatives`` rows of other labels whose score lies in a window below the
positive's.  First is who has the higher score, of equals the smaller id.

Inner products have no triangle inequality, so every vector gets one more component,
the root of what its squared length lacks of the longest vector's.  All are then equally
long, an anchor's (whose further component is 0) products are unchanged, and rows at a
distance of at most r from a row c have products within ``|anchor| * r`` of c's.

- *Index.*  Rows are dealt to blocks of about ``BLOCK``; each block is ordered as a cover
  tree: the radius falls by ``BASE`` from level to level, the rows of a node are covered by
  itself and by children that are further than the next radius from it and from each
  other, and every node keeps the exact radius that covers its rows on its level.  The
  table of all nodes in tree order, with the end and the radius of each, is stored.
- *Search.*  Cells of up to ``CHUNK`` anchors and ``GROUP`` blocks are searched independently.
  In a cell the nodes of a block are taken best first, by the highest bound of the anchors
  that still need them.  An anchor needs a node if the bounds of the node's products meet one
  of its windows above the product that its list there has reached.  The rows of leaves and
  the children of nodes are scored exactly for the anchors that need them, and what is
  reached goes on to the next block.
- The lists of all cells are merged by rank.  Positives come from one such search, with
  the anchor's label and no window, negatives from a second.

Every anchor meets every block, in cells of bounded size, since each row may be the answer;
how many rows are scored is up to the bounds.  Nothing passes through the driver
but counts.

Rows with a null label or vector, or with a null or non-finite component, take no part.
A component is floor(``scale`` * x), and at most so large that products fit 50 bits (beyond
about 16,000 at 64 components it counts as that much).  Components that a shorter vector lacks
are 0.  A null id is no anchor and comes last among equals.  Repeated rows are rows of their
own: a copy of an anchor is another row.  An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.session import stage

from .common import quoted

BLOCK = 2048   # rows of a tree, about
GROUP = 4      # trees of a cell
CHUNK = 4096   # anchors of a cell
LEAF = 24      # rows of a node that is not divided
BASE = 1.3     # by which the radius falls from level to level
BITS = 50      # of a product
ANCHORS = 512  # anchors searched for at a time
NO_ID = np.iinfo(np.int64).max  # stands for a null id


def vectors(table: DataFrame, anchors: Column, id_col: str, vector: str, label: Column, scale: int) -> DataFrame:
    """row, id, label, x (whole numbers), anchor of the rows that take part, as a stored table."""
    v = quoted(vector)
    finite = F.forall(v, lambda c: F.abs(c.cast("double")) < math.inf)  # not so for NaN
    usable = table.filter(label.isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    wide = usable.agg(F.max(F.size(v))).first()[0] or 1
    limit = float(math.isqrt((1 << BITS) // wide))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(scale * c.cast("double"), F.lit(limit)), F.lit(-limit))))
    return stage(usable.select(F.monotonically_increasing_id().alias("row"), F.coalesce(quoted(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"),
                               label.cast("bigint").alias("label"), whole.alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor")), "vectors")


# --- the index ---------------------------------------------------------------


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers; what a row lacks of ``width`` is 0."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def distances(x: np.ndarray, longest: float) -> np.ndarray:
    """Distances of the augmented rows, all of squared length ``longest``, never too small."""
    further = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
    squared = 2 * longest - 2 * (x @ x.T + np.outer(further, further))
    return np.sqrt(np.maximum(squared, 0) + 1e-9 * longest)


def cover_tree(far: np.ndarray) -> list[list]:
    """[row, point, stop, radius] of all nodes in tree order, from the distances of rows.
    A node ends before the place ``stop``; its rows lie within ``radius`` of its point, the
    node at place ``point``, which is another one (and ``row`` is -1) where a node goes on
    with its rows on the next level."""
    nodes: list[list] = []
    work = [(0, -1, np.arange(1, len(far)))] if len(far) else []
    while work:
        row, point, members = work.pop()
        if members is None:  # all that belongs to the node at place ``row`` is entered
            nodes[row][2] = len(nodes)
            continue
        at, reach = len(nodes), far[row, members].max() if len(members) else 0.0
        nodes.append([-1 if point >= 0 else row, point if point >= 0 else at, 0, reach])
        point = nodes[-1][1]
        work.append((at, -1, None))
        if len(members) <= LEAF or reach <= 2 * far[row, row]:
            for other in members.tolist():
                nodes.append([other, len(nodes), len(nodes) + 1, 0.0])
            continue
        reach /= BASE
        outside, inside = members[far[row, members] > reach], members[far[row, members] <= reach]
        if len(inside):
            work.append((row, point, inside))
        while len(outside):
            near = far[outside[0], outside] <= reach
            near[0] = True
            work.append((int(outside[0]), -1, outside[near][1:]))
            outside = outside[~near]
    return nodes


NODE = "block int, place int, point int, stop int, radius double, row bigint, id bigint, label bigint, x array<bigint>"


def index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the cover trees of all blocks, as a stored table."""
    squares = F.aggregate("x", F.lit(0).cast("bigint"), lambda s, c: s + c * c)
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("x")), F.max(squares)).first()
    blocks = max(-(-n // block), 1)

    def build(table: pa.Table) -> pa.Table:
        nodes = cover_tree(distances(matrix(table["x"], width or 0), float(longest or 0)))
        row, point, stop, radius = zip(*nodes)
        # where a node goes on with its own rows, the row is null
        table = table.take(pa.array([None if r < 0 else r for r in row], pa.int64()))
        block = pa.array(np.full(len(nodes), table["block"][0].as_py()), pa.int32())
        return pa.table({"block": block, "place": pa.array(range(len(nodes)), pa.int32()), "point": pa.array(point, pa.int32()),
                         "stop": pa.array(stop, pa.int32()), "radius": pa.array(radius, pa.float64()),
                         **{c: table[c] for c in ("row", "id", "label", "x")}})

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "id", "label", "x")
    return stage(dealt.groupBy("block").applyInArrow(build, NODE), "cover-trees")


# --- the search --------------------------------------------------------------


class Lists:
    """The first ``most`` rows of each window: products from ``low`` to ``high``, best first."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.high, self.most = high, most
        self.reached = low.copy()  # products below are of no use any more
        self.held = [tuple(np.zeros(0, np.int64) for _ in range(4))]
        self.waiting, self.patience = 0, max(4096, 2 * most * len(low))

    def add(self, windows: np.ndarray, products: np.ndarray, usable: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offer products[i, j] of the anchor with windows[i] and the row (ids[j], rows[j])."""
        for window in windows.T:
            i, j = np.nonzero(usable & (products >= self.reached[window][:, None]) & (products <= self.high[window][:, None]))
            self.held.append((window[i], products[i, j].astype(np.int64), ids[j], rows[j]))
            self.waiting += len(i)
        if self.waiting > self.patience:
            self.cut()

    def cut(self) -> tuple:
        """(window, product, id, row) of what is in the lists, in order."""
        window, product, ids, rows = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((rows, ids, -product, window))
        window, product, ids, rows = (c[order] for c in (window, product, ids, rows))
        opens = np.concatenate([[True], window[1:] != window[:-1]])[:len(window)]
        place = np.arange(len(window))
        place -= np.maximum.accumulate(np.where(opens, place, 0))
        full = place == self.most - 1
        self.reached[window[full]] = product[full]
        self.held, self.waiting = [tuple(c[place < self.most] for c in (window, product, ids, rows))], 0
        return self.held[0]


class Tree:
    """A block of the index, in place order."""

    def __init__(self, table: pa.Table, width: int):
        column = lambda c: table[c].fill_null(-1).to_numpy()
        self.point, self.stop, self.radius = column("point"), column("stop"), column("radius")
        self.id, self.row, self.label = column("id"), column("row"), column("label")
        self.x = matrix(table["x"], width)

    def children(self, at: int) -> np.ndarray:
        out, child = [], at + 1
        while child < self.stop[at]:
            out.append(child)
            child = int(self.stop[child])
        return np.array(out, np.int64)


def search(tree: Tree, x: np.ndarray, label: np.ndarray, row: np.ndarray, windows: np.ndarray, same: bool, lists: Lists) -> int:
    """Offer to the lists of the anchors all rows of a tree that may belong there, rows
    of the anchor's label or of all others; returns how many products were made."""
    length, made = np.sqrt((x * x).sum(axis=1)), 0

    def score(anchors, places):
        nonlocal made
        products = x[anchors] @ tree.x[places].T
        made += products.size
        usable = ((tree.label[places] == label[anchors][:, None]) == same) & (tree.row[places] != row[anchors][:, None])
        lists.add(windows[anchors], products, usable, tree.id[places], tree.row[places])
        return products

    def needed(anchors, products, radius):
        """Which anchors' windows the bounds of a node meet, and the highest bound."""
        slack = length[anchors] * radius * (1 + 1e-9) + 1e-3
        met = np.zeros(len(anchors), bool)
        for window in windows[anchors].T:
            met |= (products + slack >= lists.reached[window]) & (products - slack <= lists.high[window])
        return met, float((products + slack)[met].max()) if met.any() else -math.inf

    everyone = np.arange(len(x))
    heap = [(-math.inf, 0, everyone, score(everyone, np.zeros(1, np.int64))[:, 0])]
    while heap:
        _, at, anchors, products = heapq.heappop(heap)
        met, _ = needed(anchors, products, tree.radius[at])  # what is reached may have risen
        anchors, products = anchors[met], products[met]
        children = tree.children(at)
        if not len(anchors) or not len(children):
            continue
        others = children[tree.point[children] == children]
        found = dict(zip(others.tolist(), score(anchors, others).T))
        for child in children.tolist():
            if tree.stop[child] > child + 1:
                of_child = found.get(child, products)  # on the next level a node's point is the same
                met, best = needed(anchors, of_child, tree.radius[child])
                if met.any():
                    heapq.heappush(heap, (-best, child, anchors[met], of_child[met]))
    return made


FOUND = "row bigint, window int, score bigint, id bigint, other bigint"


def searched(anchors: DataFrame, trees: DataFrame, same: bool, most: int, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """FOUND: of each window of each anchor the first ``most`` rows of all trees and their
    scores, ``place`` from 1.  ``anchors``: row, label, x, low and high (arrays, a
    window each); ``trees``: see ``index``."""
    n, width = anchors.agg(F.count("*"), F.max(F.size("x"))).first()
    blocks, wide = trees.agg(F.max("block"), F.max(F.size("x"))).first()
    width = max(width or 0, wide or 0)
    chunks, groups = max(-(-n // chunk), 1), (blocks or 0) // group + 1

    def search_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [tuple(np.zeros(0, np.int64) for _ in range(5))]
        right = right.sort_by([("block", "ascending"), ("place", "ascending")])
        edges = np.flatnonzero(np.diff(right["block"].to_numpy(), prepend=-1)).tolist() + [len(right)]
        trees = [Tree(right.slice(a, b - a), width) for a, b in zip(edges, edges[1:])]
        for at in range(0, len(left) if trees else 0, ANCHORS):
            part = left.slice(at, ANCHORS)
            low, high = (part[c].to_pylist() for c in ("low", "high"))
            wide = max(map(len, low))
            # a window that nothing meets fills up where an anchor has fewer
            flat = lambda lists, none: np.array([[*v, *[none] * (wide - len(v))] for v in lists], float).reshape(-1)
            lists = Lists(flat(low, math.inf), flat(high, -math.inf), most)
            windows = np.arange(len(part) * wide).reshape(len(part), wide)
            row = part["row"].to_numpy()
            for tree in trees:
                search(tree, matrix(part["x"], width), part["label"].to_numpy(), row, windows, same, lists)
            if wide:
                window, product, ids, rows = lists.cut()
                out.append((row[window // wide], window % wide, product, ids, rows))
        columns = [np.concatenate(c) for c in zip(*out)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "window", "score", "id", "other"])

    cells = ["chunk", "cell"]
    left = anchors.select(F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell"),
                          "row", "label", "x", "low", "high")
    right = trees.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.floor(F.col("block") / group).cast("int").alias("cell"), "*")
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(search_cell, FOUND)
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _hundredths(x: Column, part: int, up: bool) -> Column:
    """``part`` hundredths of a whole number, rounded up or down to a whole number."""
    x = part * x
    return F.call_function("div", x + F.pmod(-x, F.lit(100)) if up else x - F.pmod(x, F.lit(100)), F.lit(100))


def hard_negatives(table: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   block: int = BLOCK, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``anchors``: condition on the columns of ``table``; negatives score from ``low`` to
    ``high`` hundredths of their positive."""
    rows = vectors(table, anchors, id_col, vector, quoted(label) if isinstance(label, str) else label, scale)
    trees = index(rows, block)
    asked = rows.filter("anchor").select("row", "id", "label", "x")
    anything = asked.select("row", "label", "x", F.array(F.lit(-math.inf)).alias("low"), F.array(F.lit(math.inf)).alias("high"))
    first = searched(anything, trees, True, positives, group, chunk)
    lists = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    asked = stage(asked.join(lists, "row"), "positives")
    windows = asked.select("row", "label", "x", F.transform("positives", lambda p: _hundredths(p.score, low, True)).alias("low"),
                           F.transform("positives", lambda p: _hundredths(p.score, high, False)).alias("high"))
    found = searched(windows, trees, False, negatives, group, chunk).select("row", "window", "place", F.col("id").alias("negative"), "score")
    known = lambda c: F.when(c != NO_ID, c)
    positive = F.col("positives")[F.col("window")]
    return found.join(asked.select("row", "id", "positives"), "row").select(
        known(F.col("id")).alias("anchor_id"), known(positive["id"]).alias("positive_id"), F.col("place").alias("rank"),
        known(F.col("negative")).alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
