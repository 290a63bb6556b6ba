"""Hard negatives against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import hardnegs

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(rows, every=5, positives=5, negatives=10, low=30, high=90, scale=256):
    limit = math.isqrt((1 << hardnegs.BITS) // max([len(v) for _, v, l in rows if v is not None] or [1]))
    held = []
    for i, v, l in rows:
        if l is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(min(max(scale * x, -limit), limit)) for x in v], l))
    order = lambda s, i: (-s, i is None, i or 0)
    out = Counter()
    for a, (i, x, l) in enumerate(held):
        if i is None or i % every:
            continue
        others = [(product(x, y), j, m) for b, (j, y, m) in enumerate(held) if b != a]
        same = sorted((o for o in others if o[2] == l), key=lambda o: order(*o[:2]))[:positives]
        for p, j, _ in same:
            fit = sorted((o for o in others if o[2] != l and low * p <= 100 * o[0] <= high * p), key=lambda o: order(*o[:2]))[:negatives]
            out.update((i, j, rank, k, p, s) for rank, (s, k, _) in enumerate(fit, 1))
    return out


def mined(spark, rows, every=5, parts=3, **options):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("r")).withColumn("x", F.lit(1)).withColumn("anchor", F.lit(2)).repartition(parts)
    found = hardnegs.hard_negatives(table, anchors=F.col("vec_id") % every == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, found.collect()))


def drawn(seed, n, d, spread=0.4, labels=4):
    """Clustered vectors of many lengths, some repeated."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, d))
    x = centres[draw.integers(6, size=n)] + spread * draw.normal(size=(n, d))
    x *= draw.uniform(0.2, 2, size=(n, 1))
    x[n // 2:n // 2 + n // 10] = x[0]  # ties
    return [(i, row.tolist(), int(draw.integers(labels))) for i, row in enumerate(x)]


@pytest.mark.parametrize("options", [{}, {"block": 40, "group": 1, "chunk": 16}, {"block": 64, "group": 2, "chunk": 7, "positives": 2, "negatives": 3}])
def test_against_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(hardnegs, "LEAF", 5)
    rows = drawn(1, 260, 6)
    limits = {k: v for k, v in options.items() if k in ("positives", "negatives")}
    assert mined(spark, rows, **options) == brute(rows, **limits)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    draw = random.Random(2)
    rows = drawn(5, 60, 3)
    rows += [(100, None, 1), (105, [1.0, None, 2.0], 1), (110, [math.nan, 1.0, 1.0], 2), (115, [math.inf, 0.0, 0.0], 2), (120, [0.1, 0.2, 0.3], None),
             (None, [0.5, 0.5, 0.5], 1), (None, [0.4, 0.5, 0.5], 2), (125, [], 1), (130, [0.7], 0), (135, [0.2, 0.1, 0.4, 0.9], 3), (140, [1e300, -1e300, 1e9], 1),
             (145, [0.0, 0.0, 0.0], 2), *[(150, [0.3, 0.3, 0.3], 0)] * 3, *[(155 + i, [0.3, 0.3, 0.3], draw.randrange(4)) for i in range(20)]]
    assert mined(spark, rows, block=30, group=2) == brute(rows)


def test_scores_below_zero_and_few_rows(spark):
    assert mined(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.5], 1)]) == Counter()
    rows = [(0, [0.1], 0), (1, [0.0], 0), (2, [0.0], 1), (3, [0.001], 1)]
    assert mined(spark, rows) == brute(rows) != Counter()
    assert mined(spark, [(0, [1.0], 0)]) == Counter()
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 0), (3, [0.5], 1)]) == Counter()  # no anchor
    assert mined(spark, []) == Counter()


def test_the_cover_tree(monkeypatch):
    monkeypatch.setattr(hardnegs, "LEAF", 4)
    x = np.floor(256 * np.array([v for _, v, _ in drawn(8, 300, 4, 0.1)]))
    longest = float((x * x).sum(axis=1).max())
    far = hardnegs.distances(x, longest)
    nodes = hardnegs.cover_tree(far)
    assert sorted(n[0] for n in nodes if n[0] >= 0) == list(range(300))
    levels = 0
    for at, (row, point, stop, radius) in enumerate(nodes):
        centre = nodes[point][0]
        assert stop > at and point <= at and (row >= 0) == (point == at)
        within = [n[0] for n in nodes[at:stop] if n[0] >= 0]
        assert all(far[centre, r] <= radius for r in within if r != centre)
        if row < 0:
            levels += 1
            assert radius * hardnegs.BASE <= next(n[3] for n in reversed(nodes[:at]) if nodes[n[1]][0] == centre) * (1 + 1e-9)
    assert levels > 3


def test_bounds_skip_nodes(monkeypatch):
    """Few rows of tight groups are scored for a narrow window."""
    draw = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(draw.normal(size=(40, 16)), 50, axis=0) + 0.01 * draw.normal(size=(2000, 16))))
    nodes = hardnegs.cover_tree(hardnegs.distances(x, float((x * x).sum(axis=1).max())))
    row, point, stop, radius = zip(*nodes)
    table = pa.table({"point": point, "stop": stop, "radius": radius, "row": row, "id": row, "label": [1] * len(nodes),
                      "x": pa.array([x[r].astype(int).tolist() if r >= 0 else None for r in row], pa.list_(pa.int64()))})
    tree = hardnegs.Tree(table, 16)
    scores = np.sort(x @ x[0])[::-1]
    lists = hardnegs.Lists(np.array([scores[60] / 2]), np.array([float(scores[60])]), 10)
    made = hardnegs.search(tree, x[:1], np.array([0]), np.array([-5]), np.zeros((1, 1), int), False, lists)
    assert lists.cut()[1].tolist() == scores[scores <= scores[60]][:10].tolist()
    assert made < 800
