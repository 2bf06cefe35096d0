import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row int, `a.b` int"


def rows():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((5, 16))
    found = [(i, [float(x) for x in centres[i % 5] * (0.5 + (i % 7) / 5) + rng.standard_normal(16) / 3], int(rng.integers(0, 4))) for i in range(500)]
    found += [(1000 + i, found[50][1], i % 3) for i in range(150)]  # copies, of several labels
    found += [(2000, None, 0), (2100, [None] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [float("inf")] * 16, 0), (2400, found[1][1], None)]
    found += [(2500, [0.0] * 16, 1), (None, found[0][1], 0), (2600, [1.0], 77), (2700, [], 0)]  # zero, no id, lone label, empty
    found += [(3, found[3][1], found[3][2])]  # a repeated row
    return found


def brute(found, k=5, n=10):
    good = [
        (i, g, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, g in found
        if i is not None and v is not None and g is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, own, q in good:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=False)), i, g) for i, g, v in good if i != a]
        for neg, p, _ in sorted(s for s in scored if s[2] == own)[:k]:
            fits = sorted(s for s in scored if s[2] != own and 30 * -neg <= 100 * -s[0] <= 90 * -neg)
            out += [(a, p, r + 1, i, -neg, -s) for r, (s, i, _) in enumerate(fits[:n])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"tree_rows": 200, "fan": 4, "leaf_rows": 20, "task_bytes": 16 * 8 * 64, "least_rows": 8}])
def test_equals_brute_force(spark, sizes):
    vectors = hn.labelled(spark.createDataFrame([(*r, 7, 7) for r in rows()], SCHEMA))
    got = hn.hard_negatives(vectors, vectors.filter(F.col("vec_id") % 100 == 0), **sizes).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == brute(rows())


def test_ranges_eliminate_siblings_and_keep_all_that_lies_in_the_window():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8)) * 900
    whole = np.floor(centres[rng.integers(0, 12, 4000)] + rng.standard_normal((4000, 8)) * 40)
    square = float((whole * whole).sum(axis=1).max())
    tree = hn.Tree(hn._filled(whole[::10], square, False), 6, 3, 10)
    leaf, met = tree.descend(hn._filled(whole, square, False))
    ranges = [
        (node, p, c, d[own == c, p].min(), d[own == c, p].max()) for node, _, d, own in met for c in np.unique(own) for p in range(d.shape[1])
    ]
    tree.ranges(ranges)
    asked = 0
    for i in range(0, 4000, 200):
        scores = whole @ whole[i]
        low, high = np.sort(scores)[[-60, -20]]
        x = hn._filled(whole[i : i + 1], square, True)
        flat = float((x * x).sum()) + square
        leaves = tree.reach(x, np.sqrt([flat - 2 * high]), np.sqrt([flat - 2 * low]))[0]
        assert set(leaf[(scores >= low) & (scores <= high)]) <= set(leaves)
        asked += len(leaves)
    assert tree.leaves > 30 and asked < 20 * tree.leaves / 3
    assert all(len(x) == 0 for x in tree.reach(x, np.array([np.nan]), np.array([5.0])))


def test_fewer_than_asked_and_empty_tables(spark):
    few = spark.createDataFrame([(0, 1, [10]), (1, 1, [9]), (2, 2, [8]), (3, 2, [3]), (4, 2, [2]), (5, 2, [-4])], "vec_id long, label long, v array<long>")
    anchor = few.filter("vec_id = 0")
    got = hn.hard_negatives(few, anchor).collect()
    assert [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in sorted(got, key=lambda r: r["rank"])] == [
        (0, 1, 1, 2, 90, 80),
        (0, 1, 2, 3, 90, 30),
    ]
    none = few.filter("vec_id > 9")
    assert hn.hard_negatives(none, none).count() == 0
    assert hn.hard_negatives(few, none).count() == 0
    assert hn.hard_negatives(none, few).count() == 0
    assert hn.hard_negatives(few, anchor.union(anchor)).count() == 4


def test_scores_beyond_doubles(spark):
    big = 2**29
    rows = [(0, 1, [big, 3]), (1, 1, [big, 7]), (2, 2, [big // 2, 1]), (3, 2, [big // 2, 2]), (4, 2, [big, 1])]
    vectors = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    got = hn.hard_negatives(vectors, vectors.filter("vec_id = 0")).collect()
    assert [(r.negative_id, r.negative_score) for r in sorted(got, key=lambda r: r["rank"])] == [(3, big * big // 2 + 6), (2, big * big // 2 + 3)]
