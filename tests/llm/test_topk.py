import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import topk
from corpusloom.llm.topk import quantized, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows():
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.standard_normal(24) * (0.2 + (i % 7) / 3)], 0) for i in range(400)]
    vectors += [(1000 + i, vectors[50][1], 0) for i in range(150)]  # copies
    vectors += [(2000, None, 0), (2050, [None] * 24, 0), (2100, [float("nan")] * 24, 0), (2150, [float("inf")] * 24, 0)]
    vectors += [(2200, [0.0] * 24, 0), (None, vectors[0][1], 0), (3, vectors[3][1], 0)]  # zero, no id, repeated
    return vectors


def brute(vectors, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(64_000_000, 4096, 4096), (24 * 8 * 32, 4, 8)])
def test_equals_brute_force(spark, sizes):
    vectors = quantized(spark.createDataFrame(rows(), SCHEMA))
    got = top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5, *sizes)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows(), 5)


def test_pruning_leaves_work_out_and_the_result_whole():
    rng = np.random.default_rng(2)
    m = np.floor(rng.standard_normal((3000, 48)) * 60)
    bucket = topk.Bucket(np.arange(3000), m)
    q = m[7] + np.floor(rng.standard_normal(48) * 5)
    scores = m @ q
    bound = np.sort(scores)[-5]
    ids, got = bucket.search(-1, q, float(bound), 5)
    order = np.lexsort((np.arange(3000), -scores))[:5]
    assert ids.tolist() == order.tolist() and got.tolist() == scores[order].tolist()
    assert bucket.search(-1, q, float(scores.max() * 50), 5)[0].size == 0


def test_fewer_than_k_and_empty_tables(spark):
    few = quantized(spark.createDataFrame([(0, [1.0], 0), (1, [2.0, 1.0], 0)], SCHEMA))
    assert [(r.query_id, r.vec_id, r.score) for r in top_k(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 256 * 512)]
    none = quantized(spark.createDataFrame([], SCHEMA))
    assert top_k(none, none).count() == 0
    assert top_k(few, none).count() == 0
    assert top_k(none, few).count() == 0


def test_products_beyond_doubles_and_repeated_queries(spark):
    big = 2**27
    rows = [(0, [big, 3]), (1, [big, 1]), (2, [big, 2]), (3, [-big, 9]), (4, [1])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asked = spark.createDataFrame([rows[0], rows[0]], "vec_id long, v array<long>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(vectors, asked, 3).collect()]
    want = [(0, 1, 2, big * big + 6), (0, 2, 1, big * big + 3), (0, 3, 4, big)]
    assert sorted(got) == sorted(want * 2)
