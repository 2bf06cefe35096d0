"""The semantic cache against a comparison of every query with every entry."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R

BASE = datetime.datetime(2024, 1, 1)
ASKED = "query_id long, context_hash string, embedding array<double>, ts timestamp"
HELD = "entry_id string, context_hash string, embedding array<double>, stored_at timestamp"


def tables(contexts, n=240, width=8):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((9, width))
    at = lambda: BASE + datetime.timedelta(seconds=float(rng.integers(0, 9000)) + 0.5)
    vector = lambda: [float(x) for x in centres[rng.integers(9)] * rng.uniform(0.2, 3) + rng.standard_normal(width) / 3]
    asked = [(i, contexts[i % len(contexts)], vector(), at()) for i in range(n)]
    held = [(f"e{i:04}", contexts[i % len(contexts)], vector(), at()) for i in range(2 * n)]
    held += [(f"f{i}", c, held[i][2], held[i][3]) for i, c in enumerate([contexts[0]] * 9)]  # equal vectors and times
    held += [("n0", None, vector(), at()), ("n1", contexts[0], None, at()), ("n2", contexts[0], [None] * width, at()), ("n3", contexts[0], [0.0] * width, at()), ("n4", contexts[0], [1.0], at()), ("n5", contexts[0], [float("nan")] * width, at()), ("n6", contexts[0], vector(), None)]
    held += [(f"s{i}", contexts[0], [1.0, float(i)], at()) for i in range(20)]  # a size of their own
    asked += [(9000, None, vector(), at()), (9001, contexts[0], None, at()), (9002, contexts[0], [0.0] * width, at()), (9003, contexts[0], [1.0, 2.0], at()), (9004, contexts[0], vector(), None)]
    return asked, held


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(asked, held, threshold, ttl):
    out = {}
    for q, c, v, t in asked:
        best = None
        for e, k, w, s in held:
            if None in (c, k, t, s) or c != k or not good(v) or not good(w) or len(v) != len(w) or s > t or int(t.timestamp()) - int(s.timestamp()) > ttl:
                continue
            norms = np.linalg.norm(v) * np.linalg.norm(w)
            sim = float(np.dot(v, w) / norms) if norms else 0.0
            if sim >= threshold and (best is None or (-round(sim, 12), s, e) < best[0]):
                best = ((-round(sim, 12), s, e), sim)
        out[q] = None if best is None else (best[0][2], round(best[1], 9))
    return out


@pytest.mark.parametrize(("contexts", "sizes"), [(["empty"], {"cell": 50, "pivots": 5}), (["a", "b", "c", "d"], {}), (["empty"], {"cell": 7, "pivots": 1})])
@pytest.mark.parametrize("threshold", [0.92, 0.0])
def test_equals_a_comparison_of_all(spark, contexts, sizes, threshold):
    asked, held = tables(contexts)
    got = R.semantic_lookup(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD), threshold, 3600, **sizes).collect()
    assert {r.query_id: None if r.entry_id is None else (r.entry_id, round(r.similarity, 9)) for r in got} == brute(asked, held, threshold, 3600)
    assert len(got) == len(asked)


def test_pivots_leave_entries_out_and_none_that_matches():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    entries, queries = (unit(centres[rng.integers(0, 20, n)] + rng.standard_normal((n, 16)) / 12) for n in (3000, 200))
    pivots = R._spread_pivots(entries[:200], 24)
    angles = R._angles(entries, pivots)
    own = angles.argmin(axis=1)
    radius = np.array([angles[own == i, i].max(initial=-np.inf) for i in range(len(pivots))])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(queries.tolist(), pa.list_(pa.float64()))], ["embedding"])
    found = next(R._pivots_in_reach(pivots, radius, math.acos(0.92))(iter([batch]))).column("pivot").to_pylist()
    met = sum((own[:, None] == np.array(f)[None]).any(axis=1).sum() for f in found)
    for q, f in zip(queries, found, strict=True):
        assert set(own[entries @ q >= 0.92]) <= set(f)
    assert met < 0.4 * len(entries) * len(queries)


def test_empty_tables(spark):
    none, asked = spark.createDataFrame([], HELD), spark.createDataFrame(tables(["a"])[0], ASKED)
    assert R.semantic_lookup(asked, none).filter(F.col("entry_id").isNotNull()).count() == 0
    assert R.semantic_lookup(asked.limit(0), none).count() == 0
