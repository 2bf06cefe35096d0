"""Retrieval metrics against the same measures taken of lists."""

import math
import random
import statistics

from corpusloom.operators import evaluate as E
from corpusloom.operators import retrieval as R

SCHEMA = "query_id string, rank int, score double, rerank_score double"


def of_lists(rows, k=5):
    """The measures of one query's (rank, score, rerank score) rows, null scores last among the best."""
    best = [s if r is None else r for _, s, r in sorted(rows, key=lambda x: (x[0], x[1] if x[2] is None else x[2]))]
    gain = lambda s: max(0.0, (s + 5) / 10) if s < 0 else min(s, 1.0)
    dcg = lambda xs: sum(gain(x) / math.log2(i + 2) for i, x in enumerate(xs[:k]))
    ideal = dcg(sorted(best, reverse=True))
    place = next((i for i, s in enumerate(best) if s >= 0.5), None)
    return (
        len(rows), dcg(best) / ideal if ideal else 0.0, 0.0 if place is None else 1 / (place + 1), sum(s > 0 for s in best[:k]) / k, sum(s > 0.3 for s in best[:k]) / k,
        statistics.median(s for _, s, _ in rows),
    )


def test_equal_to_measures_of_lists(spark):
    rng = random.Random(2)
    rows = []
    for q in [*(f"q{i}" for i in range(25)), None]:
        for rank in range(rng.choice([1, 3, 5, 40])):
            rows.append((q, rank // 2 if q == "q3" else rank, round(rng.uniform(-1, 1), 2), round(rng.uniform(-6, 1), 2) if q in ("q1", "q2") else None))
    rows += [("low", i, 0.1, None) for i in range(9)] + [("hot", i, (i % 7) / 10, None) for i in range(3000)] + [("late", i, float(i == 2500), None) for i in range(2600)]
    rng.shuffle(rows)
    got = {r.query_id: r for r in E.retrieval_metrics(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    queries = {q for q, *_ in rows}
    assert set(got) == queries
    for q in queries:
        r = got[q]
        want = of_lists([x[1:] for x in rows if x[0] == q])
        assert all(abs(a - b) < 1e-9 for a, b in zip((r.n, r.ndcg, r.mrr, r.positive_share, r.precision, r.median), want, strict=True)), q
    assert got["late"].mrr == 1 / 2501


def test_no_rows(spark):
    assert E.retrieval_metrics(spark.createDataFrame([], SCHEMA)).count() == 0


def test_steps_and_traces_count_alike(spark):
    step = "struct<step:string,kept:long,dropped:long,action:string,n_queries:long,verified:boolean>"
    rows = [("a", [("s", 1, 2, "retry", 1, False), ("t", 3, 0, "proceed", 2, True)]), ("b", []), ("c", None)]
    traces = spark.createDataFrame(rows, f"query_id string, trace array<{step}>")
    got = {r.query_id: tuple(r)[1:] for r in R.agent_trace_summary(traces).collect()}
    assert got == {"a": (2, 3, 4, 2, 1, True), "b": (0, 0, 0, 0, 0, False), "c": (0, 0, 0, 0, 0, False)}
