"""Forms for large input give the same rows as those for small input and as brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.percentiles import index_percentiles
from corpusloom.operators import dedup as D
from corpusloom.operators import retrieval as R


def greedy(pairs):
    fallen = set()
    for later, earlier in sorted((b, a) for a, b in pairs):
        if earlier not in fallen:
            fallen.add(later)
    return fallen


@pytest.mark.parametrize("scan", [5, 20, D.SCAN])
def test_fuzzy_scan_and_rounds_agree(spark, scan):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(12)]
    pairs = sorted({tuple(sorted(rng.sample(range(100, 130), 2))) for _ in range(60)} | set(chain))
    got = D.fuzzy_dropped(spark.createDataFrame(pairs * 2, "earlier long, later long"), scan=scan)
    rows = [r.r for r in got.collect()]
    assert sorted(rows) == sorted(greedy(pairs))


def test_a_long_chain_of_near_copies_is_decided(spark):
    pairs = [(i, i + 1) for i in range(3000)]
    got = D.fuzzy_dropped(spark.createDataFrame(pairs, "earlier long, later long"))
    assert {r.r for r in got.collect()} == set(range(1, 3001, 2))


def test_components_beyond_a_scan_are_cut_in_blocks(spark, monkeypatch):
    """A chain in order, two dense components and many small ones; no task scans more than about a block."""
    rng = random.Random(8)
    pairs = {(i, i + 1) for i in range(700)}
    for base, n, m in ((1000, 60, 500), (2000, 90, 900)):
        pairs |= {tuple(sorted(rng.sample(range(base, base + n), 2))) for _ in range(m)}
    for base in range(5000, 9000, 40):
        pairs |= {tuple(sorted(rng.sample(range(base, base + 8), 2))) for _ in range(12)}
    rounds = []
    whole = D._scanned
    monkeypatch.setattr(D, "_scanned", lambda p: rounds.append(p.groupBy("component").count().agg(F.max("count")).first()[0]) or whole(p))
    got = D.fuzzy_dropped(spark.createDataFrame(sorted(pairs), "earlier long, later long"), scan=200)
    assert sorted(r.r for r in got.collect()) == sorted(greedy(pairs))
    assert max(r or 0 for r in rounds) <= 400 and len(rounds) < 12


def test_components_are_scanned_whole_after_a_join(spark):
    """Chains, which rounds don't halve, in several partitions: those of one component stay together."""
    pairs = [(i, i + 1) for i in range(700)] + [(1000 * c + i, 1000 * c + i + 1) for c in range(1, 60) for i in range(60)]
    random.Random(5).shuffle(pairs)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = [r.r for r in D.fuzzy_dropped(spark.createDataFrame(pairs, "earlier long, later long").repartition(8), scan=300).collect()]
    finally:
        spark.conf.unset(name)
    assert sorted(got) == sorted(greedy(pairs))


def test_rounds_decide_dense_pairs(spark, monkeypatch):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(400), 2))) for _ in range(9000)})
    asked = []
    whole = D.connected_components
    monkeypatch.setattr(D, "connected_components", lambda e: asked.append(1) or whole(e))
    got = [r.r for r in D.fuzzy_dropped(spark.createDataFrame(pairs, "earlier long, later long"), scan=500).collect()]
    assert sorted(got) == sorted(greedy(pairs)) and not asked


@pytest.mark.parametrize(("part", "scan"), [(20, D.SCAN), (60, 40), (1000, D.SCAN)])
def test_parts_drop_what_a_scan_of_all_pairs_drops(spark, monkeypatch, part, scan):
    rng = random.Random(part)
    values, v = [], 0
    for i in range(300):
        v = rng.getrandbits(64) if i % 50 == 0 else v ^ (1 << rng.randrange(64))
        values.append(v - (1 << 64) if v >> 63 else v)
    values = list(dict.fromkeys(values))
    rng.shuffle(values)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    pairs = [(i, j) for j in range(len(values)) for i in range(j) if near(values[i], values[j])]
    made, whole = [], D.near_pairs
    monkeypatch.setattr(D, "near_pairs", lambda *a: made.append(whole(*a).count()) or whole(*a))
    rows = spark.createDataFrame(list(enumerate(values)), "i long, simhash long").repartition(3)
    got = [r.r for r in D.near_dropped(rows, "i", part=part, scan=scan).collect()]
    assert sorted(got) == sorted(greedy(pairs))
    assert sum(made) < len(pairs) / 2 or part == 1000


def test_texts_are_hashed_once_and_not_kept(spark, monkeypatch):
    kept, whole = [], D.checkpoint
    monkeypatch.setattr(D, "checkpoint", lambda df: kept.append(df.columns) or whole(df))
    rows = [(i, t) for i, t in enumerate(["a b c", "A  b c", None, "", "x y z w", "x y z w"])]
    got = {r.i: (r.is_exact_duplicate, r.is_fuzzy_duplicate, r.text) for r in D.mark_duplicates(spark.createDataFrame(rows, "i long, text string"), "i").collect()}
    assert [got[i][0] for i in range(6)] == [False, True, False, True, False, True] and not any(f for _, f, _ in got.values())
    assert [got[i][2] for i in range(6)] == [t for _, t in rows] and not any("text" in c for c in kept)


def test_no_pairs_and_text_keys(spark):
    none = spark.createDataFrame([], "earlier string, later string")
    assert D.fuzzy_dropped(none).collect() == []
    some = spark.createDataFrame([("a", "b"), ("b", "c")], "earlier string, later string")
    assert [r.r for r in D.fuzzy_dropped(some).collect()] == ["b"]


@pytest.mark.parametrize("distance", [0, 1, 3, 5, 12])
def test_near_values_are_all_found(spark, distance):
    rng = random.Random(distance)
    values = set()
    for _ in range(25):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(6):
            w = v
            for bit in rng.sample(range(64), rng.randint(0, distance + 1)):
                w ^= 1 << bit
            values.add(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = D.near_values(spark.createDataFrame([(v,) for v in signed], "simhash long"), distance).collect()
    want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= distance}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_keys_of_near_values_are_never_broadcast(spark):
    """Few values make many keys, of which Spark expects only as many as there are values."""
    values = spark.range(3000).select(F.xxhash64("id").alias("simhash")).distinct()
    met = D.near_values(values, 3)
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_queries_meet_the_corpus_in_cells(spark, monkeypatch):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    corpus = spark.createDataFrame([(i, vector() if i % 50 else None) for i in range(300)] + [(900, [0.0] * 8)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, vector() if i != 7 else None) for i in range(70)] + [(99, [0.0] * 8)], "query_id long, embedding array<float>")
    want = sorted(map(tuple, R.dense_topk(queries, corpus, 4, 0.1).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 16)
    monkeypatch.setattr(R, "SLAB", 64)
    monkeypatch.setattr(R, "PIECE", 10)
    got = sorted(map(tuple, R.dense_topk(queries, corpus, 4, 0.1).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_no_corpus_rows_in_cells(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 1)
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "query_id long, embedding array<float>")
    assert R.dense_topk(queries, spark.createDataFrame([], "chunk_id long, embedding array<float>")).collect() == []


def test_common_terms_are_dealt(spark, monkeypatch):
    rng = random.Random(8)
    corpus = spark.createDataFrame([(i, w, rng.random()) for i in range(60) for w in ["the", *rng.sample("abcdefgh", 3)]], "chunk_id long, term string, weight double")
    queries = spark.createDataFrame([(q, w, rng.random()) for q in range(5) for w in ["the", *rng.sample("abcdxyz", 2)]], "query_id long, term string, weight double")
    want = sorted((*r[:3], round(r[3], 9)) for r in R.sparse_topk(queries, corpus, 7).collect())
    monkeypatch.setattr(R, "HELD_TERMS", 0)
    assert sorted((*r[:3], round(r[3], 9)) for r in R.sparse_topk(queries, corpus, 7).collect()) == want
    scores = {}
    held = {(r.chunk_id, r.term): r.weight for r in corpus.collect()}
    for r in queries.collect():
        for (c, t), w in held.items():
            if t == r.term:
                scores[r.query_id, c] = scores.get((r.query_id, c), 0.0) + w * r.weight
    for q in range(5):
        best = sorted((-round(s, 9), c) for (x, c), s in scores.items() if x == q)[:7]
        assert [(c, -s) for s, c in best] == [(w[2], w[3]) for w in want if w[0] == q]


@pytest.mark.parametrize("name", ["outlier", "ties", "one", "spread"])
def test_index_percentiles_of_uneven_values(spark, name):
    rng = random.Random(11)
    held = {
        "outlier": [rng.random() for _ in range(3000)] + [1e12, -1e12],
        "ties": [5.0] * 2500 + [1.0, 9.0] * 20,
        "one": [3.0],
        "spread": [rng.lognormvariate(0, 3) for _ in range(20_000)],
    }[name]
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame([("g", v) for v in held] + [("h", 2.0), ("h", None)], "g string, v double").repartition(7)
    got = {r.g: r.asDict() for r in index_percentiles(df, "v", shares, ["g"]).collect()}
    ordered = sorted(held)
    for label, p in shares.items():
        assert got["g"][label] == ordered[min(int(len(ordered) * p), len(ordered) - 1)]
        assert got["h"][label] == 2.0


@pytest.mark.parametrize("keys", [None, ["g"]])
def test_percentiles_broadcast_the_brackets_and_not_the_values(spark, monkeypatch, keys):
    from corpusloom.functions import percentiles as P

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("g"))
    plan = P.index_percentiles(df, "v", {"p50": 0.5}, keys)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    want = {tuple(r) for r in P.index_percentiles(df, "v", {"p50": 0.5}, keys).collect()}
    monkeypatch.setattr(P, "GROUPS", 0)
    assert {tuple(r) for r in P.index_percentiles(df, "v", {"p50": 0.5}, keys).collect()} == want
