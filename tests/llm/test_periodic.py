import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import periodic
from tests.llm.fixtures import clashing, documents, empty


def brute(words):
    """Runs by comparing every word with the one q on, for every q."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def stutters(rng, n, letters):
    words = [str(rng.randrange(letters)).encode() for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            end = rng.randint(a, n)
            words = [words[a + (i - a) % p] if a <= i < end else w for i, w in enumerate(words)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    texts = [stutters(rng, rng.randint(0, 200), rng.choice([1, 2, 3, 9, 60])) for _ in range(300)]
    texts += [[b"a"] * 2000, ([b"a", b"b"] * 90 + [b"x"]) * 7, [b"q"] * 23, [b"q"] * 24, [b"a", b"b"] * 12, [], []]
    texts += [list(texts[-6]), [b"a"] * 40, [b"a"] * 40]  # equal texts side by side don't make one run
    got = periodic.find_runs(texts)
    assert [[tuple(map(int, r)) for r in got.get(i, ())] for i in range(len(texts))] == [brute(t) for t in texts]
    assert sum(map(len, got.values())) > 100


@pytest.mark.parametrize("prime", periodic.PRIMES)
def test_sums_of_squared_differences_are_exact(prime):
    rng = np.random.default_rng(2)
    for block in (8, 32):
        blocks, windows = (rng.integers(0, 1 << 20, (5, n)).astype(np.uint64) for n in (block, 2 * block))
        got = periodic.Transform(2 * block, *prime).squared_differences(blocks, windows)
        want = [[int(((b.astype(int) - w[k : k + block].astype(int)) ** 2).sum()) % prime[0] for k in range(block)] for b, w in zip(blocks, windows, strict=True)]
        assert got.astype(np.uint64).tolist() == want


def test_sums_over_one_prime_need_more_of_them():
    """Numbers whose squared difference is a multiple of the first prime are no match."""
    p = periodic.PRIMES[0][0]
    words = np.arange(64, dtype=np.uint64) * np.uint64(p)
    both = periodic.occurrences(words, np.array([0]), 8, 8, periodic.PRIMES[:2])
    one = periodic.occurrences(words, np.array([0]), 8, 8, periodic.PRIMES[:1])
    assert len(both[0]) == 0 and len(one[0]) == 8


def test_rows_and_collapsed_texts(spark):
    docs = documents(spark)
    rows = {i: (r.text or "").encode().split() for i, r in enumerate(docs.collect())}
    loop = "go round " * 20 + "and on"
    docs = docs.union(spark.createDataFrame([(900, loop, None, None, None, None, None, None)], docs.schema)).coalesce(1)
    rows[len(rows)] = loop.encode().split()
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    for r, words in zip(got, rows.values(), strict=True):
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(x) for x in r._runs] == runs and r._n_words == len(words)
        assert bytes(r._kept) == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert bytes(got[-1]._kept) == b"go round and on"


def test_stuttering_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(300)] + [(None, "x y"), (7, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string").withColumn("out", periodic.stuttering(F.col("text"), F.col("doc_id"))).collect()
    changed = 0
    for r in got:
        words = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.out.split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        else:
            assert r.out == r.text
    assert changed > 15


def test_clashing_names_and_empty_tables(spark):
    docs = clashing(spark).withColumn("_runs", F.lit(1))
    got = periodic.periodic_runs(docs)
    assert sorted(got.columns) == sorted([c for c in docs.columns if c not in ("text", "_runs", "_kept")] + ["_n_words", "_runs", "_kept"])
    assert got.filter("`a.b` = 7 and _n_words >= 0").count() == docs.count()
    assert periodic.periodic_runs(empty(spark)).count() == 0
    assert periodic.periodic_runs(docs.select("text")).columns == ["_n_words", "_runs", "_kept"]
    assert "text" in periodic.periodic_runs(docs, keep_text=True).columns
