import random

import numpy as np
import pytest

from corpusloom.llm import jaccard_join as jj
from tests.llm.fixtures import clashing, documents, empty
from tests.llm.test_near_dup import components


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, brute_set(t)) for i, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 80 * len(x | y) > 0]
    return sorted((i, len(s), components([i for i, _ in sets], links)[i]) for i, s in sets)


def varied():
    """Groups of texts at similarities around the threshold, of many sizes; chains; one large group of near copies."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    out = []
    for size in [*range(1, 14), 20, 31, 33, 60, 64, 65, 120, 300, 700]:
        base = rng.choices(vocabulary, k=size)
        out.append(base)
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at], "new"]])
            out.append(words)
        out += [base + rng.choices(vocabulary, k=max(1, size * k // 16)) for k in (1, 2, 3, 4, 5)]
    near = rng.choices(vocabulary, k=90)
    for _ in range(140):
        words = list(near)
        words[rng.randrange(90)] = rng.choice(vocabulary)
        out.append(words)
    out += [passage + rng.choices(vocabulary, k=50) for _ in range(60)]
    return [(i, " ".join(w).title() if i % 9 == 0 else " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("cell", [1024, 7])
def test_components_equal_brute_force(spark, cell, monkeypatch):
    if cell == 7:
        monkeypatch.setattr(jj, "BROADCAST", 0)
    rows = varied()
    got = jj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), cell=cell).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_similar_sets_share_a_key_and_sketches_bound_their_difference():
    rng = np.random.default_rng(7)
    bands = jj.Bands(4, 5)
    met = 0
    for _ in range(600):
        size = int(rng.integers(2, 400))
        both = rng.integers(0, 2**63, size).astype(np.uint64)
        own, theirs = (np.unique(np.concatenate([both, rng.integers(0, 2**63, int(rng.integers(0, size // 6 + 2))).astype(np.uint64)])) for _ in range(2))
        differ = len(np.setxor1d(own, theirs))
        assert jj.differing(jj.short_sketch(own), jj.short_sketch(theirs)) <= differ
        union = len(np.union1d(own, theirs))
        if differ and 5 * (union - differ) >= 4 * union:
            keys = [{int(k) for band, most in bands.of(len(s)) for k in bands.keys(s, band, most)} for s in (own, theirs)]
            assert keys[0] & keys[1]
            met += 1
    assert met > 150


def test_unlike_sets_of_one_size_hardly_ever_share_a_key():
    rng = np.random.default_rng(9)
    bands, seen, shared = jj.Bands(4, 5), set(), 0
    for _ in range(300):
        h = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        keys = {int(k) for band, most in bands.of(len(h)) for k in bands.keys(h, band, most)}
        shared += len(keys & seen)
        seen |= keys
    assert shared < 60  # of 45,000 pairs


def test_nulls_blanks_repeated_rows_and_clashing_names(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = jj.similar_documents(docs).collect()
    assert len(got) == len(rows)
    want = {i: (n, c) for i, n, c in brute([(r.doc_id, r.text) for r in rows if r.doc_id is not None])}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    assert jj.similar_documents(clashing(spark)).count() == clashing(spark).count()
    assert jj.similar_documents(empty(spark)).count() == 0


def test_a_large_group_of_copies_is_one_set(spark):
    rows = [(i, "the same words in every copy of this text") for i in range(400)] + [(1000 + i, f"some other text number {i}") for i in range(9)]
    got = jj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert got.filter("component_id = 0").count() == 400 and got.select("component_id").distinct().count() == 10
