import numpy as np
import pytest
import xxhash

from corpusloom.llm import near_dup
from corpusloom.llm.common import connected_components
from tests.llm.fixtures import clashing, documents, empty


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + 4] for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_equal_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    prints = [(r.doc_id, slow_print(r.text)) for r in rows]
    links = [(a, b) for a, x in prints for b, y in prints if a is not None and b is not None and (x ^ y).bit_count() <= 4]
    want = components({i for i, _ in prints if i is not None}, links)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r._fp % (1 << 64)) for r in got} == set(prints)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())


@pytest.mark.parametrize("posting", [8192, 40, 2])
def test_links_connect_the_same_pairs_as_brute_force(spark, posting):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    values = set(rng.integers(0, 2**63, 150).tolist())
    for b in base:  # dense groups
        for _ in range(60):
            v = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 7)):
                v ^= 1 << int(bit)
            values.add(v)
    fps = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in fps], "_fp long")
    found = near_dup.fingerprint_links(frame, posting)
    got = {r.node: r.component for r in connected_components(found).collect()}
    links = [(a, b) for a in fps for b in fps if ((a ^ b) % (1 << 64)).bit_count() <= 4]
    want = components(fps, links)
    assert {n: got.get(n, n) for n in fps} == want


def test_tally_counts_shared_positional_bytes():
    prints = np.array([0, 0x01, 0x0100_0000_0000_0001, 0xFFFF_FFFF_FFFF_FFFF], np.uint64)
    assert near_dup.tally(prints, np.uint64(0)).tolist() == [8, 7, 6, 0]
    assert len(near_dup.MASKS) == 70 + 70 * 70 and all(int(m).bit_count() in (32, 48) for m in near_dup.MASKS)


def test_hot_fingerprints_and_clashing_names(spark):
    docs = clashing(spark)
    copies = spark.createDataFrame([(5000 + i, "same words in every copy here") for i in range(300)], "doc_id long, text string")
    got = near_dup.near_duplicates(docs.unionByName(copies, allowMissingColumns=True))
    assert got.filter("component_id = 5000").count() == 300
    assert got.count() == docs.count() + 300


def test_empty_table(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_chain_and_of_no_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(7, 7), (None, 3)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(chain).collect()} == {(i, 0) for i in range(61)}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
