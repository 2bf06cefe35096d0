import re

import pytest

from corpusloom.llm.decontaminate import find_contamination, winnow
from tests.llm.fixtures import CLASHES, clashing, documents, empty, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def items(spark):
    long = texts()[7].split(" ")
    rows = [("a", " ".join(long[100:140])), ("b", " ".join(long[120:133])), ("c", "Two, WORDS"), ("d", None), ("e", "..."), ("f", "one"), (None, "漢字")]
    return spark.createDataFrame(rows, "item_id string, text string")


def brute(docs, tests):
    out = []
    windows = [(i or "null", tokens(t)) for i, t in tests]
    for doc_id, text in docs:
        w, hit, found = tokens(text), set(), set()
        for item, ws in windows:
            n = min(len(ws), 13)
            if not n:
                continue
            keys = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in keys:
                    hit |= set(range(p, p + n))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equals_brute_force(spark, limit):
    docs, tests = documents(spark), items(spark)
    got = find_contamination(docs, tests, broadcast_bytes=limit)
    found = sorted(((r.doc_id, r._n_words, r._n_hit, list(r._items)) for r in got.collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in tests.collect()])
    assert found == want
    assert any({"a", "b"} <= set(w[3]) for w in want) and any("c" in w[3] for w in want) and any("null" in w[3] for w in want)


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_empty_tables(spark, limit):
    none = items(spark).filter("false")
    assert find_contamination(empty(spark), items(spark), broadcast_bytes=limit).count() == 0
    got = find_contamination(documents(spark), none, broadcast_bytes=limit).collect()
    assert got and all(r._n_hit == 0 and list(r._items) == [] for r in got)


def test_winnowing_keeps_a_minimum_of_every_window():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, w in ((1, 4), (9, 9), (200, 9), (200, 1)):
        v = rng.integers(0, 30, n)
        picked = set(winnow(v, w).tolist())
        for i in range(max(1, n - w + 1)):
            window = range(i, min(n, i + w))
            least = min(v[j] for j in window)
            assert any(j in picked and v[j] == least for j in window)


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_names_do_not_clash(spark, limit):
    docs = clashing(spark)
    items = spark.createDataFrame([(1, docs.filter("doc_id = 7").first().text[:400])], "`item.id` long, `a.text` string")
    got = find_contamination(docs, items, item_id="item.id", item_text="a.text", broadcast_bytes=limit)
    assert set(CLASHES) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert all(r["a.b"] == 7 and r._bytes == 7 and r._h == 7 for r in got.collect())
    assert got.filter("doc_id = 7").first()._items == ["1"]
