import random
from collections import Counter

import numpy as np

from corpusloom.llm import suffix_dedup
from corpusloom.llm.suffix_dedup import COVER, LENGTH, PERIOD, SHARED, WORD_COVER, WORD_PERIOD, remove_repeats
from tests.llm.fixtures import CLASHES, clashing, documents, empty, words


def brute(rows):
    count = Counter(t[i : i + LENGTH] for _, t in rows for i in range(len(t) - LENGTH + 1))
    out = []
    for doc_id, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - LENGTH + 1):
            if count[t[i : i + LENGTH]] > 1:
                gone[i] += 1
                gone[i + LENGTH] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


def shared_words(rows):
    held = [t.lower().split() for _, t in rows]
    runs = [{tuple(w[i : i + SHARED]) for i in range(len(w) - SHARED + 1)} for w in held]
    count = Counter(r for own in runs for r in own)
    out = []
    for (doc_id, _), w in zip(rows, held, strict=True):
        inside = {p for i in range(len(w) - SHARED + 1) if count[tuple(w[i : i + SHARED])] > 1 for p in range(i, i + SHARED)}
        out.append((doc_id, len(inside)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, monkeypatch):
    extra = words(random.Random(9), 54)  # a shared passage below LENGTH bytes, with other blanks and capitals
    more = [(900, f"start {extra} end"), (901, extra.upper().replace(" ", " \n")), (902, f"{extra[:150]} {extra}")]
    docs = documents(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want, shared = brute(rows), shared_words(rows)
    assert any(0 < n for _, n in shared)
    for block, sample, suffix, span in ((4_000_000, 16_000_000, 2_000_000, 1 << 19), (9_000, 20_000, 7_000, 2_000)):
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
        monkeypatch.setattr(suffix_dedup, "SAMPLE_BUCKET_BYTES", sample)
        monkeypatch.setattr(suffix_dedup, "SUFFIX_BUCKET_BYTES", suffix)
        got = remove_repeats(docs)
        found = [(r.doc_id, r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept)) for r in got.collect()]
        assert sorted(found, key=str) == want
        assert sorted([(r.doc_id, r._n_shared) for r in got.select("doc_id", "_n_shared").collect()], key=str) == shared
    assert any(0 < w[2] < w[1] for w in want)


def test_the_cover_holds_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    assert {(a - b) % WORD_PERIOD for a in WORD_COVER for b in WORD_COVER} == set(range(WORD_PERIOD))


def test_empty_table(spark):
    assert remove_repeats(empty(spark)).count() == 0


def test_names_do_not_clash(spark):
    docs = clashing(spark)
    got = remove_repeats(docs)
    assert sorted(set(CLASHES) & set(got.columns)) == sorted(CLASHES) and len(set(got.columns)) == len(got.columns)
    assert got.select("doc_id", "_n_removed").count() == docs.count()
    assert all(r["a.b"] == 7 and r.digest == 7 for r in got.collect())
