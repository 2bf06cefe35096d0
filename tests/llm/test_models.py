"""Held-out accuracy and arithmetic of the trained operators, on small tables."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import class_lm, langid, quality
from tests.llm.fixtures import clashing, documents, empty

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def crc(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


# language model


def test_language_model_counts_and_base_scores(spark, monkeypatch):
    docs = documents(spark)
    rows = docs.collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*low(r.text).encode().split(), None] for r in rows]
    count = Counter(w for r, t in zip(rows, tokens, strict=True) if crc(r.doc_id, 5) != 1 for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(r.doc_id), crc(r.doc_id, 5) == 1, len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5))
        for r, t in zip(rows, tokens, strict=True)
    )
    for block, bucket in ((16_000_000, 32_000_000), (5_000, 20_000)):
        monkeypatch.setattr(class_lm, "BLOCK_BYTES", block)
        monkeypatch.setattr(class_lm, "BUCKET_BYTES", bucket)
        got = class_lm.score_texts(docs, quality.held_out("doc_id", 5, 1)).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
        assert all(r.train_tokens == n and r.score < 0 for r in got)
    none = class_lm.score_texts(docs, F.lit(True)).collect()
    assert len(none) == len(rows) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in none)
    assert class_lm.score_texts(empty(spark), quality.held_out("doc_id", 5, 1)).count() == 0


def test_scores_are_probabilities_and_equal_brute_force(spark, monkeypatch):
    """After every class the probabilities of all known words, the end and the unknown word sum to 1; scores are their
    products, counted by hand from the classes."""
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(class_lm, "SEEDS", 8)  # the rest gets classes by the sweeps alone
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    train = [(i, " ".join(rng.choice(words[(i % 2) * 20 :][:20]) for _ in range(30))) for i in range(60)]
    probe = [(1000, "w1 unseen w2 w2"), (1001, ""), (1002, None), (1003, "unseen other"), (1004, "w39")]
    docs = spark.createDataFrame(train + probe, "doc_id long, text string")
    held = F.col("doc_id") >= 1000
    coded = class_lm.coded_blocks(docs, held, "doc_id", "text", 4000)
    told, m = class_lm.classes_of(coded, 3)
    of = {class_lm.END_KEY: class_lm.END}
    for row in coded.collect():
        c = class_lm.Coded(row.payload)
        n, cls = class_lm._told(c, told.filter((F.col("class") < 0) & (F.col("block") == row.block)).select("bucket", "packed").toArrow(), 3)
        of |= dict(zip(c.keys.tolist(), np.where(n > 0, cls, class_lm.OTHER).tolist(), strict=True))
    kind = lambda w: of.get(class_lm.xxhash.xxh64_intdigest(w) if w else 0, class_lm.OTHER)
    tokens = {i: [*(t or "").lower().encode().split(), b""] for i, t in train + probe}
    count = Counter(w for i, _ in train for w in tokens[i])
    steps = Counter((kind(a), kind(b)) for i, _ in train for a, b in zip([b"", *tokens[i]], tokens[i], strict=False))
    assert {(int(a), int(b)): int(m[a, b]) for a, b in zip(*np.nonzero(m), strict=True)} == dict(steps)
    assert all(kind(w) < class_lm.CLASSES for w in count if w)
    total, once = sum(count.values()), sum(n == 1 for n in count.values())
    size, kinds = Counter(), Counter(map(kind, count))
    for w, n in count.items():
        size[kind(w)] += n
    unknown = (once + 0.5) / (total + 1)

    def p(before, w):
        if w not in count:
            return unknown
        b = kind(w)
        row = sum(n for (x, _), n in steps.items() if x == before)
        step = (steps[before, b] + class_lm.PULL * size[b] / total) / (row + class_lm.PULL)
        return (1 - unknown) * step * (count[w] + 0.5) / (size[b] + 0.5 * kinds[b])

    for before in range(class_lm.K):
        assert sum(p(before, w) for w in count) + unknown == pytest.approx(1, abs=1e-9)
    want = {i: sum(math.log10(p(kind(a), b)) for a, b in zip([b"", *t], t, strict=False)) for i, t in tokens.items()}
    got = {r.doc_id: r.score for r in class_lm.score_texts(docs, held).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_gains_equal_the_difference_of_likelihoods():
    rng = np.random.default_rng(5)
    b, of = rng.poisson(1.0, (9, 9)).astype(float), np.array([0, 1, 2, 0, 1, 2, 0, 3, 4])

    def whole(classes):
        member = np.zeros((9, 5))
        member[np.arange(9), classes] = 1
        return member.T @ b @ member

    for w in range(7):
        member = np.zeros((9, 5))
        member[np.arange(9), of] = 1
        member[w] = 0
        gain = class_lm.gains(whole(of), (b[w] @ member)[None], (b[:, w] @ member)[None], np.array([b[w, w]]), of[w : w + 1])[0]
        for c in range(3):
            moved = np.where(np.arange(9) == w, c, of)
            assert gain[c] - gain[of[w]] == pytest.approx(class_lm.likelihood(whole(moved)) - class_lm.likelihood(whole(of)), abs=1e-6)


def test_exchange_raises_the_likelihood_and_finds_groups():
    rng = np.random.default_rng(3)
    n = 40
    b = rng.poisson(0.2, (n + 2, n + 2)).astype(float)
    for g in range(2):  # two groups that follow themselves
        own = np.arange(n) % 2 == g
        b[:n, :n][np.ix_(own, own)] += rng.poisson(6, (own.sum(), own.sum()))
    of, m = class_lm.exchange(b, classes=2, sweeps=20)
    assert len(set(of[::2])) == 1 and len(set(of[1::2])) == 1 and of[0] != of[1]
    member = np.zeros((n + 2, 4))
    member[np.arange(n + 2), [*of, 2, 3]] = 1
    assert np.allclose(m, member.T @ b @ member)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_perplexity_is_below_that_of_single_words(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = class_lm.score_texts(docs, quality.held_out("doc_id", 5, 1)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# quality


def labelled(n=240):
    rng = random.Random(4)
    good = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 200))), 1) for i in range(n)]
    bad = [(n + i, " ".join("".join(rng.choice("ABCDEFGHIJ") for _ in range(rng.randint(2, 9))) + "!!" for _ in range(rng.randint(5, 200))), 0) for i in range(n)]
    return good + bad


def test_quality_learns_and_scores_every_text(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels)
    truth = {i: y for i, _, y in rows}
    held = [r for r in quality.score(docs, net).collect() if crc(r.doc_id, 5) == 0]
    assert len(held) > 50 and np.mean([(r._score >= 0.3) == truth[r.doc_id] for r in held]) > 0.95
    odd = quality.score(documents(spark), net).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r._score <= 1 for r in odd)
    assert quality.score(empty(spark), net).count() == 0


def test_quality_without_both_labels_is_a_constant(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert quality.train(docs, only) == 1.0
    assert quality.train(docs, only.filter("false")) == 0.5
    assert {r._score for r in quality.score(docs, 0.5).collect()} == {0.5}


def test_overlapping_chunks_cover_the_whole_text():
    net = quality.new_network(np.random.default_rng(1))
    raw = np.random.default_rng(2).integers(1, 255, 5000).astype(np.uint8)
    base = quality.chunk_logits(net, raw)
    for at in (0, 127, 2500, 4872):
        changed = raw.copy()
        changed[at : at + 128] = 0
        assert not np.array_equal(quality.chunk_logits(net, changed), base)
    whole = np.ascontiguousarray(quality.columns(raw[:256], net.embed)) @ net.filters
    padded = np.concatenate([raw[:256], raw[256:262]])
    exact = (np.ascontiguousarray(quality.columns(padded, net.embed)) @ net.filters).max(axis=0)
    pooled = np.maximum(exact + net.bias, 0)
    first = np.maximum(pooled @ net.w1 + net.b1, 0) @ net.w2 + net.b2[0]
    assert base[0] == pytest.approx(float(first), abs=1e-4) and whole.shape[0] == 125


# language


def test_language_is_learned_and_calibrated(spark):
    rng = random.Random(6)
    kinds = {"en": "the of and ing ther".split(), "de": "der und sch ung ein".split(), "fr": "le la eau que ment".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) + rng.choice(kinds[k]) for _ in range(rng.randint(4, 40))), k) for i, k in enumerate(list(kinds) * 80)]
    rows += [(10_000, None, "en"), (10_001, "1234 !!", "en"), (10_002, "the of the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, langid.taught_by_id())
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[10_000]._lang_pred == got[10_001]._lang_pred == "und" and got[10_000]._lang_score == 0
    assert got[10_002]._lang_pred == "en"
    held = [(got[i], k) for i, _, k in rows[:240] if crc(i, 3) == 1]
    assert np.mean([r._lang_pred == k for r, k in held]) > 0.95
    assert all(0 <= r._lang_score <= 1 for r in got.values())
    assert (model.table == 0).mean() > 0.5  # sparse
    assert len(langid.identify(documents(spark), model).collect()) == documents(spark).count()
    assert langid.identify(empty(spark), model).count() == 0
    odd = clashing(spark).select("*", F.lit(7).alias("_lang_pred"), F.lit(7).alias("_whole"), F.struct(F.lit(1).alias("x y")).alias("s t"))
    out = langid.identify(odd, model)
    assert sorted(out.columns) == sorted([*odd.columns, "_lang_score"])
    assert out.filter("`a.b` = 7 and `s t`.`x y` = 1 and _whole = 7 and length(_lang_pred) > 1").count() == odd.count()
    nothing = langid.train(docs, F.lit(False))
    assert {r._lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_long_texts_are_read_in_parts_with_no_place_lost(monkeypatch):
    points = langid.code_points("abc défg " * 50)[0]
    whole = Counter(int(x) for f in langid.features(points) for x in f)
    monkeypatch.setattr(langid, "SPAN", 37)
    parts = Counter(int(x) for f in langid.features(points) for x in f)
    assert parts == whole
