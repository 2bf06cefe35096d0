from collections import defaultdict
from math import ceil

import numpy as np
import pytest

from corpusloom.llm.mixing import GOLDEN, mix, schedule, source_targets
from tests.llm.fixtures import documents, empty


def levels(sizes, weights, total, caps):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    rest = total
    while open_:
        w = sum(weights[s] for s in open_)
        full = [s for s in open_ if rest * weights[s] / w > caps[s]]
        if not full:
            for s in open_:
                target[s] = rest * weights[s] / w
            break
        for s in full:
            target[s] = caps[s]
            rest -= caps[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 3, None: 50}, {"é": 7}, {"a": 5, "b": 900, "c": 20, "d": 0, "e": 33}])
def test_targets_equal_the_repeated_resharing(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = levels(sizes, weights, 1.5 * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()})
    got = {r.source: r.target for r in source_targets(frame).collect()}
    assert got == pytest.approx(want)


def test_schedule_gives_blocks_in_the_order_of_the_points(spark):
    takes = {1: 10_000, 2: 3_001, 3: 17, 4: 0}
    frame = spark.createDataFrame(list(takes.items()), "source_no int, take long")
    rows = sorted(schedule(frame, 100).collect(), key=lambda r: r.slot)
    by = defaultdict(list)
    for r in rows:
        by[r.source_no].append(r)
    for s, n in takes.items():
        assert sum(r.words for r in by[s]) == n
        assert [r.rank for r in by[s]] == list(range(ceil(n / 100)))
    total = sum(takes.values())
    for r in rows[:100]:
        x = (r.slot * GOLDEN) % 1 * total
        assert r.source_no == (1 if x < 10_000 else 2 if x < 13_001 else 3)
    seen = np.cumsum([r.source_no == 1 for r in rows[:130]])
    assert np.all(np.abs(seen - np.arange(1, 131) * 10_000 / total) < 4)


@pytest.mark.parametrize("block", [1024, 7])
def test_taken_words_meet_the_targets(spark, block):
    docs = documents(spark)
    got = mix(docs, block_words=block).collect()
    assert len(got) == docs.count()
    words = {r.doc_id: len((r.text or "").split(None)) if r.text else 0 for r in docs.collect()}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        assert r.doc_id is None or r.size == len([w for w in (docs_text(docs, r.doc_id) or "").split() if w])
    for r in got:
        assert abs(taken[r.source] - r.target) <= 1
    again = mix(docs, block_words=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert words


_TEXT = {}


def docs_text(docs, doc_id):
    if not _TEXT:
        _TEXT.update({r.doc_id: r.text for r in docs.collect()})
    return _TEXT[doc_id]


def test_taken_equals_the_stream_laid_out_by_hand(spark):
    """Every document's words taken are those of its places in the source's stream below the target."""
    docs = documents(spark)
    rows = mix(docs, block_words=10).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        # one pass is whole or not at all for all but one document of a source
        target, size = round(own[0].target), own[0].source_size
        part = [r for r in own if r.size and r.taken not in {(target // size) * r.size, (target // size + 1) * r.size}]
        assert len(part) <= 1


def test_empty_table(spark):
    assert mix(empty(spark)).count() == 0
