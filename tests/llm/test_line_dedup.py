import hashlib
from collections import Counter

import pytest

from corpusloom.llm.line_dedup import LineRuns, dedup_lines
from tests.llm.fixtures import CLASHES, clashing, documents, empty

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("batches", [1, 5])
def test_equals_brute_force(spark, limit, batches):
    docs = documents(spark)
    rows = docs.collect()
    held = Counter(k for r in rows for k in {key(x) for x in (r.text or "").split("\n")} if k)
    want = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if held[key(x)] < 10 or not key(x)]
        want.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept).encode()))
    got = dedup_lines(docs, batches=batches, broadcast_keys=limit)
    assert got.columns[: len(docs.columns)] == docs.columns
    found = [(r.doc_id, r._n_lines, r._n_dropped, bytes(r._kept)) for r in got.collect()]
    order = lambda x: (str(x[0]), hashlib.md5(x[3]).hexdigest())
    assert sorted(found, key=order) == sorted(want, key=order)
    assert any(w[2] for w in want)


def test_empty_table(spark):
    assert dedup_lines(empty(spark)).count() == 0


def test_runs_are_compacted_and_keep_their_counts(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(bytearray(b"Same\nown %d" % i),)], "text binary"))
    assert sum(len(level) for level in runs.levels) <= 3 and len(runs.levels) == 3
    assert runs.common().count() == 1
    total = {r.n for r in runs.merged().collect()}
    assert max(total) >= 3 and min(total) == 1


@pytest.mark.parametrize("limit", [1000, 0])
def test_names_do_not_clash(spark, limit):
    docs = clashing(spark)
    got = dedup_lines(docs, broadcast_keys=limit)
    assert set(CLASHES) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert all(r["a.b"] == 7 and r._bytes == 7 and r._common == 7 for r in got.collect())
    assert got.agg({"_n_dropped": "max"}).first()[0] > 0
