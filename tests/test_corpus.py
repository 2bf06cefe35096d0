"""Literal cases of the source, tracking, chunking and dedup operators."""

import hashlib
import random
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as K
from corpusloom.operators import dedup as D
from corpusloom.operators import tracking as T
from corpusloom.plans.ingest import ingest
from corpusloom.sources import corpus as C
from corpusloom.sources import store as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_read_corpus_takes_its_extensions_and_leaves_folders_out(spark, tmp_path):
    for name, text in (("a.md", "# A"), ("sub/b.TXT", "béta"), ("node_modules/c.md", "no"), ("d.py", "no"), ("big.txt", "x" * 100)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.relative_path: r for r in C.read_corpus(spark, str(tmp_path), "t", max_bytes=50).collect()}
    assert set(got) == {"a.md", "sub/b.TXT"}
    assert got["a.md"].file_type == "markdown" and got["sub/b.TXT"].text == "béta"
    assert got["a.md"].content_hash == hashlib.sha256(b"# A").hexdigest()


def test_malformed_telemetry_lines_are_skipped(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"id":1,"ts":"2024-01-01T00:00:00Z"}\nnot json\n{"id":2,"ts":"2024-01-02T00:00:00Z"}\n')
    rows = C.read_telemetry(spark, str(tmp_path), "id long, ts timestamp", 1).collect()
    assert [r.id for r in rows] == [2]


def test_partition_health_names_the_missing_month(spark):
    logs = spark.sql("select timestamp'2024-03-31 10:00:00' ts, '2024-03' month union all select timestamp'2024-01-02', '2024-02'")
    got = {(r.month, r.issue) for r in S.partition_health(logs, "2024-03-31 00:00:00").collect()}
    assert got == {("2024-01", "gap"), ("2024-04", "missing next"), ("2024-02", "outside range")}
    kept = S.drop_partitions(logs.withColumn("month", F.lit("2023-03")), "2024-03-31 00:00:00").count()
    assert kept == 2 and S.drop_partitions(logs.withColumn("month", F.lit("2023-02")), "2024-03-31 00:00:00").count() == 0


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, v int")
    once = S.upsert_chunks(old, new)
    assert sorted(once.collect()) == sorted(S.upsert_chunks(once, new).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    left, gone = S.delete_chunks(once, once.filter("v > 3").select("chunk_id"))
    assert left.count() == 2 and gone.first().deleted == 1


def test_change_set(spark):
    now = spark.createDataFrame([("n", "1"), ("c", "2"), ("u", "3")], "file_path string, content_hash string")
    then = spark.createDataFrame([("c", "0", "t"), ("u", "3", "t"), ("d", "4", "t"), ("o", "5", "other")], "file_path string, content_hash string, source_type string")
    got = {r.file_path: r.state for r in T.detect_changes(now, then, "t").collect()}
    assert got == {"n": "new", "c": "changed", "u": "unchanged", "d": "deleted"}
    assert T.detect_changes(now, then).filter("file_path = 'o'").first().state == "deleted"


def test_ids_are_those_of_python(spark):
    for source, i, text in (("a/b.md", 0, "héllo"), ("x", 17, "")):
        name = f"{source}:{i}:{hashlib.md5(text.encode()).hexdigest()[:16]}"
        row = spark.createDataFrame([(source, i, text)], "s string, i int, t string")
        assert row.select(T.chunk_id(F.col("s"), F.col("i"), F.col("t")).alias("y")).first().y == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_freshness_bounds(spark):
    days = [7, 8, 30, 31, 90, 91, None]
    rows = spark.createDataFrame([("kubernetes", d) for d in days], "source_type string, d int").withColumn("last_commit", F.expr("timestamp'2024-06-01' - make_interval(0, 0, 0, d)"))
    got = {r.d: (r.risk, r.days) for r in T.freshness(rows, "2024-06-01 00:00:00").collect()}
    assert [got[d][0] for d in days] == ["fresh", "low", "low", "medium", "medium", "high", "unknown"]
    assert got[None][1] == -1


def test_content_types(spark):
    def kind(text):
        return one(spark, K.content_type(F.col("x")), text)

    assert kind("```\na\nb\n```\nz") == "code"
    assert kind("```\na\n```\nx\ny\nz") == "mixed"
    assert kind("|a|b|\n|c|d|\nx") == "table"
    assert kind("- a\n2. b\nc") == "list"
    assert kind("words") == "prose" and kind(" \n ") == "prose"


def test_sections_ignore_headers_in_fences_and_carry_headings(spark):
    text = "intro\n# A\na\n```\n# not\n```\n## B\nb\n### C\nc\n# D\nd"
    got = one(spark, K.sections(F.col("x")), text)
    assert [(s.h1, s.h2, s.h3) for s in got] == [(None, None, None), ("A", None, None), ("A", "B", None), ("A", "B", "C"), ("D", None, None)]
    assert "# not" in got[1].text and "\n".join(s.text for s in got) == text


def test_code_blocks_have_places(spark):
    text = "a ```py\nx\n``` é ```\ny```"
    got = one(spark, K.code_blocks(F.col("x")), text)
    want = [(m[2], m[1] or "unknown", m.start(), m.end()) for m in re.finditer(r"(?s)```(\w*)\n(.*?)```", text)]
    assert [tuple(b) for b in got] == want


def test_chunks_respect_size_and_lose_no_text():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(5, 80))) for _ in range(30))
    for size, overlap in ((200, 40), (1000, 200)):
        chunks = K.split_text(text, size, overlap, K.LEGACY[2])
        assert max(map(len, chunks)) <= size
        at = 0
        for c in chunks:  # each starts in what is left over or overlaps
            found = text.find(c, max(0, at - overlap - 4))
            assert 0 <= found <= at + 2
            at = found + len(c)
        assert at == len(text)
    assert K.split_text("x" * 450, 200, 0, K.LEGACY[2]) == ["x" * 200, "x" * 200, "x" * 50]


def test_long_code_is_cut_and_fenced_again():
    body = "\n".join(f"line {i:04d} " + "y" * 40 for i in range(100))
    parts = K.split_code(f"before\n```py\n{body}\n```\nafter")
    assert parts[0] == "before" and parts[-1] == "after" and len(parts) > 4
    assert all(p.startswith("```py\n") and p.endswith("\n```") for p in parts[1:-1])
    assert [x for p in parts[1:-1] for x in p.split("\n")[1:-1] if x] == body.split("\n")


def test_empty_document_is_one_chunk(spark):
    docs = spark.createDataFrame([("a", ""), ("b", None), ("c", "# T\nx")], "source string, text string")
    got = {r.source: r for r in K.chunk_documents(docs).collect()}
    assert len(got) == 3 and got["a"].content_type == "prose" and got["a"].text == ""
    assert got["c"].heading_path == "T"


def test_normal_form_is_that_of_python(spark):
    for text in ("ﬁ Ａ B\n\tc ", "É É", "", "plain  Text"):
        want = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower()).strip()
        assert one(spark, D.normalize_text(F.col("x")), text) == want


def test_exact_dedup_keeps_first_or_last(spark):
    rows = spark.createDataFrame([(1, "A"), (2, " a "), (3, "b")], "i int, text string")
    assert sorted(r.i for r in D.dedup_exact(rows, "i").collect()) == [1, 3]
    assert sorted(r.i for r in D.dedup_exact(rows, "i", keep="last").collect()) == [2, 3]


def test_simhash_of_nothing_is_zero_and_bit_63_survives(spark):
    assert one(spark, D.simhash64(F.col("x")), "") == 0
    high = next(w for w in ("w%d" % i for i in range(99)) if int(hashlib.md5(w.encode()).hexdigest(), 16) >> 63 & 1)
    assert one(spark, D.simhash64(F.col("x")), high) % (1 << 64) == int(hashlib.md5(high.encode()).hexdigest(), 16) % (1 << 64)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_fuzzy_drop_equals_the_scan(spark, keep):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(60)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)), "i int, simhash long")
    pairs = D.near_pairs(rows, "i")
    close = [[(a ^ b).bit_count() <= 3 for b in values] for a in values]
    assert {(r.earlier, r.later) for r in pairs.collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if close[i][j]}
    fallen = set()
    for i in range(60):
        if i in fallen:
            continue
        for j in range(i + 1, 60):
            if j not in fallen and close[i][j]:
                if keep == "first":
                    fallen.add(j)
                else:
                    fallen.add(i)
    assert {r.r for r in D.fuzzy_dropped(pairs, keep).collect()} == fallen


def test_ingest_again_changes_nothing_and_a_change_replaces(spark):
    def files(rows):
        return spark.createDataFrame([(p, hashlib.md5(t.encode()).hexdigest(), "t", len(t), t) for p, t in rows], "file_path string, content_hash string, source_type string, file_size long, text string")

    registry = spark.createDataFrame([], "file_path string, content_hash string, source_type string, chunk_count long, file_size long, ingested_at timestamp, updated_at timestamp")
    store = spark.createDataFrame([], "chunk_id string, source string, source_type string, content_type string, heading_path string, text string")
    first = files([("a", "# A\nalpha"), ("b", "# B\nbeta\n# C\ngamma")])
    one_ = ingest(first, registry, store, "2024-01-01 00:00:00")
    assert one_.summary.first().new == 2 and one_.store.count() == 3
    two = ingest(first, one_.registry, one_.store, "2024-01-02 00:00:00")
    assert two.summary.first().to_process == 0
    assert sorted(two.store.collect()) == sorted(one_.store.collect())
    three = ingest(files([("b", "# B\nbeta!")]), one_.registry, one_.store, "2024-01-03 00:00:00")
    assert [(r.source, r.text) for r in three.store.collect()] == [("b", "# B\nbeta!")]
    kept = three.registry.collect()
    assert [(r.file_path, str(r.ingested_at), str(r.updated_at)) for r in kept] == [("b", "2024-01-01 00:00:00", "2024-01-03 00:00:00")]
    dry = ingest(files([("b", "x")]), one_.registry, one_.store, "2024-01-03 00:00:00", dry_run=True)
    assert dry.store.count() == 3 and dry.summary.first().deleted == 1
