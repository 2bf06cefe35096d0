"""Streams in several batches, and the snapshots that they commit."""

import datetime
import math
import os
import random
import statistics
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup as D
from corpusloom.operators.telemetry import query_hash
from corpusloom.plans import streaming_queries
from corpusloom.plans.ingest import ingest
from corpusloom.sources.store import Snapshots, chunk_store, file_registry
from corpusloom.streaming import streams as T

AT = "2024-01-02 00:00:00"
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_the_last_of_equally_dated_snapshots_is_current(spark, tmp_path):
    held = Snapshots(spark, str(tmp_path / "held"))
    for i in range(8):
        held.commit(spark.range(i, i + 1), AT)
        assert [r.id for r in held.current().collect()] == [i]


def test_numbered_pointers_come_after_those_without_a_number(spark, tmp_path):
    held = Snapshots(spark, str(tmp_path / "held"))
    spark.range(1).write.parquet(f"{held.path}/old")
    spark.sql("SELECT 'old' AS name, TIMESTAMP '2024-05-01 00:00:00' AS ts").write.parquet(f"{held.path}/_pointers/log")
    assert held.current().count() == 1
    held.commit(spark.range(5), AT)
    assert held.current().count() == 5


def test_a_stream_of_several_batches_keeps_them_all(spark, tmp_path):
    schema = "file_path string, content_hash string, source_type string, file_size long, text string"
    rows = [(f"f{i}", f"h{i}", "t", 9, f"# Title {i}\nwords of file {i}") for i in range(5)]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "arriving"))
    store, registry = chunk_store(spark, str(tmp_path / "store")), file_registry(spark, str(tmp_path / "registry"))
    stream = T.read_table(spark, str(tmp_path / "arriving"), schema, 1)
    query = T.ingest_stream(stream, store, registry, str(tmp_path / "checkpoint"), AT)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    assert sorted(r.file_path for r in registry.current().collect()) == [r[0] for r in rows]
    assert sorted((r.source, r.text.split()[-1]) for r in store.current().collect()) == [(f"f{i}", str(i)) for i in range(5)]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_registered_ingestion_takes_every_document(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.source_type: r for r in streaming_queries.t08_ingest_stream_chunks(spark, SF_DIR).collect()}
    assert {s: r.files for s, r in got.items()} == {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    store = spark.createDataFrame([], "chunk_id string, source string, source_type string, content_type string, heading_path string, text string")
    registry = spark.createDataFrame([], "file_path string, content_hash string, source_type string, chunk_count long, file_size long, ingested_at timestamp, updated_at timestamp")
    files = docs.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.md5("text").alias("content_hash"), F.col("source").alias("source_type"), F.col("n_chars").alias("file_size"), "text")
    want, changed = {}, F.col("doc_id") % 10 == 0
    for i in range(streaming_queries.ARRIVALS):
        part = ingest(files.filter((F.col("doc_id") % streaming_queries.ARRIVALS == i) & ~changed).drop("doc_id"), registry, store, AT)
        whole = ingest(files.filter(F.col("doc_id") % streaming_queries.ARRIVALS == i).drop("doc_id"), registry, store, AT)
        # a chunk that a changed file had first is not given to a file that had it too: dedup is per batch
        assert part.chunks.count() <= whole.chunks.count()
        for r in whole.chunks.join(files.filter(~changed).select(F.col("file_path").alias("source")), "source", "left_semi").groupBy("source_type").count().collect():
            want[r.source_type] = want.get(r.source_type, 0) + r["count"]
    again = files.filter(changed).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nA closing line of its own."))).drop("doc_id")
    for r in ingest(again, registry, store, AT).chunks.groupBy("source_type").count().collect():
        want[r.source_type] = want.get(r.source_type, 0) + r["count"]
    assert {s: r.chunks for s, r in got.items()} == want
    assert {s: r.registered_chunks for s, r in got.items()} == want


def loop(rows, window, distance):
    """What a scan of all rows in order finds: exact copies by their text, then near ones among the last rows kept."""
    seen, kept, found = set(), [], {}
    for i, text, h in rows:
        if text in seen:
            continue
        seen.add(text)
        found[i] = any((h ^ k).bit_count() <= distance for k in kept)
        if not found[i]:
            kept = [*kept, h][-window:]
    return found


@pytest.mark.parametrize("window", [5, 1000])
def test_near_copies_equal_the_scan_in_order(spark, tmp_path, window):
    """Over several batches, with exact copies, near copies that come back after the window has passed, and blanks."""
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    bases = [rng.choices(vocabulary, k=250) for _ in range(9)]
    texts = []
    for _ in range(160):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 60])):
            words[rng.randrange(250)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["", "", None, "Ünï  CODE", "ünï code"]
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day, t) for i, t in enumerate(texts)]
    at, check = str(tmp_path / "in"), str(tmp_path / "check")
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], "row_id long, ts timestamp, text string").coalesce(1).write.mode("append").parquet(at)
        T.dedup_fuzzy_stream(T.read_table(spark, at, "row_id long, ts timestamp, text string"), str(tmp_path / f"out{i}"), check, window=window).awaitTermination()
    got = {r.row_id: r.similar for i in range(0, len(rows), 40) for r in spark.read.parquet(str(tmp_path / f"out{i}")).collect()}
    hashed = spark.createDataFrame(rows, "row_id long, ts timestamp, text string").select("row_id", D.normalize_text(F.col("text")).alias("t"), D.simhash64(F.col("text")).alias("h")).orderBy("row_id").collect()
    assert got == loop([(r.row_id, r.t, r.h % 2**64) for r in hashed], window, 3)
    assert sum(got.values()) > 20


def test_lanes_have_windows_of_their_own_and_are_forgotten(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(300))
    day = lambda i: datetime.datetime(2024, 1, 1 + i)
    at, check = str(tmp_path / "in"), str(tmp_path / "check")
    arrivals = [[(0, day(0), words, "a"), (1, day(0), words + " more", "b"), (2, day(0), words + " yet", "a")], [(3, day(9), "nothing like it", "c")], [(4, day(9), words + " again", "a")]]
    kind = "row_id long, ts timestamp, text string, source string"
    found = {}
    for i, rows in enumerate(arrivals):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(at)
        T.dedup_fuzzy_stream(T.read_table(spark, at, kind), str(tmp_path / f"out{i}"), check, window=5, lane=F.col("source")).awaitTermination()
        found |= {r.row_id: r.similar for r in spark.read.parquet(str(tmp_path / f"out{i}")).collect()}
    assert found == {0: False, 1: False, 2: True, 3: False, 4: False}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_an_answer_expires_by_event_time_without_a_row_of_its_key(spark, tmp_path):
    at, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    arrivals = [
        [(1, "a", t(0), "first"), (2, "a", t(30), None), (3, "b", t(5), None), (4, None, t(5), "no key")],
        [(5, "a", t(50), "second"), (6, "a", t(109), None), (7, "c", t(60), "third")],
        [(8, "z", t(400), None)],
        [(9, "a", t(401), None)],
    ]
    kind = "event_id long, key string, ts timestamp, stored string"
    with T.rocksdb_state(spark):
        for rows in arrivals:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(at)
            T.write_table(T.answer_cache_stream(T.read_table(spark, at, kind), 3600), out, check).awaitTermination()
    got = sorted(((r.key, r.event_id or 0, r.outcome, r.answer) for r in spark.read.parquet(out).collect()), key=str)
    want = [("a", 2, "hit", "first"), ("b", 3, "miss", None), ("a", 6, "hit", "second"), ("a", 0, "expired", "second"), ("c", 0, "expired", "third"), ("z", 8, "miss", None), ("a", 9, "miss", None)]
    assert got == sorted(want, key=str)


def test_quartiles_of_counts_follow_the_index_rule(spark):
    rng = random.Random(3)
    rows = [(datetime.datetime(2024, 1, 1 + i % 3), rng.choice([0.0, 1.0, 0.25, 0.25001, rng.random()])) for i in range(900)] + [(datetime.datetime(2024, 2, 1), 0.5)] * 9
    counts = spark.createDataFrame(rows, "ts timestamp, score double").groupBy("ts", "score").agg(F.count(F.lit(1)).alias("c"))
    got = {r.ts: r for r in T.metrics_of_counts(counts).collect()}
    for ts in {t for t, _ in rows}:
        own = sorted(s for t, s in rows if t == ts)
        r = got[ts]
        assert r.n == len(own)
        if len(own) < 10:
            assert r.p50 is None and r.mean is None
        else:
            assert [r.p25, r.p50, r.p75, r.min, r.max] == [own[int(len(own) * p)] for p in (0.25, 0.5, 0.75)] + [own[0], own[-1]]
            assert abs(r.mean - statistics.fmean(own)) < 1e-12 and abs(r.std - statistics.stdev(own)) < 1e-12


def test_sketches_bound_the_exact_counts(spark):
    """Far more different queries than a sketch holds, in several windows."""
    rng = random.Random(6)
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(minutes=rng.randrange(600)), f"query {int(rng.random() ** 6 * 4000)}") for _ in range(12000)] + [(base, None)]
    requests = spark.createDataFrame(rows, "ts timestamp, query string").repartition(4)
    sketches = T.query_sketches(requests, "1 hour", 96)
    exact = {r.h: r.n for r in requests.groupBy(query_hash(F.col("query")).alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got = T.top_of_sketches(sketches, 1000, 96).collect()
    assert len(exact) > 1000 and len(got) > 2
    room = math.ceil(12000 * 3.5 / 128)
    for r in got:
        assert r.least <= exact[r.query_hash] <= r.n <= r.least + room
    found = {r.query_hash for r in got}
    assert all(n <= room for h, n in exact.items() if h not in found)
    assert T.top_of_sketches(sketches, 1, 96, ["start"]).count() == 10


def _answers(rows, ttl=60):
    """The rows that Answers returns for the events of one key."""
    held = types.SimpleNamespace(exists=lambda: False, get=lambda: None, update=lambda v: None)
    handle = types.SimpleNamespace(getValueState=lambda *a: held, listTimers=lambda: [], registerTimer=lambda t: None)
    own = T.Answers(ttl)
    own.init(handle)
    frame = pd.DataFrame([(pd.Timestamp(ts), i, stored) for ts, i, stored in rows], columns=["ts", "event_id", "stored"])
    return pd.concat(own.handleInputRows(("k",), iter([frame]), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))


def test_ids_next_to_expired_answers_stay_exact():
    far = (1 << 53) + 1
    got = _answers([("2024-01-01 00:00:00", 1, "a"), ("2024-01-01 00:02:00", 2, "b"), ("2024-01-01 00:02:01", far, None)])
    assert got["outcome"].tolist() == ["expired", "hit"] and int(got["event_id"].iloc[1]) == far
