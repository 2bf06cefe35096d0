"""Stored tables: batches that write only themselves, and months that go without the others being read."""

import os

from pyspark.sql import functions as F

from corpusloom.sources import store as S
from corpusloom.streaming import streams as T

AT = "2024-01-02 00:00:00"
FILES = "file_path string, content_hash string, source_type string, file_size long, text string"


def sizes(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_size for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, path, buckets=8):
    return S.Batches(spark, str(path), "k string, v long", "k", buckets)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v long")


def held(t, **which):
    return sorted(((r.k, r.v) for r in t.current(**which).collect()), key=str)


def test_batches_replace_remove_and_run_again(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert held(t) == [] and t.compact() == 0
    t.write(0, rows(spark, ("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 9)))
    for _ in range(2):  # a batch that runs again changes nothing
        t.write(1, rows(spark, ("b", 30), ("d", 5)), spark.createDataFrame([("b",), ("c",), ("d",), ("e",)], "k string"))
        assert held(t) == [("a", 1), ("a", 2), ("b", 30), ("d", 5), (None, 9)]
    assert held(t, before=1) == [("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 9)]
    assert held(t, keys=spark.createDataFrame([("b",), ("c",)], "k string")) == [("b", 30)]
    t.write(2, rows(spark, ("c", 40)))
    assert ("c", 40) in [(r.k, r.v) for r in t.current().collect()]


def test_a_batch_of_one_per_cent_writes_about_one_per_cent(spark, tmp_path):
    t = S.Batches(spark, str(tmp_path / "t"), "k string, v string", "k", 8)
    own = spark.range(20000).select(F.col("id").cast("string").alias("k"), F.concat(*[F.sha2(F.concat(F.lit(i), F.col("id").cast("string")), 256) for i in range(8)]).alias("v"))
    t.write(0, own)
    before = sizes(t.path)
    t.write(1, own.filter("k % 100 = 7").withColumn("v", F.reverse("v")))
    after = sizes(t.path)
    assert {f: n for f, n in after.items() if f in before} == before  # no file of the store is written again
    assert sum(n for f, n in after.items() if f not in before) < 0.015 * sum(before.values())
    assert t.current().count() == 20000


def test_compaction_leaves_one_batch_and_the_same_rows(spark, tmp_path):
    t = table(spark, tmp_path / "t", 4)
    for i in range(5):
        t.write(i, rows(spark, *[(f"k{j}", i) for j in range(i, 9)]), spark.createDataFrame([("gone",)], "k string"))
    want = held(t)
    assert t.compact(4) > 0
    assert held(t) == want
    t.compact(2)
    assert held(t) == want and t.compact(2) == 0
    t.write(5, rows(spark, ("k0", 7)))
    assert ("k0", 7) in held(t)


def test_a_stop_inside_a_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t", 2)
    t.write(0, rows(spark, ("a", 1), ("b", 2)))
    t.write(1, rows(spark, ("a", 3)), spark.createDataFrame([("b",)], "k string"))
    monkeypatch.setattr(S, "_remove", lambda *a: None)
    t.compact(2)
    assert held(t) == [("a", 3)]


def test_outdated_rows_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST", 0)
    t = table(spark, tmp_path / "t")
    t.write(0, rows(spark, ("a", 1), ("b", 2)))
    t.write(1, rows(spark, ("a", 3)))
    assert held(t) == [("a", 3), ("b", 2)]


def test_delete_from_counts_what_it_removes(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.write(0, rows(spark, ("a", 1), ("a", 2), ("b", 3)))
    keys = spark.createDataFrame([("a",), ("x",)], "k string")
    assert S.delete_from(t, 1, keys) == 2
    assert held(t) == [("b", 3)]
    assert S.delete_from(t, 2, keys) == 0


def test_a_stop_between_the_two_tables(spark, tmp_path, monkeypatch):
    """The store has the batch, the registry doesn't: the batch runs again and both agree."""
    rows_ = [(f"f{i}", f"h{i}", "t", 9, f"# Title {i}\nwords of file {i}") for i in range(3)]
    spark.createDataFrame(rows_, FILES).write.parquet(str(tmp_path / "in"))
    store, registry = S.chunk_store(spark, str(tmp_path / "store")), S.file_registry(spark, str(tmp_path / "registry"))
    whole, stops = S.Batches.write, [True]

    def write(self, *args):
        if self is registry and stops.pop():
            stops.append(False)
            raise RuntimeError("stopped")
        stops.append(False) if not stops else None
        return whole(self, *args)

    monkeypatch.setattr(S.Batches, "write", write)
    start = lambda: T.ingest_stream(T.read_table(spark, str(tmp_path / "in"), FILES), store, registry, str(tmp_path / "check"), AT).awaitTermination()
    try:
        start()
        raise AssertionError("the first run stops")
    except Exception as e:
        assert "stopped" in str(e)
    start()
    assert registry.current().count() == 3 and store.current().count() == 3


def test_changed_files_replace_their_chunks(spark, tmp_path):
    store, registry = S.chunk_store(spark, str(tmp_path / "store")), S.file_registry(spark, str(tmp_path / "registry"))

    def arrive(*files):
        spark.createDataFrame([(p, str(hash(t)), "t", len(t), t) for p, t in files], FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        T.ingest_stream(T.read_table(spark, str(tmp_path / "in"), FILES), store, registry, str(tmp_path / "check"), AT).awaitTermination()

    arrive(("a", "# A\none part\n# B\nanother part"), ("b", "# C\nof its own"))
    assert store.current().count() == 3
    arrive(("a", "# A\nonly this now"), ("b", "# C\nof its own"))
    assert sorted((r.source, r.text.split("\n")[-1]) for r in store.current().collect()) == [("a", "only this now"), ("b", "of its own")]
    arrive(("0", "the same words"), ("a", "the same words"))  # a file all of whose chunks another one has
    assert [r.source for r in store.current().orderBy("source").collect()] == ["0", "b"]
    arrive(("0", ""), ("0", ""))  # nothing left, and twice in one batch
    assert [(r.source, r.text) for r in store.current().filter("source = '0'").collect()] == [("0", "")]
    assert {r.file_path: r.chunk_count for r in registry.current().collect()} == {"0": 1, "a": 0, "b": 1}


def test_months_are_removed_by_name(spark, tmp_path):
    at = str(tmp_path / "logs")
    months = ["2023-11", "2024-02", "2024-03", "2024-06"]
    logs = spark.createDataFrame([(i, f"{m}-15 10:00:00") for i, m in enumerate(months)] + [(9, None)], "id int, t string").select("id", F.to_timestamp("t").alias("ts"))
    S.write_query_logs(logs, at)
    before = sizes(at)
    assert S.remove_months(spark, at, "2024-06-10 00:00:00", 3) == ["2023-11", "2024-02"]
    after = sizes(at)
    assert after == {f: n for f, n in before.items() if "month=2023-11" not in f and "month=2024-02" not in f}
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [2, 3, 9]
    assert S.remove_months(spark, at, "2024-06-10 00:00:00", 3) == []
    assert S.remove_months(spark, str(tmp_path / "none"), "2024-06-10 00:00:00") == []
