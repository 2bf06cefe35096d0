"""Work of searches and text checks that grows no faster than the texts."""

import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.operators import validate as O
from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.dedup import nfkc, normalize_text
from corpusloom.plans import retrieval_queries as Q
from corpusloom.sources.store import chunk_store, file_registry
from corpusloom.streaming import streams as T


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_vectors_find_the_words_of_a_text_once(spark, monkeypatch):
    texts = ["a b a c_1 ü", "", None, "!?", "one two three " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    vectors = df.select("id", Q._hashed(R.tokens(F.col("text"))).alias("v"))
    assert plan(vectors).count("regexp_extract_all") == 1 and "lambda" not in plan(vectors)
    got = {r.id: r.v for r in vectors.collect()}
    for i, t in enumerate(texts):
        words = None if t is None else t.replace("!?", "").split()
        want = None if words is None else [sum(zlib.crc32(w.encode()) % 16 == k for w in words) / max(1, len(words)) for k in range(16)]
        assert got[i] == want
    monkeypatch.setattr(Q, "WORDS", 2)  # pieces that end within and between the lists
    lists = pa.array([["a", "b", "a"], None, [], ["c"], ["a"], ["b", "c"]])
    assert [x for w in lists.to_pylist() for x in Q._hashed.func(pa.array([w], lists.type)).to_pylist()] == Q._hashed.func(lists).to_pylist()


def test_hybrid_search_ranks_once_and_takes_a_null_text(spark):
    texts = spark.createDataFrame([(i, f"word{i} common text") for i in range(60)] + [(60, None)], "chunk_id long, text string")
    vectors = texts.select("chunk_id", Q._hashed(R.tokens(F.col("text"))).alias("embedding"))
    asked = spark.createDataFrame([(1, "word7 common")], "query_id long, text string").withColumn("embedding", Q._hashed(R.tokens(F.col("text"))))
    out = R.hybrid_topk(asked, vectors, R.sparse_encode(texts, "chunk_id"), texts, 5)
    assert "Generate" not in plan(out)  # both rankings are computed already
    assert out.filter("rank = 1").first().chunk_id == 7


def test_texts_meet_few_rows_found_without_a_shuffle(spark):
    found = R.checkpoint(spark.range(5).select(F.lit(1).alias("query_id"), F.col("id").alias("chunk_id"), F.col("id").alias("rank")))
    texts = spark.range(1000).select(F.col("id").alias("chunk_id"), F.col("id").cast("string").alias("text"))
    out = R.with_texts(found, texts)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.chunk_id, r.text) for r in out.collect()) == [(i, str(i)) for i in range(5)]


def test_weights_of_some_terms_are_those_of_all(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"a b{i % 3} c{i} " * (i % 4)) for i in range(20)] + [(20, None)], "chunk_id long, text string")
    only = spark.createDataFrame([("a",), ("b1",), ("c7",), ("a",), ("z",)], "term string")
    rows = lambda df: sorted((r.chunk_id, r.term, round(r.weight, 9)) for r in df.collect())
    for idf in (False, True):
        want = [r for r in rows(R.sparse_encode(texts, "chunk_id", idf=idf)) if r[1] in ("a", "b1", "c7")]
        assert rows(R.sparse_encode(texts, "chunk_id", idf=idf, only=only)) == want
        with monkeypatch.context() as m:
            m.setattr(R, "HELD_TERMS", 1)
            assert rows(R.sparse_encode(texts, "chunk_id", idf=idf, only=only)) == want


def test_candidates_are_ranked_once(spark, monkeypatch):
    held = {"documents": spark.createDataFrame([(i, f"word{i} common", "s", "en") for i in range(30)], "doc_id long, text string, source string, lang string"),
            "benchmark": spark.createDataFrame([(0, "word3 common"), (1, "word4")], "item_id long, text string")}
    monkeypatch.setattr(Q.V, "table", lambda spark, d, name: held[name])
    out = Q.r14_carry_similarity(spark, "")
    assert plan(out).count("Generate") == 0
    assert len(out.collect()) == 21


def test_patterns_are_tried_on_texts_that_hold_what_they_need(spark):
    assert [O.needed(p) for p in (r"i don'?t have (a|b) (c )?\d+%x", r"a|bcd", r"((a|b) c)?def", r"\x41bc", r"ab(cd)*[ef]+ghi{2}j", r"(?!no)Yes sir")] == ["t have ", "", "", "", "ab", ""]
    texts = ["I DON'T have Access to it; i cannot verify. I'm 100% sure, I'm not 100% sure", "by default the pod is up, you must", "ſ K As of MY knowledge", "İ i think this MIGHT", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (O.UNCERTAIN, O.FABRICATED, O.CLAIMS):
        got = [r.f for r in df.select(O.all_positions(F.col("t"), patterns).alias("f")).collect()]
        hits = [[(m.start(), m[0]) for p in patterns for m in re.finditer(p, t or "", re.I | re.A)] for t in texts]
        assert [[(x.first, x.hit) for x in f] for f in got] == hits
        # one lower case of a text, and no pattern tried on a text without its piece
        shown = plan(df.select(O.all_positions(F.col("t"), patterns).alias("f")))
        assert shown.count("lower(t#") == 1 and shown.count("Contains") == sum(len(O.needed(p)) > 1 for p in patterns)


def test_chunking_sends_a_text_to_python_once(spark):
    docs = spark.createDataFrame([("a", "# Head\n" + "word " * 600), ("b", None), ("c", "```py\n" + "x = 1\n" * 700 + "```"), ("d", " \n")], "source string, text string")
    chunks = chunk_documents(docs)
    assert chunks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.source: r.n for r in chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["b"] == got["d"] == 1 and got["a"] > 2 and got["c"] > 2


def test_text_is_normalised_without_a_search_of_every_character(spark):
    """The same as the pattern over the whole text, for every character of the basic plane alone, twice and between letters."""
    rows = [(t,) for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) for t in (c, f"a{c}{c} B\n{c}")] + [(" \n\t x \r\n y ",), ("",), (None,)]
    whole = F.coalesce("text", F.lit(""))
    want = F.trim(F.regexp_replace(F.lower(nfkc(whole)), r"(?U)\s+", " "))
    both = spark.createDataFrame(rows, "text string").repartition(4).select("text", normalize_text(F.col("text")).alias("got"), want.alias("want"))
    assert both.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_a_streamed_batch_is_read_for_its_entries_and_its_texts_alone(spark, tmp_path):
    """Once without and once with the texts; each further use of a batch would read all of it again."""
    schema = "file_path string, content_hash string, source_type string, file_size long, text string"
    spark.createDataFrame([(f"f{i}", f"h{i}", "t", 9, f"# Title {i}\nwords {i}") for i in range(40)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    stream = T.read_table(spark, str(tmp_path / "in"), schema).withColumn("text", counted("text"))
    store, registry = chunk_store(spark, str(tmp_path / "store")), file_registry(spark, str(tmp_path / "registry"))
    T.ingest_stream(stream, store, registry, str(tmp_path / "check"), "2024-01-02 00:00:00").awaitTermination()
    assert store.current().count() == 40 and registry.current().count() == 40
    assert seen.value <= 2 * 40
