import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import quality
from corpusloom.llm.decontaminate import find_contamination
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.near_dup import near_duplicates
from tests.llm.fixtures import CLASHES, texts

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    rows.append(rows[14])
    rows += [(3, "an id that is there twice, but with another text", "en", "s0", 48), (None, "no id", None, None, None), (None, "none either", None, None, None)]
    rows += [(900 + i, "\n".join(["a line of all"] * 2), "en", "s1", 27) for i in range(10)]  # empty after line dedup
    rows += [(1000 + i, f"JUNK!! {i} " + "XX!! ZQ!! " * 40, "en", "s2", 400) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i < 900), 0) for i, *_ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts()[20].split()[:30]))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_takes_effect_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        got = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "quality":
            want = quality.score(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).filter("_score >= 0.3")
            assert got.count() == want.count()
            left = {r.doc_id for r in got.collect()}
            assert sum(1000 + i in left for i in range(60)) < 10 and len(left & set(range(len(texts())))) > 0.8 * len(texts())
        if name == "line_dedup":
            dropped = {(r.doc_id, bytes(r._kept)) for r in dedup_lines(docs).collect() if r._n_dropped}
            assert dropped and dropped <= {(r.doc_id, (r.text or "").encode()) for r in got.collect()}
            assert got.count() == docs.count()
        if name == "near_dedup":
            groups = {r._component: r.component_id for r in near_duplicates(docs).collect()}
            assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(groups.values(), key=str)
        if name == "decontaminate":
            bad = {r.doc_id for r in find_contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect() if r._n_hit and 20 * r._n_hit >= r._n_words}
            assert bad and {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} - bad
        assert name == "mix" or got.columns == columns
        docs = got
    assert {"doc_id", "taken", "target"} <= set(docs.columns)


def test_run_is_the_stages_in_turn(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    again = corpus_pipeline.run(spark, folder).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again))


def test_rows_that_share_an_id_are_told_apart(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.keep_one_of_near_copies(spark, docs, folder).collect()
    assert sorted(r.text for r in rows if r.doc_id == 3) == sorted([texts()[3], "an id that is there twice, but with another text"])
    assert {r.text for r in rows if r.doc_id is None} == {"no id", "none either"}


def test_empty_table_and_clashing_names(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [c for c in [*CLASHES, "_score", "doc", "id", "n", "place", "_component"]]
    wide = docs.select("*", *[F.lit(7).alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name != "mix":
            assert got.columns == wide.columns
            row = got.first()
            assert all(row[c] == 7 for c in extra)
