"""Queries that read whole texts: what stands late in a text counts."""

from collections import Counter

import pytest

from corpusloom.operators import chunking as K
from corpusloom.operators import dedup as D
from corpusloom.plans import catalog, corpus_queries


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_answers_are_validated_to_their_end(spark, folder):
    late = "x " * 2000 + "[Source 1] [Source 2] i cannot browse zebra"
    d = folder(documents=([(2, late), (3, "y " * 2000 + "zebra")], "doc_id long, text string"))
    run = lambda name: {r.doc_id: r for r in catalog.QUERIES[name](spark, d).collect()}
    assert run("e21_citation_count")[2].citations == run("e17_validate_answers")[2].n_citations >= 2
    assert run("e19_markers")[2].markers >= 1
    assert run("e23_grounding")[2].grounding > 0


def test_messages_are_read_to_their_end(spark, folder):
    text = "w " * 50 + "helm"
    d = folder(conversations=([(1, 0, "user", text), (1, 1, "user", "why does it fail?")], "conv_id long, turn int, role string, text string"))
    run = lambda name: [r.asDict() for r in catalog.QUERIES[name](spark, d).orderBy("turn").collect()]
    assert "helm" in run("q12_domain_terms")[0]["terms"].split(",")
    assert "helm" in run("q13_conversation_context")[1]["terms"].split(",")
    assert any("helm" in r["expanded"] for r in run("q15_expand_followup"))


def test_all_words_of_a_query_search(spark, folder):
    asked = " ".join(f"w{i}" for i in range(12)) + " zebra"
    d = folder(
        documents=([(1, "w1 w2", "s", "en"), (2, "zebra crossing", "s", "en")], "doc_id long, text string, source string, lang string"),
        benchmark=([(7, asked)], "item_id long, text string"),
    )
    found = lambda name: {r.chunk_id for r in catalog.QUERIES[name](spark, d).collect()}
    assert found("r07_sparse_topk") == {1, 2}
    assert found("r17_format_sources") == {1, 2}
    assert found("r18_compress_extractive") == {1, 2}


def _documents(folder):
    words = " ".join(f"word{i}" for i in range(400))
    texts = ["Alpha beta", "alpha  beta", words, words + " tail", "quite another text", "- a\n- b\n- c\n\n" + "long line of prose. " * 200]
    rows = [(i, x, "s", "en") for i, x in enumerate(texts)]
    return folder(documents=(rows, "doc_id long, text string, source string, lang string"))


def test_dedup_reports_near_copies(spark, folder):
    d = _documents(folder)
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", D.normalize_text(D.F.col("text")).alias("t"), D.simhash64(D.F.col("text")).alias("h")).orderBy("doc_id").collect()
    seen, exact, fuzzy = set(), [], []
    hashes = []
    for r in rows:
        if r.t in seen:
            exact.append(r.doc_id)
            continue
        seen.add(r.t)
        if any(((r.h ^ h) & (2**64 - 1)).bit_count() <= D.max_distance(0.95) for h in hashes):
            fuzzy.append(r.doc_id)
        else:
            hashes.append(r.h)
    assert exact and fuzzy
    got = catalog.QUERIES["d09_dedup_stats"](spark, d).first()
    assert (got.input, got.exact_removed, got.fuzzy_removed, got.output) == (len(rows), len(exact), len(fuzzy), len(rows) - len(exact) - len(fuzzy))
    by_source = {r.key: r.n for r in catalog.QUERIES["d09_duplicates_by_source"](spark, d).collect()}
    assert by_source == {"en:s": len(exact), "en:s (fuzzy)": len(fuzzy)}


def test_chunk_types_are_those_of_chunks(spark, folder):
    d = _documents(folder)
    want = Counter(r.content_type for r in K.chunk_documents(corpus_queries.markdown(spark, d)).collect())
    got = {r.content_type: r.n for r in catalog.QUERIES["k08_chunk_type_counts_chunks"](spark, d).collect()}
    assert got == want and sum(got.values()) > 6
