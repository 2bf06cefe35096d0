"""Python steps on texts hold few of them at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import pieces as P
from corpusloom.operators import chunking as K
from corpusloom.operators import dedup as D
from corpusloom.operators.validate import validate_answers
from corpusloom.plans import catalog


@pytest.mark.parametrize("texts", [[], [None], ["a" * 90, None, "", "bc"], ["ab"] * 1000])
def test_pieces_are_bounded_and_give_all_rows(monkeypatch, texts):
    monkeypatch.setattr(P, "CHARACTERS", 50)
    monkeypatch.setattr(P, "ROWS", 20)
    sizes, whole = [], pa.array
    monkeypatch.setattr(P.pa, "array", lambda x, kind: sizes.append((len(x), sum(len(t or "") for t in x))) or whole(x, kind))
    got = P.in_pieces(whole(texts, pa.string()), lambda t: t * 2, pa.string())
    assert got.to_pylist() == [None if t is None else t * 2 for t in texts]
    assert max(n for n, _ in sizes) <= 20 and max(c for _, c in sizes) <= 2 * (50 + 90)


def test_ascii_texts_are_not_sent(spark):
    df = spark.createDataFrame([("A  b",), ("\ufb01x\u00a0Y",), (None,)], "t string")
    assert [r[0] for r in df.select(D.normalize_text(F.col("t"))).collect()] == ["a b", "fix y", ""]
    plan = df.select(D.normalize_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    sent = next(x for x in plan.split("\n") if "ArrowEvalPython" in x)
    assert "CASE WHEN" in sent or "_groupingexpression" in plan or "CASE WHEN" in plan.split("ArrowEvalPython")[1]


def test_chunks_of_null_are_none(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(K.split_fixed(F.col("t"))).collect()] == [["a b"], []]


def test_neighbours_are_hashed_once(spark):
    plan = catalog.QUERIES["d05_hamming"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_key_words_of_an_answer_are_searched_once(spark):
    held = spark.createDataFrame([("a response", "a context", 1)], "response string, context string, n_sources int")
    text = validate_answers(held)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= text.count("[a-zA-Z]{3,}") <= 2
