"""Literal cases of the telemetry, experiment, drift, query, retrieval, evaluation and validation operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.percentiles import index_percentiles
from corpusloom.functions.stats import incomplete_beta
from corpusloom.operators import drift as D
from corpusloom.operators import evaluate as E
from corpusloom.operators import experiments as X
from corpusloom.operators import query as Q
from corpusloom.operators import retrieval as R
from corpusloom.operators import telemetry as A
from corpusloom.operators import validate as O

AS_OF = "2024-01-01 01:00:00"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def logs(spark, rows):
    frame = spark.createDataFrame(rows, "id int, sec int, latency_ms double, status_code int, cache_hit boolean")
    return frame.withColumn("ts", F.expr(f"timestamp'{AS_OF}' - make_interval(0, 0, 0, 0, 0, 0, sec)"))


@pytest.mark.parametrize("n", [1, 2, 10, 999, 10_000])
def test_index_rule(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random() * 100, 5.0]) for _ in range(n)]
    frame = spark.createDataFrame([(v, "k") for v in values] + [(None, "k")], "v double, k string")
    ps = {"a": 0.5, "b": 0.95, "c": 0.0, "d": 0.99}
    got = index_percentiles(frame, "v", ps, ["k"]).first()
    assert [got[x] for x in ps] == [sorted(values)[min(n - 1, int(n * p))] for p in ps.values()]


def test_request_rate(spark):
    def rate(seconds):
        return A.request_rate(logs(spark, [(i, s, 1.0, 200, None) for i, s in enumerate(seconds)]), AS_OF).first().rate_per_minute

    assert rate([]) == 0 and rate([5]) == 1 and rate([7, 7, 7]) == 3
    assert rate([0, 30, 60]) == 3.0 and rate([0, 30, 60, 301]) == 3.0


def test_latency_errors_and_hits(spark):
    rows = logs(spark, [(i, i, x, 200, None) for i, x in enumerate([100.0, 200.0, 150.0, 300.0, 250.0])])
    got = A.latency_stats(rows, AS_OF).first()
    assert (got.avg, got["median"], got["min"], got["max"], got.p95) == (200, 200, 100, 300, 300)
    mixed = logs(spark, [(0, 1, 1.0, 200, True), (1, 1, 1.0, 200, True), (2, 1, 1.0, 200, False), (3, 1, 1.0, 500, False), (4, 1, 1.0, 404, None)])
    assert A.error_rate(mixed, AS_OF).first().error_rate == 40
    assert A.cache_hit_rate(mixed, AS_OF).first().cache_hit_rate == 50
    empty = A.latency_stats(rows.filter("false"), AS_OF).first()
    assert empty.avg is None and empty.p95 is None


def test_alert_needs_its_hold(spark):
    minutes = [0, 1, 2, 3, 10, 11, 12, 13, 14, 15]
    series = spark.createDataFrame([(m,) for m in minutes], "m int").select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0)").alias("ts"), F.lit(9.0).alias("v"))
    got = A.alert_intervals(series, F.col("v") > 5, 60, 300).collect()
    assert [(str(r.since), r.steps) for r in got] == [("2024-01-01 00:10:00", 6)]


def test_deployments(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 3), (3, "a", 2)], "id int, model string, d int").withColumn("deployed_at", F.timestamp_seconds("d"))
    got = {r.id: (r.is_active, r.is_rollback) for r in A.deployment_history(rows).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True)}
    assert A.rollback(rows).first().id == 3


def test_welch_and_student(spark):
    def tests(a, b):
        rows = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "variant string, metric_value double").withColumn("metric_name", F.lit("m"))
        stats = X.moments(rows, "m")
        return X.welch_test(stats, "a").first(), X.student_test(stats, "a").first()

    flat, _ = tests([3, 3, 3], [3, 3])
    assert flat.p_value == 1.0
    assert tests([1], [2, 3])[0].p_value is None
    rng = random.Random(2)
    a, b = [rng.gauss(10, 2) for _ in range(200)], [rng.gauss(10.6, 2) for _ in range(220)]
    welch, student = tests(a, b)
    assert welch.df > 100 and welch.p_value == pytest.approx(math.erfc(welch.t / math.sqrt(2)))
    assert student.p_value == pytest.approx(welch.p_value, abs=0.01) and student.adequate
    few, _ = tests([1, 2, 3], [2, 4, 6])
    assert few.p_value == pytest.approx(math.erfc(few.t / (1 + 1 / (4 * few.df)) / math.sqrt(2)))


def test_student_tail_by_quadrature():
    for t, n in ((0.5, 3), (2.0, 10), (3.1, 57)):
        c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        step = 1e-3
        inner = sum(c * (1 + x * x / n) ** (-(n + 1) / 2) * step for x in ((i + 0.5) * step for i in range(int(t / step))))
        assert incomplete_beta(n / 2, 0.5, n / (n + t * t)) == pytest.approx(1 - 2 * inner, abs=1e-5)


def test_split_is_ordered(spark):
    split = F.array(*[F.struct(F.lit(v).alias("variant_id"), F.lit(p).alias("pct")) for v, p in (("z", 33.0), ("a", 33.0), ("m", 33.0))])
    rows = spark.createDataFrame([(0,), (32,), (33,), (65,), (66,), (99,)], "b int")
    assert [r.v for r in rows.select(X.pick_variant(split, F.col("b")).alias("v")).collect()] == ["z", "z", "a", "a", "m", "m"]
    assert rows.select(X.pick_variant(split, F.col("b"), "first").alias("v")).collect()[-1].v == "z"


@pytest.mark.parametrize(("mean", "status"), [(0.70, "warning"), (0.67, "drift_detected"), (0.79, "stable")])
def test_drift(spark, mean, status):
    def metrics(m, n=10):
        rows = spark.createDataFrame([(m + (0.01 if i % 2 else -0.01),) for i in range(n)] + [(1.5,), (None,)], "score double")
        return D.drift_metrics(D.valid_scores(rows))

    got = D.check_drift(metrics(mean), metrics(0.80)).first()
    assert got.status == status
    assert D.check_drift(metrics(mean, 9), metrics(0.80)).first().status == "insufficient_data"
    assert D.check_drift(metrics(mean), metrics(0.80).filter("false")).first().status == "no_baseline"


def test_query_rewrites(spark):
    assert one(spark, Q.expand_abbreviations(F.col("x")), "  K8s   ns ") == "kubernetes namespace"
    assert one(spark, Q.expand_abbreviations(F.col("x")), "instructions") == "instructions"
    assert one(spark, Q.expand_abbreviations(F.col("x")), "CI/CD") == "continuous integration continuous delivery"


def test_followup_is_resolved_once(spark):
    history = [("s", 0, "user", "My pods keep crashing"), ("s", 1, "assistant", "Check logs"), ("s", 2, "user", "How do I debug it and its logs?")]
    rows = Q.conversation_context(spark.createDataFrame(history, "session_id string, turn int, role string, text string"))
    row = rows.filter("turn = 2").select("topic", "terms", Q.expand_followup(F.col("text"), F.col("terms"), F.col("topic")).alias("e"), Q.should_expand(F.col("text"), F.col("history_size"), F.col("has_user")).alias("why")).first()
    assert row.topic == "pods" and row.e == "How do I debug pods and its logs?" and row.why is None
    first = rows.filter("turn = 0").select(Q.should_expand(F.col("text"), F.col("history_size"), F.col("has_user")).alias("why")).first()
    assert first.why == "no_conversation_history"


def test_templates(spark):
    v = "array<struct<name:string,type:string,required:boolean,default:string>>"
    rows = spark.createDataFrame(
        [("{a} {b} {c} {d} {{e}}", [("a", "number", True, None), ("b", "string", False, "dflt"), ("c", "string", True, None)], {"a": "7", "z": "1"})],
        f"p string, v {v}, m map<string,string>",
    )
    got = rows.select(Q.render_template(F.col("p"), F.col("v"), F.col("m")).alias("r"), Q.validate_template(F.col("v"), F.col("m")).alias("t"), Q.template_variables(F.col("p")).alias("n")).first()
    assert got.r == "7 dflt <c> <d> {{e}}" and got.n == ["a", "b", "c", "d"]
    assert (got.t.is_valid, got.t.missing, got.t.unknown) == (False, ["c"], ["z"])


def test_rrf(spark):
    def side(items):
        return spark.createDataFrame([(1, i + 1, x, x) for i, x in enumerate(items)], "query_id int, rank int, chunk_id string, text string")

    got = R.rrf(side("ab"), side("bc")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]
    assert [r.score for r in got] == pytest.approx([0.5 / 62 + 0.5 / 61, 0.5 / 61, 0.5 / 62])
    alone = R.rrf(side("cab"), side("bac"), alpha=1.0).orderBy("rank").collect()
    assert [r.chunk_id for r in alone] == ["c", "a", "b"]


def test_cosine_and_platt(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(R.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1, 0, -1, 0]
    assert one(spark, R.platt_apply(F.col("x")), 0.0, "double") == 0.5


def packed(spark, texts, budget, web=None):
    rows = spark.createDataFrame([(1, i + 1, t, "doc") for i, t in enumerate(texts)], "query_id int, rank int, text string, source_type string")
    blocks = None if web is None else spark.createDataFrame([(1, web)], "query_id int, web string")
    return R.pack_context(rows, budget, blocks).first()


def test_context_packing(spark):
    head = len("[Source 1 - doc]\n")
    exact = packed(spark, ["a" * (400 - head - 1)], 100)
    assert exact.n_sources == 1 and not exact.is_truncated
    over = packed(spark, ["a" * (400 - head - 1), "b" * 1000, "c"], 140)
    assert over.n_sources == 1 and "b" not in over.context
    cut = packed(spark, ["a" * (400 - head - 1), "b" * 1000, "c"], 300)
    assert cut.n_sources == 2 and cut.is_truncated and cut.context.endswith("...\n") and "c" not in cut.context.replace("[Source", "").replace("doc", "")
    web = packed(spark, ["a" * 300], 100, "w" * 200)
    assert "a" * 101 not in web.context and web.context.endswith("w" * 200)


def test_rerank_keeps_the_order_of_failed_queries(spark):
    rows = spark.createDataFrame([(1, 1, "x", "a b", "zz"), (1, 2, "y", "a b", "a b"), (2, 1, "u", None, "b"), (2, 2, "v", "q", "q")], "query_id int, rank int, chunk_id string, query string, text string")
    got = R.rerank(rows, 2, lambda q, t: F.when(q.isNotNull(), R.token_overlap(q, t))).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got] == ["y", "x", "u", "v"]
    kept = R.min_rerank(R.rerank(rows.filter("query_id = 1 and rank = 1"), 2))
    assert kept.count() == 1


def test_retrieval_measures(spark):
    examples = spark.createDataFrame([(1, ["A", "b"], ["kw", "no"]), (2, [], []), (3, ["a"], ["kw"])], "query_id int, relevant_ids array<string>, keywords array<string>")
    found = spark.createDataFrame([(1, i, f"s{i}", "t", "the a text kw" if i == 2 else "-", 0.5) for i in range(1, 6)], "query_id int, rank int, source string, source_type string, text string, score double")
    got = {r.query_id: r for r in E.evaluate_retrieval(examples, found).collect()}
    assert (got[1].mrr, got[1].recall, got[1].precision, got[1].keyword_hit) == (0.5, 0.5, 0.2, 0.5)
    assert (got[2].recall, got[2].keyword_hit, got[2].mrr) == (1.0, 1.0, 0.0)
    assert (got[3].recall, got[3].precision, got[3].n) == (0.0, 0.0, 0)


def test_ndcg(spark):
    kind = "array<double>"
    assert one(spark, E.ndcg(F.col("x")), [0.9, 0.5, 0.1], kind) == 1.0
    assert one(spark, E.ndcg(F.col("x")), [0.0, 0.0], kind) == 0.0
    assert one(spark, E.grade(F.col("x")), -1.0, "double") == 0.4
    worst = one(spark, E.ndcg(F.col("x")), [0.1, 0.5, 0.9], kind)
    gain = lambda s: sum(x / math.log2(i + 2) for i, x in enumerate(s))
    assert worst == pytest.approx(gain([0.1, 0.5, 0.9]) / gain([0.9, 0.5, 0.1]))


def test_answer_validation(spark):
    context = "The service restarts pods when the probe fails."
    rows = [
        (0, "  ", context, 3), (1, "Pods restart, see [Source 10].", context, 3), (2, "The service restarts pods when the probe fails [Source 1].", context, 1),
        (3, "I'm not sure. I'm not sure, it dépends.", None, None), (4, "You must restart it. According to the context it works.", context, 2), (5, "You must go." + " pad" * 80, context, 0),
    ]
    got = {r.id: r for r in O.validate_answers(spark.createDataFrame(rows, "id int, response string, context string, n_sources int")).collect()}
    assert got[0].confidence == 0 and not got[0].is_valid
    assert not got[1].is_valid and "INVALID_SOURCE_REFERENCE" in {i.code for i in got[1].issues}
    assert got[2].is_valid and got[2].confidence > 0.9
    assert got[3].n_markers == 1 and [i.position for i in got[3].issues if i.code == "HALLUCINATION_MARKER"] == [0]
    assert got[4].n_claims == 0 and got[5].n_claims == 1
    assert {i.code for i in got[5].issues} >= {"UNSUPPORTED_CLAIM", "NO_SOURCE_CITATIONS"}


def test_compression(spark):
    text = "Nothing here. The pod restarts often. ```a. b``` stays. Pod and restart policy."
    rows = spark.createDataFrame([("pod restarts policy", text), ("zzz", "No match. At all.")], "q string, t string")
    got = rows.select(R.compress_extractive(F.col("q"), F.col("t"), 2).alias("c")).collect()
    assert got[0].c.text == "```a. b``` stays. The pod restarts often." and got[1].c.text == "No match. At all."


def test_grade_filter(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 0), (1, "b", None, 0), (2, "c", 0.1, 2)], "query_id int, chunk_id string, grade double, retries int")
    kept, decision = R.grade_filter(rows)
    assert [r.chunk_id for r in kept.collect()] == ["a"]
    assert {r.query_id: r.action for r in decision.collect()} == {1: "retry", 2: "proceed"}
