"""Queries of the telemetry, experiment and drift operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.storage import new_path
from corpusloom.operators import drift as D
from corpusloom.operators import experiments as X
from corpusloom.operators import telemetry as A
from corpusloom.plans import views as V
from corpusloom.plans.registry import query
from corpusloom.plans.views import AS_OF

DAY = 86400
W = f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{AS_OF}'"
_P = "list_sort(list({x}))[CAST(least(floor(count({x}) * {p}), count({x}) - 1) AS BIGINT) + 1]"


def _stamp(name, alias=None):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def _sql_stamp(name, alias=None):
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {alias or name}"


@query(f"SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 0.0 WHEN count(*) < 2 OR max(ts) = min(ts) THEN count(*) ELSE round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 60e6, 6) END AS rate_per_minute FROM requests WHERE {W}", "requests")
def a01_request_rate(spark, d):
    return A.request_rate(V.requests(spark, d), AS_OF, DAY).select("n", F.round("rate_per_minute", 6).alias("rate_per_minute"))


@query(f"SELECT round(100.0 * count(*) FILTER (WHERE status_code >= 400) / count(*), 2) AS error_rate FROM requests WHERE {W}", "requests")
def a02_error_rate(spark, d):
    return A.error_rate(V.requests(spark, d), AS_OF, DAY)


@query(f"SELECT round(100.0 * count(*) FILTER (WHERE cache_hit) / count(cache_hit), 2) AS cache_hit_rate FROM requests WHERE {W}", "requests")
def a03_cache_hit_rate(spark, d):
    return A.cache_hit_rate(V.requests(spark, d), AS_OF, DAY)


@query(
    f"SELECT round(avg(latency_ms), 2) AS avg, round(median(latency_ms), 2) AS median, round(min(latency_ms), 2) AS min, round(max(latency_ms), 2) AS max, round({_P.format(x='latency_ms', p='0.95::DOUBLE')}, 2) AS p95, round({_P.format(x='latency_ms', p='0.99::DOUBLE')}, 2) AS p99 FROM requests WHERE {W}",
    "requests",
)
def a04_latency_stats(spark, d):
    return A.latency_stats(V.requests(spark, d), AS_OF, DAY)


@query(f"SELECT round(avg(x), 4) AS avg, round(median(x), 4) AS median, round(min(x), 4) AS min, round(max(x), 4) AS max FROM (SELECT CAST(avg_similarity_score AS DOUBLE) AS x FROM requests WHERE {W})", "requests")
def a05_score_stats(spark, d):
    return A.score_stats(V.requests(spark, d), AS_OF, DAY)


@query(
    f"""SELECT query_hash, n, {_sql_stamp('last_seen')} FROM (SELECT substr(sha256(query), 1, 12) AS query_hash, count(*) AS n, max(ts) AS last_seen FROM requests
WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY 1) WHERE last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY ORDER BY n DESC, query_hash LIMIT 10""",
    "requests",
)
def a06_top_queries(spark, d):
    return A.top_queries(V.requests(spark, d), AS_OF, 10, DAY).select("query_hash", "n", _stamp("last_seen"))


@query("SELECT model, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM requests GROUP BY model", "requests")
def a07_model_usage(spark, d):
    return A.model_usage(V.requests(spark, d))


@query(
    f"""SELECT count(*) AS n, round(100.0 * count(*) FILTER (WHERE status_code >= 400) / count(*), 2) AS error_rate, round(avg(latency_ms), 2) AS avg_latency,
round({_P.format(x='latency_ms', p='0.95::DOUBLE')}, 2) AS p95_latency, (SELECT count(DISTINCT model) FROM requests) AS models FROM requests WHERE {W}""",
    "requests",
)
def a08_realtime_snapshot(spark, d):
    return A.realtime_snapshot(V.requests(spark, d), AS_OF, DAY, DAY).select(
        "n", "error_rate", F.col("latency.avg").alias("avg_latency"), F.col("latency.p95").alias("p95_latency"), F.size("model_usage").cast("long").alias("models")
    )


@query(
    f"SELECT id, session_id, model, latency_ms, {_sql_stamp('ts')} FROM requests WHERE model = 'm1' AND latency_ms BETWEEN 50 AND 400 AND hybrid_search_used AND ts <= TIMESTAMP '{AS_OF}' ORDER BY requests.ts DESC, id LIMIT 50 OFFSET 50",
    "requests",
)
def a09_query_logs(spark, d):
    page = A.query_logs(V.requests(spark, d), 2, 50, end=AS_OF, model="m1", min_latency=50, max_latency=400, hybrid_search_used=True)[1]
    return page.select("id", "session_id", "model", "latency_ms", _stamp("ts"))


@query(
    """SELECT count(*) AS total_queries, count(DISTINCT session_id) AS unique_sessions, round(avg(latency_ms), 2) AS avg_latency_ms,
round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms, round(quantile_cont(latency_ms, 0.99), 2) AS p99_latency_ms,
count(*) FILTER (WHERE hybrid_search_used) AS hybrid_search_used, count(*) FILTER (WHERE hyde_used) AS hyde_used,
count(*) FILTER (WHERE reranker_used) AS reranker_used, count(*) FILTER (WHERE web_search_used) AS web_search_used FROM requests""",
    "requests",
)
def a10_query_summary(spark, d):
    return A.query_summary(V.requests(spark, d))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM requests GROUP BY 1", "requests")
def a10_queries_per_day(spark, d):
    return A.queries_per_day(V.requests(spark, d))


@query("SELECT session_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id) AS rank FROM requests) WHERE rank <= 5", "requests")
def a11_session_logs(spark, d):
    return A.session_logs(V.requests(spark, d), 5).select("session_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT count(*) AS total, count(DISTINCT session_id) AS sessions, round(avg(latency_ms), 4) AS avg_latency_ms FROM requests WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND ts <= TIMESTAMP '{AS_OF}'", "requests")
def a12_log_summary(spark, d):
    return A.log_summary(V.requests(spark, d), AS_OF, 10)


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE helpful) AS helpful, count(*) FILTER (WHERE NOT helpful) AS not_helpful, count(DISTINCT session_id) AS sessions,
round(count(*) FILTER (WHERE helpful) / count(*), 4) AS helpful_rate FROM (SELECT * FROM feedback ORDER BY ts DESC, id LIMIT 100)""",
    "feedback",
)
def a13_feedback_summary(spark, d):
    return A.feedback_summary(V.feedback(spark, d), 100)


@query(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (WHERE helpful) AS helpful, count(*) FILTER (WHERE NOT helpful) AS not_helpful,
round(count(*) / 60, 6) AS rate_per_minute, round(count(*) FILTER (WHERE helpful) / count(*), 6) AS helpful_share FROM feedback GROUP BY 1""",
    "feedback",
)
def a14_feedback_rates(spark, d):
    return A.feedback_rates(V.feedback(spark, d), "1 hour").select(
        _stamp("start"), "n", "helpful", "not_helpful", F.round("rate_per_minute", 6).alias("rate_per_minute"), F.round("helpful_share", 6).alias("helpful_share")
    )


@query(
    """SELECT f.id, f.helpful, substr(sha256(f.query), 1, 16) AS query_hash, l.id AS log_id, l.model AS log_model, l.latency_ms AS log_latency_ms FROM feedback f
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ts DESC, id DESC) AS r FROM requests WHERE web_search_used IS NOT NULL) l ON l.query = f.query AND r = 1""",
    "feedback requests",
)
def a15_feedback_with_logs(spark, d):
    return A.feedback_with_logs(V.feedback(spark, d), V.requests(spark, d)).select("id", "helpful", "query_hash", "log_id", "log_model", "log_latency_ms")


@query(
    "SELECT model, b.le, count(*) FILTER (WHERE latency_ms <= b.le) AS n, round(sum(latency_ms), 4) AS sum FROM requests, (SELECT unnest([10.0, 25, 50, 100, 250, 500, 1000, 2500, 5000, 'inf'::DOUBLE]) AS le) b GROUP BY model, b.le",
    "requests",
)
def a16_histogram(spark, d):
    return A.histogram(V.requests(spark, d), "latency_ms", A.LATENCY_BOUNDS, ["model"]).withColumn("sum", F.round("sum", 4))


@query(
    """WITH b AS (SELECT unnest([10.0, 25, 50, 100, 250, 500, 1000, 2500, 5000, 'inf'::DOUBLE]) AS le),
h AS (SELECT model, le, count(*) FILTER (WHERE latency_ms <= le) AS n FROM requests, b GROUP BY model, le),
c AS (SELECT *, coalesce(lag(n) OVER w, 0) AS before, coalesce(lag(le) OVER w, 0.0) AS low, 0.95::DOUBLE * max(n) OVER (PARTITION BY model) AS r FROM h WINDOW w AS (PARTITION BY model ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY le) AS k FROM c WHERE n >= r AND n > 0)
SELECT model, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (r - before) / (n - before) END, 6) AS quantile FROM f WHERE k = 1""",
    "requests",
)
def a17_histogram_quantile(spark, d):
    hist = A.histogram(V.requests(spark, d), "latency_ms", A.LATENCY_BOUNDS, ["model"])
    return A.histogram_quantile(hist, 0.95, ["model"]).withColumn("quantile", F.round("quantile", 6))


@query(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, model, count(*) AS n, round(count(*) / 3600, 9) AS per_second,
round(count(*) FILTER (WHERE status_code < 400) / count(*), 6) AS share FROM requests GROUP BY 1, 2""",
    "requests",
)
def a18_rates(spark, d):
    return A.rates(V.requests(spark, d), "1 hour", 3600, ["model"], F.col("status_code") < 400).select(
        _stamp("start"), "model", "n", F.round("per_second", 9).alias("per_second"), F.round("share", 6).alias("share")
    )


@query(
    """WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, 100.0 * count(*) FILTER (WHERE status_code >= 500) / count(*) AS error_percent FROM requests GROUP BY 1),
h AS (SELECT ts, epoch(ts) / 3600 - row_number() OVER (ORDER BY ts) AS g FROM s WHERE error_percent > 5)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS until, count(*) AS steps FROM h GROUP BY g HAVING count(*) >= 5""",
    "requests",
)
def a19_alert_intervals(spark, d):
    series = A.rates(V.requests(spark, d), "1 hour", 3600, good=F.col("status_code") >= 500).select(F.col("start").alias("ts"), (F.col("share") * 100).alias("error_percent"))
    return A.alert_intervals(series, F.col("error_percent") > 5, 3600, 5 * 3600).select(_stamp("since"), _stamp("until"), "steps")


@query(
    f"""SELECT id, model, {_sql_stamp('deployed_at')}, r = 1 AS is_active, r = 2 AS is_rollback FROM (SELECT *, row_number() OVER (ORDER BY deployed_at DESC, id DESC) AS r FROM deployments)""",
    "deployments",
)
def a20_deployment_history(spark, d):
    return A.deployment_history(V.deployments(spark, d)).select("id", "model", _stamp("deployed_at"), "is_active", "is_rollback")


@query("SELECT model, count(*) AS n FROM deployments GROUP BY model", "deployments")
def a20_deployments_by_model(spark, d):
    return A.deployments_by_model(V.deployments(spark, d))


# experiments


def _sessions(spark, d):
    return V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id")).distinct()


_SESSIONS = "sessions AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id FROM events)"
_BUCKET = "CAST(('0x' || substr(md5(session_id), 1, 8)) AS BIGINT) % 100"
_SPLIT = [("control", 33.0), ("short", 33.0), ("long", 34.0)]


def _split():
    return F.array(*[F.struct(F.lit(v).alias("variant_id"), F.lit(p).alias("pct")) for v, p in _SPLIT])


@query(f"WITH {_SESSIONS} SELECT session_id, {_BUCKET} AS bucket FROM sessions")
def x01_bucket(spark, d):
    return _sessions(spark, d).select("session_id", X.bucket(F.col("session_id")).alias("bucket"))


@query(
    f"""WITH {_SESSIONS}, w AS (SELECT session_id, md5(session_id) AS h FROM sessions)
SELECT session_id, CAST((((('0x' || substr(h, 1, 8))::BIGINT % 100 * 96 + ('0x' || substr(h, 9, 8))::BIGINT) % 100 * 96 + ('0x' || substr(h, 17, 8))::BIGINT) % 100 * 96 + ('0x' || substr(h, 25, 8))::BIGINT) % 100 AS BIGINT) AS bucket FROM w"""
)
def x02_bucket128(spark, d):
    return _sessions(spark, d).select("session_id", X.bucket128(F.col("session_id")).alias("bucket"))


@query(f"WITH {_SESSIONS} SELECT session_id, CASE WHEN b < 33 THEN 'control' WHEN b < 66 THEN 'short' ELSE 'long' END AS variant_id FROM (SELECT session_id, {_BUCKET} AS b FROM sessions)")
def x03_pick_variant(spark, d):
    return _sessions(spark, d).select("session_id", X.pick_variant(_split(), X.bucket(F.col("session_id"))).alias("variant_id"))


@query(
    f"""WITH {_SESSIONS} SELECT e AS experiment_id, session_id, CASE WHEN CAST(session_id AS INT) % 10 = 0 THEN 'old' WHEN b < 33 THEN 'control' WHEN b < 66 THEN 'short' ELSE 'long' END AS variant_id,
CAST(session_id AS INT) % 10 <> 0 AS is_new FROM (SELECT session_id, {_BUCKET} AS b FROM sessions), (SELECT unnest(['e1']) AS e)"""
)
def x04_assign(spark, d):
    own = _sessions(spark, d)
    experiments = own.limit(1).select(F.explode(F.array(F.struct(F.lit("e1").alias("id"), F.lit("running").alias("status")), F.struct(F.lit("e2").alias("id"), F.lit("paused").alias("status")))).alias("x"))
    experiments = experiments.select(F.col("x.id").alias("experiment_id"), "x.status", _split().alias("traffic_split"))
    both = own.select("session_id", F.explode(F.array(F.lit("e1"), F.lit("e2"))).alias("experiment_id"))
    existing = own.filter(F.col("session_id").cast("int") % 10 == 0).select(F.lit("e1").alias("experiment_id"), "session_id", F.lit("old").alias("variant_id"))
    return X.assign(both, experiments, existing)


def _experiments(spark, d):
    return V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("experiment_id"), F.concat(F.lit("n"), (F.col("o_orderkey") % 1000).cast("string")).alias("name"),
        F.when(F.col("o_orderkey") % 3 == 0, "running").when(F.col("o_orderkey") % 3 == 1, "draft").otherwise("completed").alias("status"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("type"), F.col("o_orderdate").alias("created_at"),
    )


_EXPERIMENTS = """experiments AS (SELECT o_orderkey AS experiment_id, 'n' || (o_orderkey % 1000) AS name, CASE o_orderkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'draft' ELSE 'completed' END AS status,
't' || (o_custkey % 5) AS type, o_orderdate AS created_at FROM orders)"""


@query(f"WITH {_EXPERIMENTS} SELECT experiment_id, name, type FROM experiments WHERE status = 'running' AND type = 't2' ORDER BY created_at DESC, experiment_id LIMIT 20 OFFSET 20")
def x05_list_experiments(spark, d):
    return X.list_experiments(_experiments(spark, d), "running", "t2", 2).select("experiment_id", "name", "type")


@query(f"WITH {_EXPERIMENTS} SELECT type, experiment_id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at, experiment_id) AS r FROM experiments WHERE status = 'running') WHERE r = 1")
def x05_active_by_type(spark, d):
    return X.active_by_type(_experiments(spark, d)).select("type", "experiment_id")


@query(
    """SELECT session_id, 'latency_ms' AS metric_name, latency_ms AS metric_value FROM requests
UNION ALL SELECT session_id, CASE WHEN cache_hit THEN 'feedback_positive' ELSE 'feedback_negative' END, 1.0 FROM requests WHERE cache_hit IS NOT NULL""",
    "requests",
)
def x06_record_results(spark, d):
    calls = V.requests(spark, d).select(F.lit("e").alias("experiment_id"), F.lit("a").alias("variant"), "session_id", "latency_ms", F.col("cache_hit").alias("helpful"))
    return X.record_results(calls).select("session_id", "metric_name", "metric_value")


@query("SELECT variant, count(*) AS n, round(avg(metric_value), 6) AS mean, round(stddev_samp(metric_value), 6) AS std, min(metric_value) AS min, max(metric_value) AS max FROM results GROUP BY variant", "results")
def x07_variant_stats(spark, d):
    return X.variant_stats(V.results(spark, d)).select("variant", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query(
    f"""SELECT variant, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(*) FILTER (WHERE x > 0) AS conversions, {_P.format(x='x', p='0.5::DOUBLE')} AS p50,
{_P.format(x='x', p='0.95::DOUBLE')} AS p95, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours FROM (SELECT *, metric_value AS x FROM results) GROUP BY variant""",
    "results",
)
def x08_variant_report(spark, d):
    return X.variant_report(V.results(spark, d)).select(
        "variant", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "conversions", "p50", "p95", F.round("hours", 6).alias("hours")
    )


_M = "m AS (SELECT variant, count(*) AS n, avg(metric_value) AS mean, var_samp(metric_value) AS v FROM results GROUP BY variant), p AS (SELECT b.variant, b.n, a.n AS n0, b.mean, a.mean AS mean0, b.v, a.v AS v0 FROM m b, m a WHERE a.variant = 'a' AND b.variant <> 'a')"


@query(
    f"WITH {_M} SELECT variant, n, n0, round(abs(mean0 - mean) / sqrt(v0 / n0 + v / n), 6) AS t, round((v0 / n0 + v / n) * (v0 / n0 + v / n) / (v0 / n0 * v0 / n0 / (n0 - 1) + v / n * v / n / (n - 1)), 4) AS df FROM p",
    "results",
)
def x09_welch_test(spark, d):
    return X.welch_test(X.moments(V.results(spark, d)), "a", with_p=False).select("variant", "n", "n0", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query(
    f"""WITH {_M} SELECT variant, round(mean - mean0, 6) AS difference, round((mean - mean0) / sqrt(((n0 - 1) * v0 + (n - 1) * v) / (n + n0 - 2) * (1 / n + 1 / n0)), 6) AS t, CAST(n + n0 - 2 AS DOUBLE) AS df,
round(mean - mean0 - 1.96 * sqrt(v / n + v0 / n0), 6) AS ci_low, round(mean - mean0 + 1.96 * sqrt(v / n + v0 / n0), 6) AS ci_high, n >= 30 AND n0 >= 30 AS adequate FROM p""",
    "results",
)
def x10_student_test(spark, d):
    return X.student_test(X.moments(V.results(spark, d)), "a", with_p=False).select(
        "variant", F.round("difference", 6).alias("difference"), F.round("t", 6).alias("t"), "df", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "adequate"
    )


@query()
def x11_recommend(spark, d):
    return X.recommend(X.welch_test(X.moments(V.results(spark, d)), "a")).select("variant", "winner", "recommendation")


@query("SELECT p_brand AS brand, p_size AS k, round(CASE WHEN p_size % 4 = 0 THEN 50.0 ELSE 100.0 * p_size / (p_size + 3 * p_size) END, 6) AS first_pct FROM part")
def x12_normalize_split(spark, d):
    part = V.table(spark, d, "part")
    w = F.when(F.col("p_size") % 4 == 0, 0).otherwise(F.col("p_size"))
    split = F.array(F.struct(F.lit("a").alias("variant_id"), w.alias("weight")), F.struct(F.lit("b").alias("variant_id"), (w * 3).alias("weight")))
    return part.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("k"), F.round(X.normalize_split(split)[0]["pct"], 6).alias("first_pct"))


_STATUS = "CASE event_type WHEN 'view' THEN 'draft' WHEN 'click' THEN 'running' WHEN 'error' THEN 'paused' ELSE 'completed' END"


def _status_log(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "draft").when(kind == "click", "running").when(kind == "error", "paused").otherwise("completed")
    return V.table(spark, d, "events").select(F.col("user_id").alias("experiment_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query(
    f"""WITH l AS (SELECT event_id, user_id AS experiment_id, {_STATUS} AS status, ts FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY experiment_id ORDER BY ts, status) AS previous FROM l)
SELECT event_id, previous, status FROM p WHERE previous IS NOT NULL AND previous <> status AND previous || '>' || status NOT IN ('draft>running', 'draft>completed', 'running>paused', 'running>completed', 'paused>running', 'paused>completed')"""
)
def x13_check_transitions(spark, d):
    return X.check_transitions(_status_log(spark, d)).select("event_id", "previous", "status")


@query(
    f"""SELECT experiment_id, strftime(min(ts) FILTER (WHERE status = 'running'), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(min(ts) FILTER (WHERE status = 'completed'), '%Y-%m-%d %H:%M:%S') AS ended_at
FROM (SELECT user_id AS experiment_id, {_STATUS} AS status, ts FROM events) GROUP BY 1"""
)
def x13_status_times(spark, d):
    return X.status_times(_status_log(spark, d)).select("experiment_id", _stamp("started_at"), _stamp("ended_at"))


@query(f"WITH {_EXPERIMENTS} SELECT name, count(*) AS n FROM experiments GROUP BY name HAVING count(*) > 1")
def x13_repeated_names(spark, d):
    return X.repeated_names(_experiments(spark, d))


# drift


def _scores(spark, d):
    return V.requests(spark, d).select("id", "ts", ((F.col("avg_similarity_score") * 110 - 5) / 100).alias("score"))


_SCORES = "scores AS (SELECT id, ts, (CAST(avg_similarity_score AS DOUBLE) * 110 - 5) / 100 AS score FROM requests)"


@query(f"WITH {_SCORES} SELECT id, round(score, 6) AS score FROM scores WHERE score BETWEEN 0 AND 1", "requests")
def f01_valid_scores(spark, d):
    return D.valid_scores(_scores(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES} SELECT id, round(score, 6) AS score FROM scores WHERE score BETWEEN 0 AND 1 AND {W.replace('1 DAY', '2 DAY')} ORDER BY ts DESC, id LIMIT 400", "requests")
def f02_score_window(spark, d):
    return D.score_window(_scores(spark, d), AS_OF, 48, 400).select("id", F.round("score", 6).alias("score"))


#: The cap of score_window.
_NEWEST = f"ORDER BY ts DESC, id LIMIT {D.CAP}"
_METRICS = "round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, " + ", ".join(f"round({_P.format(x='x', p=f'{p}::DOUBLE')}, 6) AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))) + ", round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS n"


@query(f"WITH {_SCORES} SELECT {_METRICS} FROM (SELECT score AS x FROM scores WHERE score BETWEEN 0 AND 1 AND {W} {_NEWEST})", "requests")
def f03_drift_metrics(spark, d):
    m = D.drift_metrics(D.score_window(_scores(spark, d), AS_OF))
    return m.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75", "min", "max")], "n")


_EARLY = W.replace(AS_OF, "2024-01-08 12:00:00")


@query(f"WITH {_SCORES} SELECT {_METRICS}, '2024-01-08 12:00:00' AS set_at, 24 AS window_hours FROM (SELECT score AS x FROM scores WHERE score BETWEEN 0 AND 1 AND {_EARLY} {_NEWEST})", "requests")
def f04_set_baseline(spark, d):
    """The baseline as it is read again."""
    at, when = new_path(spark, "baseline"), "2024-01-08 12:00:00"
    D.set_baseline(D.drift_metrics(D.score_window(_scores(spark, d), when)), at, when)
    return spark.read.parquet(at).select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75", "min", "max")], "n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("set_at"), "window_hours")


@query(
    f"""WITH {_SCORES}, a AS (SELECT {_METRICS.replace('round(', '(').replace(', 6)', ')')} FROM (SELECT score AS x FROM scores WHERE score BETWEEN 0 AND 1 AND {W} {_NEWEST})),
b AS (SELECT {_METRICS.replace('round(', '(').replace(', 6)', ')')} FROM (SELECT score AS x FROM scores WHERE score BETWEEN 0 AND 1 AND {_EARLY} {_NEWEST})),
s AS (SELECT abs(a.mean - b.mean) / b.mean * 100 AS m, abs(a.std - b.std) / b.std * 100 AS d, abs(a.p50 - b.p50) / b.p50 * 100 AS p, a.n FROM a, b)
SELECT n, round(m, 4) AS mean_shift, round(d, 4) AS std_shift, round(p, 4) AS p50_shift, CASE WHEN n < 10 THEN 'insufficient_data' WHEN m >= 15 THEN 'drift_detected' WHEN m >= 8 THEN 'warning' ELSE 'stable' END AS status FROM s""",
    "requests",
)
def f05_check_drift(spark, d):
    now = D.drift_metrics(D.score_window(_scores(spark, d), AS_OF))
    base = D.drift_metrics(D.score_window(_scores(spark, d), "2024-01-08 12:00:00"))
    return D.check_drift(now, base).select("n", *[F.round(f"{c}_shift", 4).alias(f"{c}_shift") for c in ("mean", "std", "p50")], "status")


def _metrics_log(spark, d):
    own = D.valid_scores(_scores(spark, d)).groupBy(F.date_trunc("hour", "ts").alias("ts"))
    return own.agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.count("score").alias("n"))


@query(
    f"""WITH {_SCORES}, l AS (SELECT date_trunc('hour', ts) AS ts, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std, count(*) AS n FROM scores WHERE score BETWEEN 0 AND 1 GROUP BY 1)
SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std, CAST(sum(n) AS BIGINT) AS samples, count(*) AS checks FROM l WHERE {W.replace('1 DAY', '7 DAY')} GROUP BY 1""",
    "requests",
)
def f06_drift_history(spark, d):
    return D.drift_history(_metrics_log(spark, d), AS_OF).select("day", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "samples", "checks")


@query(f"WITH {_SCORES} SELECT count(*) AS samples, 8.0 AS warning_percent, 15.0 AS drift_percent, 10 AS least_samples, 24 AS window_hours FROM scores WHERE score BETWEEN 0 AND 1 AND {W}", "requests")
def f07_drift_status(spark, d):
    return D.drift_status(_scores(spark, d), AS_OF)
