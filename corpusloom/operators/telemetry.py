"""Analytics over request logs, feedback and deployments. `as_of` is always given, never the clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.percentiles import index_percentiles

SHORT, LONG = 300, 3600
FEATURES = ("hybrid_search_used", "hyde_used", "reranker_used", "web_search_used")
#: Bucket bounds of the histograms.
SCORE_BOUNDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
LATENCY_BOUNDS = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)
MRR_BOUNDS = (0.0, 0.1, 0.2, 0.25, 0.33, 0.5, 1.0)
SHARE_BOUNDS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def at(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def recent(df: DataFrame, as_of: str, seconds: float, ts: str = "ts") -> DataFrame:
    """Rows of the `seconds` up to as_of, both ends included."""
    end = at(as_of)
    return df.filter((F.col(ts) >= end - F.make_interval(secs=F.lit(seconds))) & (F.col(ts) <= end))


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def rate_per_minute(count: Column, first: Column, last: Column) -> Column:
    """n / (last - first) * 60; n itself for one row or no span; 0 for none."""
    span = epoch(last) - epoch(first)
    return F.when(count == 0, 0.0).when((count < 2) | (span <= 0), count.cast("double")).otherwise(count / span * 60)


def request_rate(requests: DataFrame, as_of: str, window: int = SHORT) -> DataFrame:
    return recent(requests, as_of, window).agg(
        F.count(F.lit(1)).alias("n"), rate_per_minute(F.count(F.lit(1)), F.min("ts"), F.max("ts")).alias("rate_per_minute")
    )


def share_percent(hits: Column, all_: Column) -> Column:
    return F.when(all_ > 0, hits / all_ * 100).otherwise(0.0)


def error_rate(requests: DataFrame, as_of: str, window: int = SHORT) -> DataFrame:
    return recent(requests, as_of, window).agg(
        F.round(share_percent(F.count_if(F.col("status_code") >= 400), F.count(F.lit(1))), 2).alias("error_rate")
    )


def cache_hit_rate(requests: DataFrame, as_of: str, window: int = SHORT) -> DataFrame:
    """Hits in percent of the rows with a flag."""
    return recent(requests, as_of, window).agg(
        F.round(share_percent(F.count_if(F.col("cache_hit")), F.count("cache_hit")), 2).alias("cache_hit_rate")
    )


def latency_stats(requests: DataFrame, as_of: str, window: int = SHORT) -> DataFrame:
    own = recent(requests, as_of, window)
    x = F.col("latency_ms")
    plain = own.agg(
        F.round(F.avg(x), 2).alias("avg"), F.round(F.median(x), 2).alias("median"), F.round(F.min(x), 2).alias("min"), F.round(F.max(x), 2).alias("max")
    )
    tail = index_percentiles(own, "latency_ms", {"p95": 0.95, "p99": 0.99})
    return plain.join(tail.select(F.round("p95", 2).alias("p95"), F.round("p99", 2).alias("p99")), F.lit(True), "left")


def score_stats(requests: DataFrame, as_of: str, window: int = SHORT) -> DataFrame:
    x = F.col("avg_similarity_score")
    return recent(requests, as_of, window).agg(
        F.round(F.avg(x), 4).alias("avg"), F.round(F.median(x), 4).alias("median"), F.round(F.min(x), 4).alias("min"), F.round(F.max(x), 4).alias("max")
    )


def query_hash(query: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(query.cast("binary"), 256), 1, length)


def top_queries(requests: DataFrame, as_of: str, limit: int = 10, window: int = LONG) -> DataFrame:
    """The most frequent query hashes, counted over all rows up to as_of, among those last seen within the window."""
    counted = (
        requests.filter(F.col("ts") <= at(as_of))
        .groupBy(query_hash(F.col("query")).alias("query_hash"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
    )
    return recent(counted, as_of, window, "last_seen").orderBy(F.col("n").desc(), "query_hash").limit(limit)


def usage(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of all rows by key; groups are few."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("_total") * 100, 2).alias("percentage"))


def model_usage(requests: DataFrame) -> DataFrame:
    return usage(requests, "model")


def realtime_snapshot(requests: DataFrame, as_of: str, window: int = SHORT, long_window: int = LONG) -> DataFrame:
    """A1 to A7 in one row."""
    models = model_usage(requests).agg(F.array_sort(F.collect_list(F.struct("model", "n", "percentage"))).alias("model_usage"))
    ranked = F.struct((-F.col("n")).alias("a"), F.col("query_hash").alias("b"), F.col("n").alias("n"))
    top = top_queries(requests, as_of, 10, long_window).agg(
        F.transform(F.array_sort(F.collect_list(ranked)), lambda x: F.struct(x["b"].alias("query_hash"), x["n"].alias("n"))).alias("top_queries")
    )
    latency = latency_stats(requests, as_of, window).select(F.struct("*").alias("latency"))
    scores = score_stats(requests, as_of, window).select(F.struct("*").alias("scores"))
    parts = [error_rate(requests, as_of, window), cache_hit_rate(requests, as_of, window), latency, scores, models, top]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts, request_rate(requests, as_of, window))


def filter_logs(
    logs: DataFrame,
    start: str | None = None,
    end: str | None = None,
    model: str | None = None,
    session_id: str | None = None,
    min_latency: float | None = None,
    max_latency: float | None = None,
    **features: bool,
) -> DataFrame:
    """Rows that meet every given condition; bounds are inclusive."""
    tests = [
        F.col("ts") >= at(start) if start else None,
        F.col("ts") <= at(end) if end else None,
        F.col("model") == model if model is not None else None,
        F.col("session_id") == session_id if session_id is not None else None,
        F.col("latency_ms") >= min_latency if min_latency is not None else None,
        F.col("latency_ms") <= max_latency if max_latency is not None else None,
        *[F.col(f) == v for f, v in features.items()],
    ]
    return reduce(lambda df, t: df.filter(t), [t for t in tests if t is not None], logs)


def query_logs(logs: DataFrame, page: int = 1, page_size: int = 50, **filters) -> tuple[DataFrame, DataFrame]:
    """(one row with the total, the page of rows, newest first)."""
    found = filter_logs(logs, **filters)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return total, found.orderBy(F.col("ts").desc(), "id").offset((page - 1) * page_size).limit(page_size)


def query_summary(logs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: totals, sessions, latency mean and continuous percentiles, uses of each feature."""
    x = F.col("latency_ms")
    return filter_logs(logs, start, end).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.round(F.avg(x), 2).alias("avg_latency_ms"),
        *[F.round(F.percentile(x, F.lit(p)), 2).alias(name) for name, p in (("p50_latency_ms", 0.5), ("p95_latency_ms", 0.95), ("p99_latency_ms", 0.99))],
        *[F.count_if(F.col(f)).alias(f) for f in FEATURES],
    )


def queries_per_day(logs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return filter_logs(logs, start, end).groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def session_logs(logs: DataFrame, limit: int = 50, session_id: str | None = None) -> DataFrame:
    """The newest rows of one session, or of every session, with their place from 1."""
    own = logs if session_id is None else logs.filter(F.col("session_id") == session_id)
    newest = Window.partitionBy("session_id").orderBy(F.col("ts").desc(), "id")
    return own.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)


def log_summary(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return recent(logs, as_of, days * 86400).agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms")
    )


def feedback_summary(feedback: DataFrame, last_n: int = 100) -> DataFrame:
    """Over the newest last_n rows; the rate is null without rows."""
    newest = feedback.orderBy(F.col("ts").desc(), "id").limit(last_n)
    total, good = F.count(F.lit(1)), F.count_if(F.col("helpful"))
    return newest.agg(
        total.alias("total"), good.alias("helpful"), F.count_if(~F.col("helpful")).alias("not_helpful"),
        F.count_distinct("session_id").alias("sessions"), F.when(total > 0, F.round(good / total, 4)).alias("helpful_rate"),
    )


def feedback_rates(feedback: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Per window and minute: rate of feedback, share that is helpful, and both counts."""
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    return (
        feedback.groupBy(F.window("ts", window))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("helpful")).alias("helpful"))
        .select(
            F.col("window.start").alias("start"), "n", "helpful", (F.col("n") - F.col("helpful")).alias("not_helpful"),
            (F.col("n") / seconds * 60).alias("rate_per_minute"), (F.col("helpful") / F.col("n")).alias("helpful_share"),
        )
    )


def feedback_with_logs(feedback: DataFrame, logs: DataFrame, by: str = "query") -> DataFrame:
    """Feedback with its query's log: the newest row of equal hash, or the row of equal id."""
    if by == "id":
        return feedback.join(logs.select("id", F.col("model").alias("log_model"), F.col("latency_ms").alias("log_latency_ms")), "id", "left")
    newest = logs.groupBy(query_hash(F.col("query"), 16).alias("query_hash")).agg(
        F.max_by(F.struct("id", "model", "latency_ms"), F.struct("ts", "id")).alias("log")
    )
    return (
        feedback.withColumn("query_hash", query_hash(F.col("query"), 16))
        .join(newest, "query_hash", "left")
        .select(*feedback.columns, "query_hash", F.col("log.id").alias("log_id"), F.col("log.model").alias("log_model"), F.col("log.latency_ms").alias("log_latency_ms"))
    )


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, le, n): cumulative counts of values up to each bound and up to infinity, and the sum of the values."""
    keys = keys or []
    own = df.filter(F.col(value).isNotNull())
    counts = own.groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)], F.count(value).alias("_all"), F.sum(value).alias("sum")
    )
    rows = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")),
    )
    return counts.select(*keys, F.explode(rows).alias("b"), "sum").select(*keys, "b.le", "b.n", "sum")


def histogram_quantile(hist: DataFrame, q: float, keys: list[str] | None = None) -> DataFrame:
    """The quantile by linear interpolation inside the first bucket whose cumulative count reaches q of all. Values in
    the last bucket give the greatest finite bound; the first bucket starts at 0 if its bound is positive."""
    keys = keys or []
    by = Window.partitionBy(*keys).orderBy("le") if keys else Window.partitionBy(F.lit(1)).orderBy("le")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inf = F.lit(float("inf"))
    rows = (
        hist.withColumn("_before", F.coalesce(F.lag("n").over(by), F.lit(0)))
        .withColumn("_low", F.lag("le").over(by))
        .withColumn("_rank", F.max("n").over(whole) * F.lit(q))
        .filter((F.col("n") >= F.col("_rank")) & (F.col("n") > 0))
    )
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("le", "n", "_before", "_low", "_rank"), "le").alias("b"))
    b = F.col("b")
    low = F.coalesce(b["_low"], F.when(b["le"] > 0, 0.0).otherwise(b["le"]))
    inside = low + (b["le"] - low) * (b["_rank"] - b["_before"]) / F.nullif(b["n"] - b["_before"], F.lit(0))
    return first.select(*keys, F.when(b["le"] == inf, b["_low"]).otherwise(F.coalesce(inside, b["le"])).alias("quantile"))


def rates(df: DataFrame, window: str, seconds: int, keys: list[str] | None = None, good: Column | None = None) -> DataFrame:
    """Per window and keys: rows per second, and the share of rows that are good."""
    keys = keys or []
    good = F.lit(True) if good is None else good
    return (
        df.groupBy(F.window("ts", window), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("_good"))
        .select(F.col("window.start").alias("start"), *keys, "n", (F.col("n") / seconds).alias("per_second"), (F.col("_good") / F.col("n")).alias("share"))
    )


#: Name, series, comparison, bound, window and hold in minutes of the alert rules.
RULES = (
    ("high_error_rate", "error_percent", ">", 5.0, 5, 5),
    ("high_latency", "p95_seconds", ">", 10.0, 5, 5),
    ("low_retrieval_score", "avg_score", "<", 0.4, 10, 10),
    ("high_fallback_rate", "fallback_percent", ">", 30.0, 10, 10),
    ("empty_results", "empty_percent", ">", 10.0, 10, 10),
    ("expansion_failures", "expansion_failure_percent", ">", 20.0, 10, 10),
    ("stream_errors", "stream_error_percent", ">", 5.0, 5, 5),
    ("low_traffic", "per_second", "<", 1.0, 60, 60),
)


def alert_intervals(series: DataFrame, condition: Column, step_seconds: int, hold_seconds: int, keys: list[str] | None = None) -> DataFrame:
    """Firing intervals of a series (ts, ...): stretches of consecutive steps that meet the condition for the hold.

    A missing step ends a stretch. Steps are `step_seconds` apart; a stretch of n steps has held n steps long."""
    keys = keys or []
    number = (F.unix_timestamp("ts") / step_seconds).cast("long")
    own = Window.partitionBy(*keys).orderBy("_no") if keys else Window.partitionBy(F.lit(1)).orderBy("_no")
    return (
        series.filter(condition)
        .withColumn("_no", number)
        .withColumn("_new", F.when(F.col("_no") - F.lag("_no").over(own) == 1, 0).otherwise(1))
        .withColumn("_stretch", F.sum("_new").over(own))
        .groupBy(*keys, "_stretch")
        .agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count(F.lit(1)).alias("steps"))
        .filter(F.col("steps") * step_seconds >= hold_seconds)
        .drop("_stretch")
    )


def deployment_history(deployments: DataFrame, limit: int | None = None) -> DataFrame:
    """Deployments newest first with is_active (the newest) and is_rollback (the one before it).

    Only the two newest rows are found by ordering, so no task holds them all."""
    newest = deployments.orderBy(F.col("deployed_at").desc(), F.col("id").desc())
    two = newest.limit(2).withColumn("_place", F.row_number().over(Window.orderBy(F.col("deployed_at").desc(), F.col("id").desc()))).select("id", "_place")
    marked = deployments.join(F.broadcast(two), "id", "left").select(
        *deployments.columns, (F.coalesce("_place", F.lit(0)) == 1).alias("is_active"), (F.coalesce("_place", F.lit(0)) == 2).alias("is_rollback")
    )
    ordered = marked.orderBy(F.col("deployed_at").desc(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def rollback(deployments: DataFrame) -> DataFrame:
    """The deployment that a rollback makes active: the second newest; none with fewer than two."""
    return deployment_history(deployments).filter("is_rollback").drop("is_active", "is_rollback")


def activate(deployments: DataFrame, new: DataFrame) -> DataFrame:
    """All deployments inactive, and the new ones active."""
    return deployments.withColumn("is_active", F.lit(False)).unionByName(new.withColumn("is_active", F.lit(True)))


def deployments_by_model(deployments: DataFrame) -> DataFrame:
    return deployments.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
