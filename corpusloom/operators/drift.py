"""Drift of retrieval scores against a stored baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.percentiles import index_percentiles
from corpusloom.operators.telemetry import recent

WINDOW_HOURS, CAP, LEAST = 24, 10_000, 10
WARN, DRIFT, SMALL = 8.0, 15.0, 0.001


def valid_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows with a score from 0 to 1."""
    return df.filter(F.col(score).between(0.0, 1.0))


def score_window(scores: DataFrame, as_of: str, hours: int = WINDOW_HOURS, cap: int = CAP, score: str = "score") -> DataFrame:
    """The newest `cap` valid scores of the window; the cap is the operator's meaning."""
    return recent(valid_scores(scores, score), as_of, hours * 3600).orderBy(F.col("ts").desc(), "id").limit(cap)


def drift_metrics(window: DataFrame, score: str = "score") -> DataFrame:
    """One row: mean, sample std, index-rule quartiles, bounds and n; all but n null under ten samples."""
    x = F.col(score)
    stats = window.agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n")
    ).join(index_percentiles(window, score, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), F.lit(True), "left")
    return stats.select(*[F.when(F.col("n") >= LEAST, F.col(c)).alias(c) for c in ("mean", "std", "p25", "p50", "p75", "min", "max")], "n")


def set_baseline(metrics: DataFrame, path: str, as_of: str, hours: int = WINDOW_HOURS) -> None:
    """Writes one metrics row as the baseline."""
    metrics.withColumn("ts", F.lit(as_of).cast("timestamp")).withColumn("window_hours", F.lit(hours)).write.mode("overwrite").parquet(path)


def shift_percent(base: Column, now: Column) -> Column:
    """Change in percent of the base; from next to nothing, 0 or 100."""
    return F.when(F.abs(base) < SMALL, F.when(F.abs(now) < SMALL, 0.0).otherwise(100.0)).otherwise(F.abs(now - base) / F.abs(base) * 100)


def check_drift(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: shifts of mean, std and median, and the status; the mean's shift decides it."""
    base = baseline.select(*[F.col(c).alias(f"base_{c}") for c in ("mean", "std", "p50", "n")])
    both = metrics.join(F.broadcast(base), F.lit(True), "left")  # one row each
    for c in ("mean", "std", "p50"):
        both = both.withColumn(f"{c}_shift", shift_percent(F.col(f"base_{c}"), F.col(c)))
    status = (
        F.when(F.col("n") < LEAST, "insufficient_data")
        .when(F.col("base_mean").isNull(), "no_baseline")
        .when(F.col("mean_shift") >= DRIFT, "drift_detected")
        .when(F.col("mean_shift") >= WARN, "warning")
        .otherwise("stable")
    )
    text = (
        F.when(F.col("status") == "insufficient_data", F.format_string("%d samples; %d are needed.", F.col("n"), F.lit(LEAST)))
        .when(F.col("status") == "no_baseline", F.lit("No baseline is set."))
        .otherwise(F.format_string("Mean moved by %.1f%% from %.4f to %.4f.", F.col("mean_shift"), F.col("base_mean"), F.col("mean")))
    )
    return both.withColumn("status", status).withColumn("message", text)


def drift_history(metrics_log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per day: mean of means and stds, samples and checks, the newest day first."""
    return (
        recent(metrics_log, as_of, days * 86400)
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.sum("n").alias("samples"), F.count(F.lit(1)).alias("checks"))
        .orderBy(F.col("day").desc())
    )


def drift_status(scores: DataFrame, as_of: str, hours: int = WINDOW_HOURS, score: str = "score") -> DataFrame:
    return recent(valid_scores(scores, score), as_of, hours * 3600).agg(F.count(F.lit(1)).alias("samples")).select(
        "samples", F.lit(WARN).alias("warning_percent"), F.lit(DRIFT).alias("drift_percent"), F.lit(LEAST).alias("least_samples"), F.lit(hours).alias("window_hours")
    )
