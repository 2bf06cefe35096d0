"""Tables of requests, feedback, registries and the like derived from the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-15 12:00:00"

SQL = {
    "requests": """requests AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS session_id, value AS latency_ms,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, 'm' || (user_id % 3) AS model, k % 2 = 0 AS cache_hit,
  k / 100.0 AS avg_similarity_score, event_type || ':' || k AS query, event_type IN ('click', 'purchase') AS hybrid_search_used,
  event_type = 'signup' AS hyde_used, k < 50 AS reranker_used, event_type = 'view' AS web_search_used
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "feedback": """feedback AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS session_id, event_type = 'purchase' AS helpful,
  event_type || ':' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS query FROM events WHERE event_type IN ('purchase', 'error'))""",
    "results": """results AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS session_id, value AS metric_value, 'latency_ms' AS metric_name,
  CASE WHEN CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 50 THEN 'a' ELSE 'b' END AS variant FROM events)""",
    "deployments": """deployments AS (SELECT event_id AS id, 'm' || (user_id % 3) AS model, ts AS deployed_at FROM events WHERE event_type = 'signup')""",
    "registry": """registry AS (SELECT 'doc/' || doc_id AS file_path, md5(text) AS content_hash, source AS source_type,
  CAST(n_chars // 1000 + 1 AS BIGINT) AS chunk_count, n_chars AS file_size FROM documents WHERE doc_id % 10 <> 0)""",
    "current": """current AS (SELECT 'doc/' || doc_id AS file_path, CASE WHEN doc_id % 5 = 0 THEN md5(text || '*') ELSE md5(text) END AS content_hash,
  source AS source_type, n_chars AS file_size FROM documents WHERE doc_id % 7 <> 0)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("value").alias("latency_ms"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        (k % 2 == 0).alias("cache_hit"),
        (k / 100.0).alias("avg_similarity_score"),
        F.concat_ws(":", kind, k.cast("string")).alias("query"),
        kind.isin("click", "purchase").alias("hybrid_search_used"),
        (kind == "signup").alias("hyde_used"),
        (k < 50).alias("reranker_used"),
        (kind == "view").alias("web_search_used"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .filter(kind.isin("purchase", "error"))
        .select(
            F.col("event_id").alias("id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").cast("string").alias("session_id"),
            (kind == "purchase").alias("helpful"),
            F.concat_ws(":", kind, F.get_json_object("props", "$.k")).alias("query"),
        )
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.experiments import bucket

    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("value").alias("metric_value"),
        F.lit("latency_ms").alias("metric_name"),
        F.when(bucket(F.col("user_id").cast("string")) < 50, "a").otherwise("b").alias("variant"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter("event_type = 'signup'")
        .select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
            F.col("ts").cast("timestamp").alias("deployed_at"),
        )
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .filter("doc_id % 10 <> 0")
        .select(
            F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"),
            F.md5("text").alias("content_hash"),
            F.col("source").alias("source_type"),
            F.expr("n_chars div 1000 + 1").alias("chunk_count"),
            F.col("n_chars").alias("file_size"),
        )
    )


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .filter("doc_id % 7 <> 0")
        .select(
            F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"),
            F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("*")))).otherwise(F.md5("text")).alias("content_hash"),
            F.col("source").alias("source_type"),
            F.col("n_chars").alias("file_size"),
        )
    )
