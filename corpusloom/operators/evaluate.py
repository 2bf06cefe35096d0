"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.percentiles import index_percentiles
from corpusloom.functions.storage import checkpoint




def relevance_match(examples: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, rank, relevant_id): lower-cased ids that occur in a row's source, source_type or first 500 characters."""
    ids = examples.select("query_id", F.explode(F.array_distinct("relevant_ids")).alias("relevant_id")).withColumn("_id", F.lower("relevant_id"))
    low = retrieved.select("query_id", "rank", *[F.lower(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("source", "source_type")], F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 500)).alias("_text"))
    hit = F.col("_source").contains(F.col("_id")) | F.col("_source_type").contains(F.col("_id")) | F.col("_text").contains(F.col("_id"))
    return low.join(ids, "query_id").filter(hit).select("query_id", "rank", "relevant_id")


def evaluate_retrieval(examples: DataFrame, retrieved: DataFrame, k: int = 5) -> DataFrame:
    """examples (query_id, relevant_ids, keywords, ...) with MRR, recall, precision, keyword hits and similarity at k.

    No relevant ids make recall 1, no keywords make the hit rate 1; no rows make the others 0. Lists are sorted."""
    own = retrieved.filter(F.col("rank") <= k)
    match = relevance_match(examples, own)
    per = match.groupBy("query_id").agg(
        F.min("rank").alias("_first"), F.collect_set("relevant_id").alias("_found"), F.count_distinct("rank").alias("_rows")
    )
    piece = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))
    text = own.groupBy("query_id").agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), " ")).alias("_text"),
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("_avg"), F.max("score").alias("_max"), F.min("score").alias("_min"),
    )
    all_ = examples.join(per, "query_id", "left").join(text, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ids, keys = F.array_distinct("relevant_ids"), F.col("keywords")
    found = F.coalesce("_found", F.array().cast("array<string>"))
    hit = F.filter(keys, lambda w: F.contains(F.coalesce(F.col("_text"), F.lit("")), F.lower(w)))
    return all_.select(
        *examples.columns, "n",
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        F.when(F.size(ids) == 0, 1.0).otherwise(F.size(found) / F.size(ids)).alias("recall"),
        F.when(F.col("n") > 0, F.coalesce("_rows", F.lit(0)) / F.least(F.lit(k), F.col("n"))).otherwise(0.0).alias("precision"),
        F.when(F.size(keys) == 0, 1.0).otherwise(F.size(hit) / F.size(keys)).alias("keyword_hit"),
        F.array_sort(hit).alias("keywords_found"), F.array_sort(F.array_except(keys, hit)).alias("keywords_missed"),
        F.array_sort(found).alias("relevant_found"), F.array_sort(F.array_except(ids, found)).alias("relevant_missed"),
        *[F.coalesce(f"_{c}", F.lit(0.0)).alias(f"{c}_similarity") for c in ("avg", "max", "min")],
    )


def eval_suite(results: DataFrame, category: str | None = None) -> DataFrame:
    """Averages over successful rows, over all and by category and difficulty; time is summed over all rows."""
    own = results if category is None else results.filter(F.col("category") == category)
    ok = F.col("error").isNull()
    level = F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, "category").otherwise("difficulty")
    means = [F.avg(F.when(ok, F.col(c))).alias(c) for c in ("mrr", "recall", "precision", "keyword_hit", "avg_similarity")]
    return own.groupingSets([(), ("category",), ("difficulty",)], "category", "difficulty").agg(
        level.alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("succeeded"), *means, F.sum("time_ms").alias("time_ms")
    )


def grade(score: Column) -> Column:
    return F.when(score < 0, F.greatest(F.lit(0.0), (score + 5) / 10)).otherwise(F.least(score, F.lit(1.0)))


def dcg(scores: Column, k: int = 5) -> Column:
    gains = F.transform(F.slice(scores, 1, k), lambda s, i: grade(s) / F.log2(i + F.lit(2.0)))
    return F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)


def ndcg(scores: Column, k: int = 5) -> Column:
    """DCG by that of the same scores sorted; 0 if that is 0."""
    ideal = dcg(F.sort_array(scores, asc=False), k)
    return F.when(ideal > 0, dcg(scores, k) / ideal).otherwise(0.0)


def score_mrr(scores: Column, threshold: float = 0.5) -> Column:
    place = F.array_position(F.transform(scores, lambda s: s >= threshold), True)
    return F.when(place > 0, 1 / place).otherwise(0.0)


def positive_share_at_k(scores: Column, k: int = 5) -> Column:
    """Scores above 0 among the first k, by k."""
    return F.size(F.filter(F.slice(scores, 1, k), lambda s: s > 0)) / k


recall_at_k = positive_share_at_k


def precision_at_k(scores: Column, k: int = 5, least: float = 0.3) -> Column:
    return F.size(F.filter(F.slice(scores, 1, k), lambda s: s > least)) / k


def retrieval_metrics(scored: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Per query over (query_id, rank, score, rerank_score): statistics, score buckets and score-based measures, of which
    rerank scores win where a query has them.

    No row holds all scores of a query: the first and the best k come from ranked windows, which cut each partition down before
    they shuffle, and the place of the first score over the threshold is a count of the rows before it. A query whose id is
    null counts as one."""
    x = F.col("score")
    rows = scored.select("query_id", "rank", "score", F.coalesce("rerank_score", "score").alias("best"))
    at = F.struct("rank", "best")
    out = rows.groupBy("query_id").agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.median(x).alias("median"),
        F.count_if(x >= 0.8).alias("excellent"), F.count_if((x >= 0.6) & (x < 0.8)).alias("good"), F.count_if((x >= 0.4) & (x < 0.6)).alias("fair"), F.count_if(x < 0.4).alias("poor"),
        F.min(F.when(F.col("best") >= threshold, at)).alias("_at"),
    )
    own = checkpoint(out)

    def first(name: str, *order: Column) -> DataFrame:
        """The best scores of the first k rows in an order."""
        ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_i") <= k)
        return ranked.groupBy(F.col("query_id").alias("_q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "best"))), lambda r: r["best"]).alias(name))

    same = F.col("_q").eqNullSafe(F.col("query_id"))
    marks = own.filter(F.col("_at").isNotNull()).select(F.col("query_id").alias("_q"), F.col("_at").alias("_mark"))
    before = rows.join(marks, same).filter(at < F.col("_mark")).groupBy("_q").agg(F.count(F.lit(1)).alias("_before"))
    for part in (first("_s", F.col("rank"), F.col("best")), first("_ideal", F.col("best").desc_nulls_last(), F.col("rank")), before):
        own = own.join(part, same, "left").drop("_q")
    s, ideal = F.col("_s"), dcg(F.col("_ideal"), k)
    mrr = F.when(F.col("_at").isNotNull(), 1 / (F.coalesce("_before", F.lit(0)) + 1)).otherwise(0.0)
    measures = {"ndcg": F.when(ideal > 0, dcg(s, k) / ideal).otherwise(0.0), "mrr": mrr, "positive_share": positive_share_at_k(s, k), "precision": precision_at_k(s, k)}
    return own.withColumns(measures).drop("_s", "_ideal", "_at", "_before")


def metrics_summary(log: DataFrame, last_n: int = 100) -> DataFrame:
    """One row over the newest rows (ts, id, scores, latency_ms, ndcg, mrr): pooled score and latency statistics."""
    newest = log.orderBy(F.col("ts").desc(), "id").limit(last_n)
    pooled = newest.select(F.explode("scores").alias("s")).agg(
        F.count("s").alias("scores"), F.avg("s").alias("score_mean"), F.median("s").alias("score_median"), F.min("s").alias("score_min"), F.max("s").alias("score_max")
    )
    own = newest.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.size("scores") > 0).alias("with_results"), F.count_if(F.size("scores") <= 0).alias("without_results"),
        F.avg("latency_ms").alias("latency_mean"), F.median("latency_ms").alias("latency_median"), F.max("latency_ms").alias("latency_max"),
        *[f(c).alias(f"{c}_{n}") for c in ("ndcg", "mrr") for n, f in (("mean", F.avg), ("median", F.median))],
    )
    return own.join(F.broadcast(pooled)).join(index_percentiles(newest, "latency_ms", {"latency_p95": 0.95}), F.lit(True), "left")


def long_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    x, y = long_tokens(a), long_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def heuristic_answer_scores(rows: DataFrame) -> DataFrame:
    """rows (question, answer, context, ground_truth) with four overlaps; context_recall is null without a ground truth."""
    q, a, c, g = (F.col(x) for x in ("question", "answer", "context", "ground_truth"))
    return rows.withColumns({
        "faithfulness": F.round(jaccard(a, c), 4), "answer_relevancy": F.round(jaccard(a, q), 4), "context_precision": F.round(jaccard(c, q), 4),
        "context_recall": F.when(F.length(F.coalesce(g, F.lit(""))) > 0, F.round(jaccard(g, c), 4)),
    })


def source_match_rate(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Share of results whose source_type is expected, and queries with results."""
    rows = retrieved.join(expected.select("query_id", "expected_sources"), "query_id")
    return rows.agg(
        F.coalesce(F.avg(F.array_contains("expected_sources", F.col("source_type")).cast("double")), F.lit(0.0)).alias("match_rate"), F.count_distinct("query_id").alias("with_results")
    )


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """runs (config, category, complexity, latency_ms, score) per configuration, and per category and complexity of each."""
    x, s = F.col("latency_ms"), F.col("score")
    level = F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, "category").otherwise("complexity")
    q = lambda c, p, n: F.percentile(c, F.lit(p)).alias(n)
    return runs.groupingSets([("config",), ("config", "category"), ("config", "complexity")], "config", "category", "complexity").agg(
        level.alias("level"), F.count(F.lit(1)).alias("n"), q(x, 0.5, "p50"), q(x, 0.95, "p95"), q(x, 0.99, "p99"), F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), q(s, 0.5, "score_p50"), q(s, 0.95, "score_p95"), F.avg(s).alias("score_mean"), F.stddev_pop(s).alias("score_std"),
    )


EDGES = (0.0, 0.3, 0.5, 0.7, 0.8, 0.9, 1.0)


def score_distribution(scores: DataFrame, score: str = "score") -> DataFrame:
    """(low, high, n, percent) of half-open ranges; 1 itself is in none."""
    x = F.col(score)
    counts = scores.agg(*[F.count_if((x >= a) & (x < b)).alias(f"b{i}") for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))], F.count(x).alias("_n"))
    rows = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"b{i}").alias("n")) for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))])
    return counts.select(F.explode(rows).alias("r"), "_n").select("r.*", F.when(F.col("_n") > 0, F.round(F.col("r.n") / F.col("_n") * 100, 2)).otherwise(0.0).alias("percent"))


def score_percentiles(scores: DataFrame, score: str = "score", ps: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    return scores.agg(*[F.percentile(score, F.lit(p)).alias(f"p{round(p * 100)}") for p in ps])


def dataset_stats(examples: DataFrame) -> DataFrame:
    return examples.groupBy("category", "difficulty").agg(F.count(F.lit(1)).alias("n"))


