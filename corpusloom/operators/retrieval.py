"""Batch retrieval: dense and sparse ranking, fusion, re-scoring, context packing and caches over tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.storage import checkpoint
from corpusloom.operators.query import expand_abbreviations
from corpusloom.operators.telemetry import at

#: Queries whose vectors are sent with a task; more are dealt to blocks of about so many, and the corpus to slabs.
QUERY_BLOCK, SLAB = 1024, 65_536
#: Rows of a matrix of scores that are held at a time.
PIECE = 4096
#: Terms of queries that are broadcast at most, and the parts of a term's rows beyond.
HELD_TERMS, SALTS = 500_000, 32
#: Pivots of a semantic cache, and the entries or queries of a cell beyond which it is cut.
PIVOTS, CACHE_CELL = 32, 4096
K1, B = 1.2, 0.75
#: Characters that decide whether two texts are the same in a fusion.
START = 200


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 if a norm is 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms).otherwise(0.0)


def normalize_score(score: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    if metric == "dot":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))
    if metric == "euclid":
        return F.exp(score)
    raise ValueError(f"unknown metric {metric}")


def rank_by(df: DataFrame, *order: Column, name: str = "rank", most: int | None = None) -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if most is None else out.filter(F.col(name) <= most)


def fetch_limit(k: int, min_score: float) -> int:
    return min(3 * k, 100) if min_score > 0 else k


def _matrix(vectors: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Unit vectors of n rows."""
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks]) if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


def _best(asked: pa.Array, unit: np.ndarray, b: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """The rows of a batch (chunk_id, embedding) with the best cosines for each query."""
    scores = unit @ _matrix(b.column(1), b.num_rows).T
    # rounded for the cut, with ties kept, so that equal scores don't depend on the batch
    shown = np.round(scores, 12)
    if scores.shape[1] > most:
        bound = np.partition(shown, -most, axis=1)[:, -most]
        q, c = np.nonzero(shown >= bound[:, None])
    else:
        q, c = (x.ravel() for x in np.indices(scores.shape))
    return pa.RecordBatch.from_arrays([asked.take(pa.array(q)), b.column(0).take(pa.array(c)), pa.array(scores[q, c])], ["query_id", "chunk_id", "score"])


def _nearest(ids: list, matrix: np.ndarray, most: int):
    """Per Arrow batch: the best rows for each query of a block, by cosine."""
    unit = matrix / np.where((n := np.linalg.norm(matrix, axis=1, keepdims=True)) > 0, n, 1)

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield _best(pa.array(ids), unit, b, most)

    return apply


def _dealt(asked: DataFrame, rows: DataFrame, most: int, kinds: str) -> DataFrame:
    """The best rows for each query, found in cells of one block of queries and one slab of the corpus. A block's queries
    are sent to each slab and a slab's rows to each block, so a task holds one cell however many queries there are."""
    blocks, slabs = -(-asked.count() // QUERY_BLOCK), max(1, -(-rows.count() // SLAB))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = asked.select("query_id", "embedding", place("query_id", blocks).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("_s"))
    c = rows.select("chunk_id", "embedding", place("chunk_id", slabs).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([a["query_id"].slice(0, 0), b["chunk_id"].slice(0, 0), pa.array([], pa.float64())], ["query_id", "chunk_id", "score"])
        if not a.num_rows or not b.num_rows:
            return empty
        ids, unit = a["query_id"].combine_chunks(), _matrix(a["embedding"], a.num_rows)
        pieces = b.select(["chunk_id", "embedding"]).to_batches(max_chunksize=PIECE)
        return pa.Table.from_batches([_best(ids, unit, p, most) for p in pieces if p.num_rows])

    return q.groupBy("_b", "_s").cogroup(c.groupBy("_b", "_s")).applyInArrow(cell, kinds)


def dense_topk(
    queries: DataFrame, corpus: DataFrame, k: int = 5, min_score: float = 0.3, metric: str = "cosine", fetch: int | None = None, **equal: str
) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k nearest rows of corpus (chunk_id, embedding, ...) for each query
    (query_id, embedding) that reach min_score. Equalities filter the corpus first. `fetch` rows are taken before the
    threshold is applied.

    Up to QUERY_BLOCK queries are sent with the tasks that scan the corpus; more stay in Spark and meet the corpus block
    by slab. A task returns its best rows only, and the window that ranks them is limited before its shuffle."""
    fetch = fetch or fetch_limit(k, min_score)
    for name, value in equal.items():
        corpus = corpus.filter(F.col(name) == value)
    rows = corpus.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, score double"
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    block = asked.limit(QUERY_BLOCK + 1).collect()
    if not block:
        return queries.sparkSession.createDataFrame([], kinds).withColumn("rank", F.lit(1)).select("query_id", "rank", "chunk_id", "score")
    if len(block) <= QUERY_BLOCK:
        found = rows.mapInArrow(_nearest([q[0] for q in block], np.array([q[1] for q in block], np.float64), fetch), kinds)
    else:
        found = _dealt(asked, rows, fetch, kinds)
    order = (F.round("score", 12).desc(), F.col("chunk_id"))
    cut = rank_by(found, *order, most=fetch).withColumn("score", normalize_score(F.col("score"), metric)).filter(F.col("score") >= min_score)
    return rank_by(cut, *order, most=k).select("query_id", "rank", "chunk_id", "score")


def dense_topk_batch(queries: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """The same for many queries at once, which is the native form."""
    return dense_topk(queries, corpus, **options)


def quantize(corpus: DataFrame, quantile: float = 0.99, column: str = "embedding") -> DataFrame:
    """corpus with `quantized`: components as bytes, scaled so that the quantile of their sizes is 127."""
    flat = corpus.select(F.explode(column).alias("x"))
    bound = flat.agg(F.percentile_approx(F.abs(F.col("x").cast("double")), F.lit(quantile), F.lit(10000)).alias("_bound"))
    scale = F.when(F.col("_bound") > 0, 127 / F.col("_bound")).otherwise(0.0)
    scaled = F.transform(column, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x.cast("double") * scale))).cast("tinyint"))
    return corpus.join(F.broadcast(bound)).withColumn("quantized", scaled).drop("_bound")


def quantized_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, oversample: float = 2.0, rescore: bool = True) -> DataFrame:
    """Candidates by byte vectors, oversampled, then ranked again by full vectors."""
    small = quantize(corpus).select("chunk_id", F.col("quantized").alias("embedding"))
    first = dense_topk(queries, small, k=int(k * oversample), min_score=0.0, fetch=int(k * oversample))
    if not rescore:
        return first.filter(F.col("rank") <= k)
    exact = (
        first.drop("score")
        .join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
        .join(corpus.select("chunk_id", F.col("embedding").alias("_c")), "chunk_id")
        .withColumn("score", normalize_score(cosine(F.col("_q"), F.col("_c"))))
    )
    return rank_by(exact.drop("rank"), F.round("score", 12).desc(), F.col("chunk_id"), most=k).select("query_id", "rank", "chunk_id", "score")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sparse_encode(texts: DataFrame, key: str, text: str = "text", idf: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): BM25 term weights of each text; idf multiplies by ln(1 + (N - df + 0.5) / (df + 0.5)). With
    `only` (term, ...), the rows of its terms, whose weights are the same: up to HELD_TERMS terms, checked, other words go
    before they are counted.

    Texts are shuffled once, by their key, so that neither the counts of terms nor sums over a key's terms (sparse_topk)
    shuffle the terms."""
    split = texts.select(key, text).repartition(F.col(key)).select(key, tokens(F.col(text)).alias("_t"))
    size = split.agg(F.avg(F.size("_t")).alias("_avg"), F.count(F.lit(1)).alias("_docs"))
    # outer, as Spark would else test every text for terms before the shuffle and split it twice
    words = split.select(key, F.size("_t").alias("_len"), F.explode_outer("_t").alias("term")).filter(F.col("term").isNotNull())
    if only is not None:
        terms = checkpoint(only.select("term").distinct())
        few = terms.count() <= HELD_TERMS
        words = words.join(F.broadcast(terms), "term", "left_semi") if few else words
    tf = words.groupBy(key, "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
    norm = K1 * (1 - B + B * F.col("_len") / F.col("_avg"))
    if only is not None and not few:
        tf = tf.join(terms, "term", "left_semi")
    out = tf.join(F.broadcast(size)).withColumn("weight", F.col("_tf") * (K1 + 1) / (F.col("_tf") + norm))  # one row
    if idf:
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
        out = out.join(df, "term").withColumn("weight", F.col("weight") * F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    return out.select(key, "term", "weight")


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """queries (query_id, term, weight) against corpus (chunk_id, term, weight): the k highest sums of products over
    shared terms. Corpus terms that no query has are dropped before the join. Terms of queries are broadcast up to
    HELD_TERMS rows, checked; beyond, the rows of a term are dealt to SALTS parts, so that a common one is not one task's."""
    asked = checkpoint(queries.select("query_id", "term", F.col("weight").alias("_q")))
    terms = asked.select("term").distinct()
    if asked.count() <= HELD_TERMS:
        met = corpus.join(F.broadcast(terms), "term", "left_semi").join(F.broadcast(asked), "term")
    else:
        held = corpus.join(terms, "term", "left_semi").withColumn("_p", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
        met = held.join(asked.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "_p"])
    scored = met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("_q")).alias("score"))
    return rank_by(scored, F.round("score", 9).desc(), F.col("chunk_id"), most=k).select("query_id", "rank", "chunk_id", "score")


def with_texts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found (chunk_id, ...), computed already, with the columns of texts. Up to HELD_TERMS rows found are broadcast,
    checked, so that a corpus of texts is not shuffled for the few that a search returns."""
    return texts.join(F.broadcast(found) if found.count() <= HELD_TERMS else found, "chunk_id")


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 60, alpha: float = 0.5, key: Column | None = None) -> DataFrame:
    """Fusion of two rankings (query_id, rank, chunk_id, text): alpha / (k + dense rank) + (1 - alpha) / (k + sparse rank).

    Rows are the same if the first START characters of their texts are. A text twice in a ranking takes its last rank.
    Ties keep the dense order, then the sparse one."""
    key = F.substring("text", 1, START) if key is None else key

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("query_id", key.alias("_key")).agg(
            F.max("rank").alias(f"{name}_rank"), F.min("rank").alias(f"_{name}_first"), F.min_by("chunk_id", "rank").alias(f"_{name}_id")
        )

    both = side(dense, "dense").join(side(sparse, "sparse"), ["query_id", "_key"], "full_outer")
    share = [F.coalesce(F.lit(w) / (k + F.col(f"{n}_rank")), F.lit(0.0)) for n, w in (("dense", alpha), ("sparse", 1 - alpha))]
    scored = both.withColumn("score", share[0] + share[1]).withColumn("chunk_id", F.coalesce("_dense_id", "_sparse_id"))
    order = (F.round("score", 12).desc(), F.col("_dense_first").asc_nulls_last(), F.col("_sparse_first").asc_nulls_last())
    return rank_by(scored, *order).select("query_id", "rank", "chunk_id", "score", "dense_rank", "sparse_rank")


def hybrid_topk(
    queries: DataFrame, dense_corpus: DataFrame, sparse_corpus: DataFrame, texts: DataFrame, k: int = 5, min_score: float = 0.3, alpha: float = 0.5
) -> DataFrame:
    """queries (query_id, text, embedding) against dense_corpus (chunk_id, embedding), sparse_corpus (chunk_id, term,
    weight) and texts (chunk_id, text). Abbreviations are expanded for the sparse side. Queries without a sparse hit fall
    back to the dense ranking with its own threshold. Both rankings are computed once; fusion sees the starts of texts only."""
    fetch = min(4 * k, 100)
    dense = checkpoint(dense_topk(queries, dense_corpus, k=fetch, min_score=0.0, fetch=fetch))
    expanded = queries.select("query_id", expand_abbreviations(F.col("text")).alias("text"))
    sparse = checkpoint(sparse_topk(sparse_encode(expanded, "query_id"), sparse_corpus, fetch))
    named = texts.select("chunk_id", F.substring("text", 1, START).alias("text"))
    fused = rrf(with_texts(dense, named), with_texts(sparse, named), alpha=alpha)
    best = fused.filter(F.col("score") >= 0.01 * min_score).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
    alone = dense.filter(F.col("score") >= min_score).join(sparse.select("query_id").distinct(), "query_id", "left_anti")
    return best.join(sparse.select("query_id").distinct(), "query_id", "left_semi").unionByName(
        alone.filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
    )


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; the default pair scorer."""
    own = F.array_distinct(tokens(query))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokens(text))) / F.size(own)).otherwise(0.0)


def platt_apply(score: Column, a: float = 1.0, b: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(a * score + b)))


def platt_fit(scored: DataFrame, c: float = 1.0, score: str = "score", label: str = "label") -> tuple[float, float]:
    """(a, b) of a logistic regression of binary labels on scores with inverse penalty c; both labels must occur."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = scored.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k")).first()
    if counts["k"] != 2:
        raise ValueError("calibration needs both labels")
    model = LogisticRegression(standardization=False, regParam=1 / (c * counts["n"]), elasticNetParam=0.0, maxIter=200, tol=1e-9).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def rerank(
    candidates: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = token_overlap, calibration: tuple[float, float] | None = None
) -> DataFrame:
    """candidates (query_id, rank, chunk_id, query, text) ranked by scorer(query, text): the k best with rerank_score,
    raw_score, is_calibrated and is_truncated. A score that fails (null or not a number) keeps the query's own order."""
    raw = scorer(F.col("query"), F.col("text"))
    scored = candidates.withColumn("raw_score", F.nanvl(raw.cast("double"), F.lit(None).cast("double")))
    per_query = Window.partitionBy("query_id")
    failed = F.max(F.col("raw_score").isNull()).over(per_query)
    out = F.col("raw_score") if calibration is None else platt_apply(F.col("raw_score"), *calibration)
    scored = (
        scored.withColumn("_failed", failed)
        .withColumn("rerank_score", F.when(~F.col("_failed"), out))
        .withColumn("is_calibrated", F.lit(calibration is not None) & ~F.col("_failed"))
        .withColumn("is_truncated", F.floor((F.length("query") + F.length("text")) / 4) > 512)
        .withColumnRenamed("rank", "prior_rank")
    )
    return rank_by(scored, F.round("rerank_score", 12).desc_nulls_last(), F.col("prior_rank"), most=k).drop("_failed")


def min_rerank(ranked: DataFrame, least: float = 0.01, score: str = "rerank_score") -> DataFrame:
    """Rows of at least a score, or the best row of a query if all fall short."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    return ranked.withColumn("_best", best).filter((F.col(score) >= least) | ((F.col("rank") == 1) & (F.col("_best") < least))).drop("_best")


def carry_similarity(ranked: DataFrame, before: DataFrame) -> DataFrame:
    """ranked with similarity: the score before re-ranking of the row whose text starts alike (100 characters, the last
    one wins), or 0."""
    key = F.substring("text", 1, 100)
    old = before.groupBy("query_id", key.alias("_key")).agg(F.max_by("score", "rank").alias("_old"))
    return ranked.withColumn("_key", key).join(old, ["query_id", "_key"], "left").withColumn("similarity", F.coalesce("_old", F.lit(0.0))).drop("_key", "_old")


def fallback_decision(queries: DataFrame, results: DataFrame, threshold: float = 0.4, reranked: bool = False) -> DataFrame:
    """(query_id, search, reason) for every query, from the scores of its results."""
    stats = results.groupBy("query_id").agg(F.count("score").alias("_n"), F.avg("score").alias("_avg"), F.max("score").alias("_max"))
    joined = queries.select("query_id").join(stats, "query_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    low_avg = F.format_string("low_avg_score_%.3f", F.col("_avg"))
    if reranked:
        reason = F.when(F.col("_n") == 0, "no_local_results").when(F.col("_avg") < 0, low_avg)
    else:
        reason = (
            F.when(F.col("_n") == 0, "no_local_results").when(F.col("_avg") < threshold, low_avg)
            .when(F.col("_max") < threshold, F.format_string("low_max_score_%.3f", F.col("_max")))
        )
    return joined.withColumn("reason", reason).select("query_id", F.col("reason").isNotNull().alias("search"), "reason")


def count_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


SEPARATOR = "\n---\n"
WEB_PREFIX = "\n\n--- Web Search Results ---\n\n"


def pack_context(ranked: DataFrame, max_tokens: int = 4096, web: DataFrame | None = None) -> DataFrame:
    """(query_id, context, n_sources, is_truncated): texts in rank order until the first that overflows the budget. That
    one is cut if at least 50 tokens are left and more than 100 of its characters fit. A web block (query_id, web)
    reserves its tokens first."""
    gap = len(SEPARATOR) // 4
    rows = ranked.select("query_id", "rank", F.trim("text").alias("_body"), F.coalesce("source_type", F.lit("Unknown")).alias("_type"))
    numbered = rows.withColumn("_no", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    head = F.concat(F.lit("[Source "), F.col("_no").cast("string"), F.lit(" - "), F.col("_type"), F.lit("]\n"))
    rows = numbered.withColumn("_head", head).withColumn("_full", F.concat("_head", "_body", F.lit("\n")))
    if web is None:
        rows, reserve = rows.withColumn("_web", F.lit("")), F.lit(0)
    else:
        rows = rows.join(web.select("query_id", F.col("web").alias("_web")), "query_id", "full_outer").withColumn("_web", F.coalesce("_web", F.lit("")))
        reserve = F.when(F.col("_web") != "", count_tokens(F.concat(F.lit(WEB_PREFIX), F.col("_web")))).otherwise(0)
    rows = rows.withColumn("_room", F.lit(max_tokens) - reserve).withColumn("_need", count_tokens(F.col("_full")) + F.when(F.col("_no") > 1, gap).otherwise(0))
    running = Window.partitionBy("query_id").orderBy("_no")
    rows = rows.withColumn("_used", F.sum("_need").over(running))
    over = F.when(F.col("_used") > F.col("_room"), F.col("_no"))
    rows = rows.withColumn("_stop", F.min(over).over(Window.partitionBy("query_id")))
    left = F.col("_room") - (F.col("_used") - F.col("_need")) - F.when(F.col("_no") > 1, gap).otherwise(0)
    budget = (left * 4 - F.length("_head") - 20).cast("int")
    cut = F.when((left >= 50) & (budget > 100), F.concat(F.col("_head"), F.substring(F.col("_body"), F.lit(1), budget), F.lit("...\n")))
    piece = F.when(F.col("_stop").isNull() | (F.col("_no") < F.col("_stop")), F.col("_full")).when(F.col("_no") == F.col("_stop"), cut)
    rows = rows.withColumn("_piece", piece).withColumn("_cut", (F.col("_no") == F.col("_stop")) & F.col("_piece").isNotNull())
    packed = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("_no", "_piece")))).alias("_all"),
        F.coalesce(F.max("_cut"), F.lit(False)).alias("is_truncated"), F.max("_web").alias("_web"),
    )
    local = F.array_join(F.transform("_all", lambda p: p["_piece"]), SEPARATOR)
    whole = F.when(F.col("_web") == "", local).when(local != "", F.concat(local, F.lit(WEB_PREFIX), F.col("_web"))).otherwise(F.concat(F.lit(WEB_PREFIX.lstrip()), F.col("_web")))
    return packed.select("query_id", whole.alias("context"), F.size("_all").alias("n_sources"), "is_truncated")


def format_sources(ranked: DataFrame, scores: tuple[str, ...] = ("score",)) -> DataFrame:
    """ranked with a 200-character preview and scores rounded to four places."""
    rounded = [F.round(s, 4).alias(s) for s in scores]
    others = [c for c in ranked.columns if c not in (*scores, "text")]
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return ranked.select(*others, preview.alias("content_preview"), *rounded)


#: Words that do not count in a query.
STOP_WORDS = (  # fixed values
    "the", "a", "an", "is", "are", "was", "were", "how", "what", "why", "do", "does", "to", "in", "for", "of", "and",
    "or",
)


def compress_extractive(query: Column, text: Column, max_sentences: int = 10) -> Column:
    """struct(text, ratio): the sentences that share most words with the query, in that order, ties in text order; those
    with a code block count 10, those that share none go. Nothing left gives the whole text."""
    code = r"```[\s\S]*?```"
    own = F.filter(F.array_distinct(tokens(query)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    mark = "{{CODE_BLOCK}}"
    blocks = F.regexp_extract_all(text, F.lit(code), F.lit(0))
    parts = F.split(F.regexp_replace(text, code, r"\{\{CODE_BLOCK\}\}"), r"(?<=[.!?])\s+")
    scored = F.transform(
        parts,
        lambda s, i: F.struct(
            (-F.when(s.contains(mark), 10).otherwise(F.size(F.array_intersect(own, tokens(s))))).alias("a"), i.alias("i"), s.alias("s")
        ),
    )
    picked = F.slice(F.array_sort(F.filter(scored, lambda x: x["a"] < 0)), 1, max_sentences)
    joined = F.array_join(F.transform(picked, lambda x: x["s"]), " ")
    # code blocks return in the order of the text
    pieces = F.split(joined, r"\{\{CODE_BLOCK\}\}", -1)
    filled = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i + 1 < F.size(pieces), F.coalesce(F.get(blocks, i), F.lit(mark))).otherwise(""))), "")
    out = F.when(F.trim(filled) != "", filled).otherwise(text)
    return F.struct(out.alias("text"), F.when(F.length(text) > 0, F.length(filled) / F.length(text)).otherwise(1.0).alias("ratio"))


def compress_chunks(ranked: DataFrame, max_sentences: int = 10, max_chunks: int = 5) -> DataFrame:
    """The first max_chunks rows of each query with their texts compressed; ranked has query, text and rank."""
    return ranked.filter(F.col("rank") <= max_chunks).withColumn("compressed", compress_extractive(F.col("query"), F.col("text"), max_sentences))


def context_hash(ranked: DataFrame) -> DataFrame:
    """(query_id, context_hash): MD5 of source and first 200 characters of the rows in order."""
    part = F.concat_ws(":", F.coalesce("source", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 200))
    gathered = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("_p"))
    return gathered.select("query_id", F.md5(F.array_join(F.transform("_p", lambda x: x["p"]), "|").cast("binary")).alias("context_hash"))


def _spread_pivots(units: np.ndarray, n: int) -> np.ndarray:
    """At most n unit vectors, each the farthest in angle from those before it."""
    chosen = [0]
    near = units @ units[0]
    while len(chosen) < min(n, len(units)) and near.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors, zeros after the shorter ones; zeros for those of length 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    m = np.zeros((len(sizes), width))
    m[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


def _nearest_pivot(pivots: np.ndarray):
    """Adds the nearest pivot of each entry and the angle to it."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            angles = _angles(_units(b.column("_e"), pivots.shape[1]), pivots)
            own = angles.argmin(axis=1) if len(angles) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], [*b.schema.names, "pivot", "angle"])

    return apply


def _pivots_in_reach(pivots: np.ndarray, radius: np.ndarray, reach: float):
    """Adds the pivots whose entries can lie within the angle `reach` of each query: those whose farthest entry is near
    enough, and that are not farther than the nearest pivot by more than twice the reach."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            angles = _angles(_units(b.column("embedding"), pivots.shape[1]), pivots)
            live = (angles <= reach + radius + 1e-6) & (angles <= angles.min(axis=1, keepdims=True) + 2 * reach + 1e-6)
            found = [np.flatnonzero(x).astype(np.int32) for x in live]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], [*b.schema.names, "pivot"])

    return apply


_CELL = ["context_hash", "size", "slot", "pivot", "part", "turn"]


def _best_in_cells(threshold: float, ttl: int, width: int, out: pa.Schema):
    """The best entry for each query in each cell of a bucket: highest similarity (12 digits), then oldest, then least id."""

    def apply(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return out.empty_table()
        held = held.sort_by([("_at", "ascending"), ("entry_id", "ascending")])
        cells = held.select(_CELL).to_pandas().groupby(_CELL, sort=False).indices
        wanted = asked.select(_CELL).to_pandas().groupby(_CELL, sort=False).indices
        entries, queries = _units(held.column("_e"), width), _units(asked.column("embedding"), width)
        since, until = (t.cast(pa.int64()).to_numpy() for t in (held.column("_at").cast(pa.timestamp("us", "UTC")), asked.column("ts").cast(pa.timestamp("us", "UTC"))))
        q_rows, e_rows, scores = [], [], []
        for cell, own in wanted.items():
            there = cells.get(cell)
            for at in range(0, len(own) if there is not None else 0, QUERY_BLOCK):
                some = own[at : at + QUERY_BLOCK]
                s = queries[some] @ entries[there].T
                age = until[some, None] // 1_000_000 - since[None, there] // 1_000_000
                s[(since[None, there] > until[some, None]) | (age > ttl) | (s < threshold)] = -np.inf
                first = np.round(s, 12).argmax(axis=1)  # of equals the first, in the order of times and ids
                hit = s[np.arange(len(some)), first] > -np.inf
                q_rows.append(some[hit])
                e_rows.append(there[first[hit]])
                scores.append(s[np.flatnonzero(hit), first[hit]])
        if not q_rows:
            return out.empty_table()
        q, e = pa.array(np.concatenate(q_rows)), pa.array(np.concatenate(e_rows))
        return pa.Table.from_arrays([asked.column("query_id").take(q), held.column("entry_id").take(e), held.column("_at").take(e), pa.array(np.concatenate(scores))], names=out.names).cast(out)

    return apply


def semantic_lookup(
    queries: DataFrame, cache: DataFrame, threshold: float = 0.92, ttl: int = 3600, pivots: int = PIVOTS, cell: int = CACHE_CELL
) -> DataFrame:
    """queries (query_id, context_hash, embedding, ts) with the best cached answer (entry_id, similarity) of equal context
    that has not expired and reaches the threshold; the oldest of equals. Nulls, vectors with a null or a component that is
    not finite, and vectors of different sizes are misses.

    Entries lie in cells of their context, their span of `ttl` seconds and their nearest pivot (a few vectors of a bounded
    sample, far from each other). A query meets two spans, and the pivots that the triangle inequality of angles leaves.
    A cell of more than `cell` entries or queries, such as that of all queries without a context, is cut into parts by
    hashes of their ids, and a task takes a bucket of about so many rows of any cells."""
    finite = lambda c: F.forall(F.col(c), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    span = max(1, ttl)
    held = cache.select("context_hash", "entry_id", F.col("embedding").cast("array<double>").alias("_e"), F.col("stored_at").cast("timestamp").alias("_at"))
    held = held.dropna().filter(finite("_e")).withColumn("size", F.size("_e")).withColumn("slot", F.floor(F.unix_timestamp("_at") / span))
    asked = queries.select("context_hash", "query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("ts").cast("timestamp").alias("ts"))
    asked = asked.dropna().filter(finite("embedding")).withColumn("size", F.size("embedding"))
    some = held.orderBy(F.xxhash64("entry_id", F.lit(3)), "entry_id").select("_e").limit(8 * pivots).collect()  # a bounded sample
    width = max(df.agg(F.max("size")).first()[0] or 0 for df in (held, asked))
    units = _units(pa.array([r["_e"] for r in some], pa.list_(pa.float64())), width) if some else np.zeros((0, 0))
    units = units[np.linalg.norm(units, axis=1) > 0]
    # without a positive threshold vectors of length 0 match too, and these have no angle
    chosen = _spread_pivots(units, pivots) if len(units) and threshold > 0 else np.zeros((1, width))
    kept = [f"{c} {held.schema[c].dataType.simpleString()}" for c in held.columns]
    held = checkpoint(held.mapInArrow(_nearest_pivot(chosen), f"{', '.join(kept)}, pivot int, angle double"))
    radius = np.full(len(chosen), -np.inf)
    for r in held.groupBy("pivot").agg(F.max("angle").alias("m"), F.count(F.lit(1)).alias("n")).collect():  # one row a pivot
        radius[r["pivot"]] = r["m"] if threshold > 0 else np.inf
    reach = float(np.arccos(np.clip(threshold, -1, 1)))
    sent = [f"{c} {asked.schema[c].dataType.simpleString()}" for c in asked.columns]
    asked = asked.mapInArrow(_pivots_in_reach(chosen, radius, reach), f"{', '.join(sent)}, pivot array<int>").withColumn("pivot", F.explode("pivot"))
    slots = F.array(*[F.floor(F.unix_timestamp("ts") / span) - i for i in (0, 1)])
    asked = checkpoint(asked.withColumn("slot", F.explode(slots)))
    where = ["context_hash", "size", "slot", "pivot"]

    def large(df: DataFrame, name: str) -> DataFrame:
        """The cells with more than `cell` rows: at most a row for so many rows."""
        return checkpoint(df.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(name)).filter(F.col(name) > 1))

    parts, turns = large(held, "parts"), large(asked, "turns")

    def cut(df: DataFrame) -> DataFrame:
        for x in (parts, turns):
            df = df.join(F.broadcast(x) if x.count() <= HELD_TERMS else x, where, "left")
        return df.fillna(1, ["parts", "turns"])

    rows = cut(held).withColumn("part", F.pmod(F.xxhash64("entry_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)")))
    calls = cut(asked).withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
    calls = calls.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    buckets = max(1, -(-(held.count() + asked.count()) // (2 * cell)))
    bucket = F.pmod(F.xxhash64(*_CELL), F.lit(buckets)).alias("bucket")
    rows = rows.select(bucket, *_CELL, "entry_id", "_e", "_at")
    calls = calls.select(bucket, *_CELL, "query_id", "embedding", "ts")
    kinds = {c: df.schema[c].dataType for df, c in ((asked, "query_id"), (held, "entry_id"), (held, "_at"))}
    kind = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", similarity double"
    out = to_arrow_schema(queries.sparkSession.createDataFrame([], kind).schema)
    met = calls.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(_best_in_cells(threshold, ttl, width, out), kind)
    best = met.groupBy("query_id").agg(F.min_by(F.struct("entry_id", "similarity"), F.struct(-F.round("similarity", 12), "_at", "entry_id")).alias("b"))
    return queries.join(best, "query_id", "left").select(*queries.columns, F.col("b.entry_id").alias("entry_id"), F.col("b.similarity").alias("similarity"))


def semantic_cache_stats(looked: DataFrame, cache: DataFrame, as_of: str, ttl: int = 3600) -> DataFrame:
    hits = F.count("entry_id")
    total = F.count(F.lit(1))
    out = looked.agg(
        hits.alias("hits"), (total - hits).alias("misses"), F.when(total > 0, F.round(hits / total, 4)).otherwise(0.0).alias("hit_rate"),
        F.round(F.avg("similarity"), 4).alias("avg_similarity"),
    )
    age = F.unix_timestamp(at(as_of)) - F.unix_timestamp("stored_at")
    return out.join(F.broadcast(cache.agg(F.count(F.lit(1)).alias("stores"), F.count_if(age > ttl).alias("evictions"))))


def cache_key(model: Column, text: Column) -> Column:
    return F.concat_ws(":", F.md5(model.cast("binary")), F.md5(text.cast("binary")))


def attach_embeddings(texts: DataFrame, store: DataFrame, as_of: str, ttl: int = 3600) -> DataFrame:
    """texts (text, model) with key, embedding and is_hit from a store (key, embedding, stored_at); expired rows do not
    count and the newest row of a key does."""
    live = store.filter((F.col("stored_at") <= at(as_of)) & (F.unix_timestamp(at(as_of)) - F.unix_timestamp("stored_at") <= ttl))
    newest = live.groupBy("key").agg(F.max_by("embedding", "stored_at").alias("embedding"))
    keyed = texts.withColumn("key", cache_key(F.col("model"), F.col("text")))
    return keyed.join(newest, "key", "left").withColumn("is_hit", F.col("embedding").isNotNull())


def embedding_misses(attached: DataFrame) -> DataFrame:
    """Each distinct text that must be encoded, once."""
    return attached.filter(~F.col("is_hit")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("wanted"))


def grade_filter(graded: DataFrame, threshold: float = 0.5, least: int = 2, max_retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows of at least the grade, best first; decision per query). graded: query_id, chunk_id, grade, retries; a missing
    grade is 0. Too few rows are a retry until the retries are used up."""
    g = graded.withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    kept = rank_by(g.filter(F.col("grade") >= threshold).drop("rank"), F.col("grade").desc(), F.col("chunk_id"))
    good = F.count_if(F.col("grade") >= threshold)
    decision = g.groupBy("query_id").agg(good.alias("kept"), (F.count(F.lit(1)) - good).alias("dropped"), F.max("retries").alias("_r"))
    act = F.when((F.col("kept") < least) & (F.coalesce("_r", F.lit(0)) < max_retries), "retry").otherwise("proceed")
    return kept, decision.withColumn("action", act).drop("_r")


def agent_trace_summary(traces: DataFrame) -> DataFrame:
    """traces (query_id, trace: array of struct(step, kept, dropped, action, n_queries, verified)) to counts."""
    return agent_steps_summary(traces.select("query_id", F.explode_outer("trace").alias("t")))


def agent_steps_summary(steps: DataFrame) -> DataFrame:
    """The same of steps (query_id, t: such a struct, or null) in rows of their own, however many a query has."""
    return steps.groupBy("query_id").agg(
        F.count("t").alias("steps"), F.coalesce(F.sum("t.n_queries"), F.lit(0)).alias("sub_queries"), F.coalesce(F.sum("t.kept"), F.lit(0)).alias("kept"),
        F.coalesce(F.sum("t.dropped"), F.lit(0)).alias("dropped"), F.count_if(F.col("t.action") == "retry").alias("retries"),
        F.coalesce(F.max("t.verified"), F.lit(False)).alias("verified"),
    )
