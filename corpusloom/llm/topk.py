"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are dealt to classes by quantiles of their length, and a class to as many buckets as it needs, so that copies and ties
spread. A bucket belongs to one task, which cuts it by falling length into runs of RUN vectors. Queries come in slabs.
First every query meets the bucket of the longest vectors, which gives it a lower bound of its k-th score. A bucket can
matter to a query only if the product of their lengths reaches that bound; only such queries are sent to it. Inside a
run the bound, divided by the query's and the run's lengths, is a local cosine threshold. Where it is low, vectors are
pruned by their own length; where it is high, by the partial product over the query's largest coordinates plus the
product of the remaining lengths. All that are left are verified by their whole product, and the bound rises with them.

A task holds one bucket and one slab, both of bounded size. A query is sent once to each bucket and a vector once to
each slab, so what is shuffled is buckets x queries + slabs x vectors, and never a matrix for every pair of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint

#: Bytes of a bucket or slab in a task (a component as a double), and the rows below which splitting doesn't pay.
TASK_BYTES, LEAST_ROWS = 64_000_000, 4096
RUN, FOCUS, CLASSES = 4096, 12, 64
#: Local cosine thresholds from which coordinates prune better than lengths do.
BY_COORDINATE = 0.35
#: Products below this are exact in doubles.
EXACT = 2.0**53


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component. Rows without a vector or an id, or with a null, infinite or
    not-a-number component, are left out; an empty vector has the product 0 with all."""
    x = F.col(f"`{embedding}`")
    inf = F.lit(float("inf"))
    good = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < inf), F.lit(False)))
    return vectors.filter(x.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & good).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long")).alias("v"),
    )


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > bound)
        ties = np.flatnonzero(scores == bound)
        need = k - len(over)
        if len(ties) > need:
            ties = ties[np.argpartition(ids[ties], need - 1)[:need]] if need else ties[:0]
        pick = np.concatenate([over, ties])
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((ids[pick], -scores[pick]))]


class Bucket:
    """A run of vectors of similar length, as whole numbers in doubles, or in 64-bit integers if products need them."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, whole: np.ndarray | None = None):
        self.ids, self.by_coordinate = ids, np.ascontiguousarray(matrix.T)
        self.matrix, self.whole = matrix, whole
        self.squares = (matrix * matrix).sum(axis=1)
        self.lengths = np.sqrt(self.squares)
        self.most = float(self.lengths.max())

    def search(self, query: int, q: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors with a score of at least bound, the query's own left out."""
        length = float(np.sqrt(q @ q))
        cosine = bound / (length * self.most) if length * self.most > 0 else (-1.0 if bound <= 0 else 2.0)
        if cosine > 1 + 1e-9:
            return self.ids[:0], self.squares[:0]
        if cosine >= BY_COORDINATE and len(q) > FOCUS:
            focus = np.argpartition(-np.abs(q), FOCUS)[:FOCUS]
            own = self.by_coordinate[focus]
            rest = np.sqrt(np.maximum(self.squares - (own * own).sum(axis=0), 0))
            left = np.sqrt(max(0.0, length * length - float(q[focus] @ q[focus])))
            live = np.flatnonzero(q[focus] @ own + rest * left >= bound - 1e-6 * max(1.0, abs(bound)))
        elif bound > 0:
            live = np.flatnonzero(self.lengths * length >= bound * (1 - 1e-9))
        else:
            live = np.arange(len(self.ids))
        live = live[self.ids[live] != query]
        if self.whole is None:
            scores = self.matrix[live] @ q  # whole numbers below 2 ** 53 are exact
        else:
            scores = self.whole[live] @ q.astype(np.int64)
        keep = scores >= bound
        live, scores = live[keep], scores[keep]
        top = best(scores, self.ids[live], k)
        return self.ids[live[top]], scores[top]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists as rows of a matrix, zeros after the shorter ones."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


_FOUND = "_query long, query_id long, q array<long>, ids array<long>, scores array<long>"
_FOUND_SCHEMA = pa.schema(
    [("_query", pa.int64()), ("query_id", pa.int64()), ("q", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))]
)


def _meet(k: int, width: int, most: float, run: int):
    def apply(key: tuple, asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _FOUND_SCHEMA.empty_table()
        ids, whole = held.column("vec_id").to_numpy(), _matrix(held.column("v"), width)
        exact = width * most * most < EXACT
        order = np.argsort(-(whole.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        runs = [
            Bucket(ids[own], whole[own].astype(np.float64), None if exact else whole[own])
            for own in (order[at : at + run] for at in range(0, len(order), run))
        ]
        queries, bounds = _matrix(asked.column("q"), width), asked.column("bound").to_numpy(zero_copy_only=False)
        found_ids, found_scores = [], []
        for query, q, bound in zip(asked.column("query_id").to_pylist(), queries.astype(np.float64), bounds.astype(np.float64), strict=True):
            own_ids, own_scores = ids[:0], whole[:0, 0] if width else ids[:0]
            bound = -np.inf if np.isnan(bound) else bound
            for bucket in runs:
                new_ids, new_scores = bucket.search(query, q, bound, k)
                if len(new_ids):
                    own_ids, own_scores = np.concatenate([own_ids, new_ids]), np.concatenate([own_scores, new_scores.astype(np.int64)])
                    top = best(own_scores, own_ids, k)
                    own_ids, own_scores = own_ids[top], own_scores[top]
                    if len(own_ids) == k:
                        bound = max(bound, float(own_scores[-1]))
            found_ids.append(own_ids)
            found_scores.append(own_scores)
        return pa.Table.from_arrays(
            [
                asked.column("_query"), asked.column("query_id"), asked.column("q").cast(pa.list_(pa.int64())),
                pa.array(found_ids, pa.list_(pa.int64())), pa.array(found_scores, pa.list_(pa.int64())),
            ],
            schema=_FOUND_SCHEMA,
        )

    return apply


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c))


class Layout:
    """Classes by falling length, their buckets, and the longest vector of each; a few numbers on the driver."""

    def __init__(self, vectors: DataFrame, task_bytes: int, least_rows: int, slots: int):
        sized = vectors.select(_length(F.col("v")).alias("n"), F.size("v").alias("w"), F.array_max(F.transform("v", lambda c: F.abs(c))).alias("m"))
        points = [i / CLASSES for i in range(1, CLASSES)]
        r = sized.agg(F.count(F.lit(1)), F.max("w"), F.max("m"), F.percentile_approx("n", points, 1000)).first()
        self.rows, self.width, self.most = r[0], max(0, r[1] or 0), float(r[2] or 0)
        by_memory = max(least_rows, task_bytes // (8 * max(1, self.width)))
        self.bucket_rows = max(min(by_memory, math.ceil(self.rows / slots)), min(least_rows, by_memory), 1)
        wanted = min(CLASSES, max(1, math.ceil(self.rows / self.bucket_rows)))
        self.bounds = sorted({r[3][round(i * CLASSES / wanted) - 1] for i in range(1, wanted)}, reverse=True) if self.rows else []
        found = vectors.select(_length(F.col("v")).alias("n")).groupBy(self.number(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("m"))
        sizes = {x["c"]: (x["k"], x["m"]) for x in found.collect()}  # at most CLASSES rows
        self.split, self.longest, self.first = [], [], [0]
        for c in range(len(self.bounds) + 1):
            rows, most = sizes.get(c, (0, 0.0))
            self.split.append(max(1, math.ceil(rows / self.bucket_rows)))
            self.longest.append(most)
            self.first.append(self.first[-1] + self.split[-1])

    def number(self, length: Column) -> Column:
        """The class of a length: so many bounds lie above it."""
        if not self.bounds:
            return F.lit(0)
        return F.size(F.filter(F.array(*map(F.lit, self.bounds)), lambda b: b > length))

    def bucket(self) -> Column:
        c = self.number(_length(F.col("v"))) + 1
        split = F.element_at(F.array(*map(F.lit, self.split)), c)
        return F.element_at(F.array(*map(F.lit, self.first)), c) + F.pmod(F.xxhash64("vec_id", F.lit(7)), split).cast("int")

    def reach(self, length: Column, bound: Column) -> Column:
        """So many of the buckets, in order, can hold a vector whose product with the query reaches the bound."""
        classes = F.size(F.filter(F.array(*map(F.lit, self.longest)), lambda m: m * length * (1 + 1e-9) >= bound))
        all_of_them = bound.isNull() | (bound <= 0)
        return F.when(all_of_them, F.lit(self.first[-1])).otherwise(F.element_at(F.array(*map(F.lit, self.first)), classes + 1))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, task_bytes: int = TASK_BYTES, least_rows: int = LEAST_ROWS, run: int = RUN
) -> DataFrame:
    """query_id, rank, vec_id, score for quantized vectors and queries (vec_id, v): each query's k highest products
    with vectors of another id, ties to smaller ids.

    All if there are fewer than k. Vectors of different sizes are compared as if the shorter ended in zeros. Repeated
    rows of vectors count each; a repeated query has its rows once for each time. Products up to 2^63 are exact. Other
    columns are not read. Empty tables give an empty table."""
    slots = 2 * queries.sparkSession.sparkContext.defaultParallelism
    layout = Layout(vectors, task_bytes, least_rows, slots)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    count, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    width = max(layout.width, wide or 0)
    slab_rows = max(least_rows, task_bytes // (8 * max(1, width)))
    slabs = max(1, math.ceil(count / slab_rows))
    meet = _meet(k, width, max(layout.most, 1.0), run)
    slab = F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(slabs)).cast("int")
    held = vectors.select("vec_id", "v", layout.bucket().alias("bucket"))
    held = held.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))

    def met(some: DataFrame, rows: DataFrame) -> DataFrame:
        keys = ("bucket", "slab")
        return some.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, _FOUND)

    unbound = asked.select(
        F.lit(0).cast("long").alias("_query"), "query_id", "q", F.lit(None).cast("double").alias("bound"), F.lit(0).alias("bucket"), slab.alias("slab")
    )
    first = checkpoint(met(unbound, held.filter("bucket = 0")).withColumn("_query", F.monotonically_increasing_id()))
    bound = F.when(F.size("scores") >= k, F.element_at("scores", k)).cast("double")
    rest = first.select("_query", "query_id", "q", bound.alias("bound")).withColumn("_reach", layout.reach(_length(F.col("q")), F.col("bound")))
    rest = rest.filter("_reach > 1").select(
        "_query", "query_id", "q", "bound", F.explode(F.expr("sequence(1, _reach - 1)")).alias("bucket"), slab.alias("slab")
    )
    found = first.select("_query", "query_id", "ids", "scores")
    if layout.first[-1] > 1:
        found = found.unionByName(met(rest, held.filter("bucket > 0")).select("_query", "query_id", "ids", "scores"))
    rows = found.select("_query", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "_query", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")
    )
    order = Window.partitionBy("_query").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
