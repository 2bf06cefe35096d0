"""Hard negatives from a GNAT-style multiway hyperplane tree.

Scores are inner products. Every vector gets one more coordinate, which fills all lengths up to the greatest (an anchor gets 0
there); then a product falls strictly with the distance, and a window of scores is an annulus around the anchor.

The tree's split points come from a bounded sample (TREE_ROWS rows). A vector goes, at every level, to the nearest split
point, across the hyperplanes between them. Each split point keeps the range of its distances to all vectors of every
sibling subtree, taken over all rows by grouped minima and maxima. An anchor at distance d from a split point, with an
annulus from r1 to r2, can find something only in subtrees whose range meets [max(r1 - d, d - r2), d + r2]; others
are eliminated for it, level by level. Leaves are exact: all their products are taken in whole numbers.

A leaf is cut into parts of bounded size by a hash of the id, so that copies and crowded leaves spread; a task holds one
part and one slab of anchors. Each search goes first to the anchor's own leaf, whose k-th best score narrows the annulus, and
then to the leaves that the ranges leave. First positives are searched (score at least the bound), then, for all
positives of an anchor at once, the negatives within their windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpoint
from corpusloom.llm.topk import EXACT, _matrix, best

#: Rows that the split points are chosen from, split points of a node, levels of split points, candidates for each split point.
TREE_ROWS, FAN, LEVELS, TRIES = 4096, 8, 3, 4
#: Bytes of a part of a leaf or a slab of anchors in a task (a component as a double), and rows below which splitting doesn't pay.
TASK_BYTES, LEAST_ROWS = 64_000_000, 512
#: Rows of the table that a leaf is about to have; anchors whose products are taken at once.
LEAF_ROWS, TOGETHER = 2048, 64
#: Distances are compared with this much room for each unit of length, as they are rounded; leaves decide in whole numbers.
ROOM = 1e-6


def distances(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all points."""
    d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(d, 0))


class Tree:
    """Nodes by number: split points (with the filling coordinate), and the child that each of them leads to: a node,
    or a leaf as -1 - its number. `low` and `high` are set from all rows by `ranges`."""

    def __init__(self, sample: np.ndarray, fan: int, levels: int, leaf: int):
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        self._grow(sample, fan, levels, leaf)

    def _grow(self, rows: np.ndarray, fan: int, levels: int, leaf: int) -> int:
        points = self._spread(rows, fan) if levels and len(rows) > leaf else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        own, number = np.argmin(distances(points, rows), axis=1), len(self.points)
        self.points.append(points)
        self.children.append([])
        self.children[number] = [self._grow(rows[own == i], fan, levels - 1, leaf) for i in range(len(points))]
        return number

    @staticmethod
    def _spread(rows: np.ndarray, fan: int) -> np.ndarray:
        """Different rows, each the farthest of a few times as many candidates from those chosen before it."""
        some = np.unique(rows[:: max(1, len(rows) // (TRIES * fan))], axis=0)
        chosen = [0]
        gap = distances(some[:1], some)[:, 0]
        while len(chosen) < min(fan, len(some)):
            chosen.append(int(np.argmax(gap)))
            if gap[chosen[-1]] <= 0:
                return some[chosen[:-1]]
            gap = np.minimum(gap, distances(some[chosen[-1:]], some)[:, 0])
        return some[chosen]

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """The leaf of every row of x, and for every node met: its number, the rows there, their distances, their child."""
        leaf, met = np.zeros(len(x), np.int64), []
        waiting = [(0, np.arange(len(x)))] if self.points else []
        while waiting:
            node, rows = waiting.pop()
            d = distances(self.points[node], x[rows])
            own = np.argmin(d, axis=1)
            met.append((node, rows, d, own))
            for i, child in enumerate(self.children[node]):
                there = rows[own == i]
                if child < 0:
                    leaf[there] = -1 - child
                elif len(there):
                    waiting.append((child, there))
        return leaf, met

    def ranges(self, rows: list) -> None:
        """Takes (node, split point, sibling, least, greatest distance) of all rows of the table."""
        for number, points in enumerate(self.points):
            self.low[number] = np.full((len(points), len(points)), np.inf)
            self.high[number] = np.full((len(points), len(points)), -np.inf)
        for node, point, sibling, low, high in rows:
            self.low[node][point, sibling], self.high[node][point, sibling] = low, high

    def reach(self, x: np.ndarray, near: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        """The leaves that, by the ranges, can hold something between near and far from each row of x."""
        found = np.zeros((len(x), max(1, self.leaves)), bool)
        if not self.points:
            found[:] = True
        waiting = [(0, np.arange(len(x)))] if self.points else []
        while waiting:
            node, rows = waiting.pop()
            d = distances(self.points[node], x[rows])
            room = ROOM * (1 + d + np.abs(x).max(initial=0) * x.shape[1])
            inner = np.maximum(near[rows, None] - d, d - far[rows, None]) - room
            outer = d + far[rows, None] + room
            # alive: rows x siblings, if all split points' ranges meet the annulus
            alive = ((self.low[node][None] <= outer[:, :, None]) & (self.high[node][None] >= inner[:, :, None])).all(axis=1)
            for i, child in enumerate(self.children[node]):
                there = rows[alive[:, i]]
                if child < 0:
                    found[there, -1 - child] = True
                elif len(there):
                    waiting.append((child, there))
        return [np.flatnonzero(f) for f in found]


def _filled(whole: np.ndarray, square: float, anchor: bool) -> np.ndarray:
    """Vectors with the coordinate that brings all to one length; that of anchors is 0."""
    x = whole.astype(np.float64)
    rest = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _placed(tree: Tree, width: int, square: float):
    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            leaf, _ = tree.descend(_filled(_matrix(pa.chunked_array([b.column("v")]), width), square, False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    return apply


_RANGES = ["node", "point", "sibling", "low", "high", "n"]


def _ranges(tree: Tree, width: int, square: float):
    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            leaf, met = tree.descend(_filled(_matrix(pa.chunked_array([b.column("v")]), width), square, False))
            rows = []
            for node, _, d, own in met:
                for sibling in np.unique(own).tolist():
                    part = d[own == sibling]
                    rows += [(node, p, sibling, float(lo), float(hi), 0) for p, (lo, hi) in enumerate(zip(part.min(axis=0), part.max(axis=0), strict=True))]
            rows += [(-1, -1, int(i), 0.0, 0.0, int(n)) for i, n in zip(*np.unique(leaf, return_counts=True), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], _RANGES) if rows else pa.RecordBatch.from_pylist([], _RANGE_SCHEMA)

    return apply


_RANGE_SCHEMA = pa.schema([("node", pa.int64()), ("point", pa.int64()), ("sibling", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64())])


def _reached(tree: Tree, width: int, square: float):
    """Adds the leaves that an anchor's windows (arrays low, high of scores; null: open) can find something in."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lows, highs = b.column("low").to_pylist(), b.column("high").to_pylist()
            n = np.array([len(w) for w in lows], np.int64)
            x = _filled(_matrix(pa.chunked_array([b.column("q")]), width), square, True)
            x = np.repeat(x, n, axis=0)  # one row for each window
            flat = (x * x).sum(axis=1) + square
            low = np.array([-np.inf if v is None else v for w in lows for v in w], np.float64)
            high = np.array([np.inf if v is None else v for w in highs for v in w], np.float64)
            some = np.where(low <= high, 1.0, np.nan)  # an empty window finds nothing
            far = np.sqrt(np.maximum(flat - 2 * low, 0))
            near = np.sqrt(np.maximum(flat - 2 * high, 0)) * some
            leaves = tree.reach(x, near, far) if len(x) else []
            ends = np.cumsum(n)
            own = [np.unique(np.concatenate(leaves[e - k : e])) if k else np.zeros(0, np.int64) for k, e in zip(n, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.int64()))], [*b.schema.names, "leaves"])

    return apply


_FOUND = "_anchor long, window int, ids array<long>, scores array<long>"
_FOUND_SCHEMA = pa.schema([("_anchor", pa.int64()), ("window", pa.int32()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])


def _meet(k: int, width: int, most: float, same: bool):
    """The k best rows of a part within each window of each anchor of a slab, of the anchor's label or of the others."""

    def apply(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _FOUND_SCHEMA.empty_table()
        ids, labels, whole = held.column("vec_id").to_numpy(), held.column("label").to_numpy(), _matrix(held.column("v"), width)
        matrix = whole.astype(np.float64) if width * most * most < EXACT else whole
        queries = _matrix(asked.column("q"), width)
        anchors, names, own = asked.column("_anchor").to_pylist(), asked.column("anchor_id").to_pylist(), asked.column("anchor_label").to_pylist()
        lows, highs = asked.column("low").to_pylist(), asked.column("high").to_pylist()
        out = []
        for at in range(0, len(queries), TOGETHER):
            products = (queries[at : at + TOGETHER].astype(matrix.dtype) @ matrix.T).astype(np.int64)
            for i, scores in enumerate(products, start=at):
                live = ((labels == own[i]) == same) & (ids != names[i])
                if None not in lows[i]:
                    live &= scores >= min(lows[i], default=0)
                live = np.flatnonzero(live)
                if None in lows[i]:  # the k best of all
                    live = live[best(scores[live], ids[live], k)]
                else:
                    live = live[np.lexsort((ids[live], -scores[live]))]
                falling = -scores[live]
                for window, (low, high) in enumerate(zip(lows[i], highs[i], strict=True)):
                    first = 0 if high is None else int(np.searchsorted(falling, -high, side="left"))
                    end = len(live) if low is None else int(np.searchsorted(falling, -low, side="right"))
                    top = live[first : min(end, first + k)]
                    if len(top):
                        out.append((anchors[i], window, ids[top], scores[top]))
        if not out:
            return _FOUND_SCHEMA.empty_table()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOUND_SCHEMA.types, strict=True)], schema=_FOUND_SCHEMA)

    return apply


class Index:
    """The tree over labelled vectors (vec_id, label, v), their leaves and the parts of each; written once."""

    def __init__(self, vectors: DataFrame, widest: int, tree_rows: int, fan: int, levels: int, leaf_rows: int, task_bytes: int, least_rows: int):
        square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
        stats = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
        rows, self.width = stats[0], max(widest, stats[1] or 0)
        self.square, self.most = float(stats[2] or 0) * (1 + 1e-9), float(stats[3] or 0)
        order = [F.xxhash64("vec_id", F.lit(5)), "vec_id", "label"]
        picked = [r["v"] for r in vectors.orderBy(*order).select("v").limit(tree_rows).collect()]  # at most tree_rows
        sample = _matrix(pa.chunked_array([pa.array(picked, pa.list_(pa.int64()))]), self.width)
        self.tree = Tree(_filled(sample, self.square, False), fan, levels, math.ceil(leaf_rows * len(sample) / max(1, rows)))
        spec = (self.tree, self.width, self.square)
        found = vectors.mapInArrow(_ranges(*spec), "node long, point long, sibling long, low double, high double, n long")
        grouped = found.groupBy("node", "point", "sibling").agg(F.min("low"), F.max("high"), F.sum("n")).collect()  # by nodes of the tree
        self.tree.ranges([tuple(r)[:5] for r in grouped if r["node"] >= 0])
        sizes = {r["sibling"]: r[5] for r in grouped if r["node"] < 0}
        by_memory = max(least_rows, task_bytes // (8 * max(1, self.width)))
        self.part_rows = max(1, min(by_memory, max(least_rows, math.ceil(rows / (2 * vectors.sparkSession.sparkContext.defaultParallelism)))))
        self.slab_rows = by_memory
        self.parts = [max(1, math.ceil(sizes.get(i, 0) / self.part_rows)) for i in range(max(1, self.tree.leaves))]
        self.spec = spec
        part = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.element_at(F.array(*map(F.lit, self.parts)), (F.col("leaf") + 1).cast("int"))).cast("int")
        self.held = checkpoint(vectors.mapInArrow(_placed(*spec), "vec_id long, label long, v array<long>, leaf long").withColumn("part", part))

    def search(self, asked: DataFrame, slabs: int, k: int, same: bool) -> DataFrame:
        """_anchor, window, ids, scores: the k best of each leaf part asked (its leaves in the column `leaves`)."""
        slab = F.pmod(F.xxhash64("_anchor", F.lit(11)), F.lit(slabs)).cast("int").alias("slab")
        parts = F.element_at(F.array(*map(F.lit, self.parts)), (F.col("leaf") + 1).cast("int"))
        sent = asked.select("_anchor", "anchor_id", "anchor_label", "q", "low", "high", slab, F.explode("leaves").alias("leaf"))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = self.held.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
        keys = ("leaf", "part", "slab")
        meet = _meet(k, self.width, max(self.most, 1.0), same)
        return sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, _FOUND)

    def reached(self, asked: DataFrame) -> DataFrame:
        kind = "_anchor long, anchor_id long, anchor_label long, q array<long>, leaf long, low array<long>, high array<long>"
        return asked.select(*[c.split()[0] for c in kind.split(", ")]).mapInArrow(_reached(*self.spec), f"{kind}, leaves array<long>")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """_anchor, window, place (from 1), vec_id, score: the k best of all parts."""
    rows = found.select("_anchor", "window", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    rows = rows.select("_anchor", "window", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("_anchor", "window").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def labelled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of every component. Rows without an id, a label or a vector, or with a null,
    infinite or not-a-number component, are left out."""
    x, name, group = F.col(f"`{embedding}`"), F.col(f"`{vec_id}`"), F.col(f"`{label}`")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(name.isNotNull() & group.isNotNull() & x.isNotNull() & finite).select(
        name.cast("long").alias("vec_id"), group.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long")).alias("v")
    )


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    tree_rows: int = TREE_ROWS, fan: int = FAN, levels: int = LEVELS, leaf_rows: int = LEAF_ROWS, task_bytes: int = TASK_BYTES, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for anchors and vectors (vec_id, label, v).

    Positives are an anchor's `positives` highest products with vectors of the same label and another id; for each of them
    come the `negatives` highest products with vectors of another label that lie between low and high hundredths of
    the positive's, both included, ties to smaller ids; all, if there are fewer. A positive whose window holds nothing
    (one with a negative score, for instance) has no rows. Vectors of different sizes are compared as if the shorter
    ended in zeros. Repeated rows of vectors count each, and a repeated anchor has its rows once for each time. Other
    columns are not read. Empty tables give an empty table. Only the tree and its ranges come to the driver; they are
    bounded by tree_rows, fan and levels."""
    asked = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("q"))
    count, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    index = Index(vectors, wide or 0, tree_rows, fan, levels, leaf_rows, task_bytes, least_rows)
    slabs = max(1, math.ceil(count / index.slab_rows))
    tree, width, square = index.spec

    def with_leaf(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            leaf, _ = tree.descend(_filled(_matrix(pa.chunked_array([b.column("q")]), width), square, False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    placed = asked.mapInArrow(with_leaf, "anchor_id long, anchor_label long, q array<long>, leaf long")
    placed = checkpoint(placed.withColumn("_anchor", F.monotonically_increasing_id()))
    open_end = F.array(F.lit(None).cast("long"))

    def both(windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best of every window: first in the anchors' own leaves, then wherever the narrowed annuli reach."""
        own = checkpoint(_ranked(index.search(windows.withColumn("leaves", F.array("leaf")), slabs, k, same), k))
        full = own.filter(F.col("place") == k).groupBy("_anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        # an anchor has at most `positives` windows, so kth is small
        narrow = windows.join(full, "_anchor", "left").withColumn(
            "low", F.transform("low", lambda x, i: F.greatest(x, F.get(F.transform(F.array(F.col("kth")), lambda m: m[i.cast("int")]), 0)))
        )
        rest = index.reached(narrow).withColumn("leaves", F.array_except("leaves", F.array("leaf")))
        found = index.search(rest.filter(F.size("leaves") > 0), slabs, k, same)
        first = own.groupBy("_anchor", "window").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("x"))
        first = first.select("_anchor", "window", F.col("x.vec_id").alias("ids"), F.col("x.score").alias("scores"))
        return _ranked(found.unionByName(first), k)

    near = checkpoint(both(placed.withColumn("low", open_end).withColumn("high", open_end), positives, True))
    windows = near.withColumn("low", _ceil_div("score", low)).withColumn("high", _floor_div("score", high))
    bounds = F.struct("place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "low", "high")
    windows = windows.groupBy("_anchor").agg(F.sort_array(F.collect_list(bounds)).alias("x"))  # at most `positives` each
    windows = checkpoint(placed.join(windows, "_anchor").withColumn("low", F.col("x.low")).withColumn("high", F.col("x.high")))
    hard = both(windows.drop("x"), negatives, False)
    out = hard.join(windows.select("_anchor", "anchor_id", "x"), "_anchor").withColumn("p", F.get("x", F.col("window")))
    return out.select(
        "anchor_id", F.col("p.positive_id"), F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("p.positive_score"), F.col("score").alias("negative_score"),
    )


def _floor_div(score: str, hundredths: int):
    """The greatest whole number whose hundredfold is at most hundredths * score."""
    product = F.col(score).cast("decimal(38,0)") * F.lit(hundredths)
    return F.floor(product / F.lit(100)).cast("long")


def _ceil_div(score: str, hundredths: int):
    product = F.col(score).cast("decimal(38,0)") * F.lit(hundredths)
    return F.ceil(product / F.lit(100)).cast("long")
