"""Quality classifier: a small byte-level convolutional network in numpy.

A byte has a learned embedding; learned filters of KERNEL bytes run over the whole document at every STEP bytes.
Their rectified outputs are max-pooled over overlapping chunks of CHUNK bytes (every CHUNK / 2 bytes), a hidden layer
turns the pooled values of a chunk into one logit, and the mean, greatest and least logits of a document's chunks
are combined into one probability. Only text goes in.

Training takes at most TRAIN_ROWS labelled rows of each label (the bound of the sample), chosen by a hash of the id,
and from each at most TRAIN_CHUNKS chunks spread evenly over its text. The filters are fitted on the driver over these
bytes (about 12 MB at most). The last step, which combines a document's logits, is fitted on the same rows with all their
chunks, whose logits the executors compute as in scoring. Scoring runs in Arrow batches over all rows and whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import as_bytes, binary_column, carried

CHUNK, KERNEL, STEP, EMBED, FILTERS, HIDDEN = 256, 8, 2, 6, 24, 16
TRAIN_ROWS, TRAIN_CHUNKS = 2000, 6
EPOCHS, BATCH, RATE, SEED = 14, 128, 0.004, 11
#: Bytes convolved at a time.
SPAN = 1 << 16
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # KERNEL * EMBED x FILTERS
    bias: np.ndarray
    w1: np.ndarray  # FILTERS x HIDDEN
    b1: np.ndarray
    w2: np.ndarray  # HIDDEN
    b2: np.ndarray  # 1
    top: np.ndarray  # weights of mean, greatest and least logit, and a constant

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]


def new_network(rng: np.random.Generator) -> Network:
    def normal(*shape: int, by: float) -> np.ndarray:
        return (rng.standard_normal(shape) * by).astype(np.float32)

    return Network(
        normal(256, EMBED, by=0.5),
        normal(KERNEL * EMBED, FILTERS, by=(2 / (KERNEL * EMBED)) ** 0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, by=(2 / FILTERS) ** 0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, by=(1 / HIDDEN) ** 0.5),
        np.zeros(1, np.float32),
        np.array([1, 0, 0, 0], np.float32),
    )


def columns(raw: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """Embedded bytes under every place of a filter: (..., places, KERNEL * EMBED)."""
    x = embed[raw]
    flat = x.reshape(*x.shape[:-2], -1)
    return np.lib.stride_tricks.sliding_window_view(flat, KERNEL * EMBED, axis=-1)[..., :: STEP * EMBED, :]


def train_chunks(net: Network, raw: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """Adam on the weighted log loss of single chunks; raw: chunks x CHUNK bytes."""
    parts = net.parts()
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    t = 0
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(raw)), RATE * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(raw), BATCH):
            pick = order[at : at + BATCH]
            x, n = raw[pick], len(pick)
            cols = np.ascontiguousarray(columns(x, net.embed))
            out = np.maximum(cols @ net.filters + net.bias, 0)
            where = out.argmax(axis=1)
            pooled = np.take_along_axis(out, where[:, None, :], 1)[:, 0]
            hidden = np.maximum(pooled @ net.w1 + net.b1, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))
            d = ((p - y[pick]) * weight[pick] / n).astype(np.float32)
            g_w2, g_b2 = hidden.T @ d, d.sum(keepdims=True)
            dh = d[:, None] * net.w2 * (hidden > 0)
            g_w1, g_b1 = pooled.T @ dh, dh.sum(0)
            dp = (dh @ net.w1.T) * (pooled > 0)
            at_max = np.take_along_axis(cols[:, :, :], where[:, :, None], 1)  # n x FILTERS x KERNEL * EMBED
            g_f, g_b = np.einsum("nf,nfk->kf", dp, at_max), dp.sum(0)
            de = (dp[:, :, None] * net.filters.T[None]).reshape(n, FILTERS, KERNEL, EMBED)
            places = where[:, :, None] * STEP + np.arange(KERNEL)
            used = np.take_along_axis(x[:, None, :], places, 2) if places.ndim == 3 else x
            g_e = np.zeros_like(net.embed)
            np.add.at(g_e, used.ravel(), de.reshape(-1, EMBED))
            t += 1
            for k, g in enumerate((g_e, g_f, g_b, g_w1, g_b1, g_w2, g_b2)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                parts[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def spread_chunks(text: bytes, most: int) -> list[bytes]:
    """At most so many chunks of CHUNK bytes, evenly spread from the start to the end of a text."""
    padded = text.ljust(CHUNK, b"\0")
    n = min(most, -(-len(padded) // (CHUNK // 2)))
    last = len(padded) - CHUNK
    return [padded[a : a + CHUNK] for a in sorted({last * i // max(1, n - 1) for i in range(n)})]


def chunk_logits(net: Network, raw: np.ndarray) -> np.ndarray:
    """Logits of all overlapping chunks of a text, end to end; a short text is one padded chunk."""
    half = CHUNK // 2
    n = max(2, -(-len(raw) // half))
    padded = np.zeros(n * half + KERNEL - STEP, np.uint8)
    padded[: len(raw)] = raw
    pooled = np.empty((n, FILTERS), np.float32)
    per = max(1, SPAN // half)
    for at in range(0, n, per):
        to = min(n, at + per)
        span = padded[at * half : to * half + KERNEL - STEP]
        out = np.ascontiguousarray(columns(span, net.embed)) @ net.filters
        pooled[at:to] = out.reshape(to - at, half // STEP, FILTERS).max(axis=1)
    pooled = np.maximum(np.maximum(pooled[1:], pooled[:-1]) + net.bias, 0)
    return np.maximum(pooled @ net.w1 + net.b1, 0) @ net.w2 + net.b2


def summary(logits: np.ndarray) -> np.ndarray:
    return np.array([logits.mean(), logits.max(), logits.min(), 1.0])


def probability(net: Network, raw: np.ndarray) -> float:
    z = float(np.clip(summary(chunk_logits(net, raw)) @ net.top, -30, 30))
    return float(1 / (1 + np.exp(-z)))


def fit(texts: list[list[bytes]], labels: list[int]) -> Network | float:
    """A network from chunks of each training row and its label (0 or 1), not combined yet. With one label only, that
    label's constant; without rows, 0.5."""
    if len(set(labels)) < 2:
        return float(labels[0]) if labels else 0.5
    rng = np.random.default_rng(SEED)
    raw = np.frombuffer(b"".join(b for t in texts for b in t), np.uint8).reshape(-1, CHUNK)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    weight = (1 / np.sqrt(np.bincount(owner)))[owner]
    weight /= weight.mean()
    net = new_network(rng)
    train_chunks(net, raw, np.array(labels, np.float32)[owner], weight.astype(np.float32), rng)
    return net


def combine(net: Network, x: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> Network:
    """The network with weights for summaries x of rows with labels y: logistic regression, by Newton steps with a small
    ridge. shares: the labels' shares among all rows, which the probabilities follow."""
    row_weight = (np.array(shares) / np.array([np.mean(y == 0), np.mean(y == 1)]))[y.astype(int)]
    w, pull = np.zeros(4), np.eye(4) * 0.02 * len(x) / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (row_weight * (p - y)) + pull @ w
        h = (x * (row_weight * p * (1 - p))[:, None]).T @ x + pull + np.eye(4) * 1e-6
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    net.top = w.astype(np.float32)
    return net


def held_out(doc_id: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves a remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % parts == rest


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS
) -> Network | float:
    """A network from at most `rows` labelled rows of either label whose id is not held out. Null labels and ids, and
    labels without a document, take no part."""
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).filter(
        ~held_out("_id", 5, 0) & F.col("_id").isNotNull() & F.col("_y").isin(0, 1)
    )
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    picked = [
        known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(rows) for y in (0, 1)
    ]  # the bound that makes the broadcast safe
    chosen = picked[0].unionByName(picked[1])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            chunks = [b"".join(spread_chunks(t.as_py(), TRAIN_CHUNKS)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chunks, pa.binary())], ["id", "y", "chunks"])

    used = (
        docs.select(F.col(f"`{doc_id}`").alias("_id"), as_bytes(f"`{text}`").alias("_bytes"))
        .join(F.broadcast(chosen), "_id")
        .select(F.col("_id").cast("string"), "_y", "_bytes")
    )
    found = used.mapInArrow(cut, "id string, y int, chunks binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], r["chunks"]))
    pieces = [[c[a : a + CHUNK] for a in range(0, len(c), CHUNK)] for c in (r["chunks"] for r in found)]
    net = fit(pieces, [r["y"] for r in found])
    if isinstance(net, float):
        return net
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def summaries(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw, at = binary_column(b.column(2))
            x = [summary(chunk_logits(sent.value, raw[at[i] : at[i + 1]])).tolist() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    rows_x = used.mapInArrow(summaries, "id string, y int, x array<double>").toArrow().to_pylist()
    rows_x.sort(key=lambda r: (r["id"], r["x"]))
    total = sum(counts.values())
    shares = (counts.get(0, 0) / total, counts.get(1, 0) / total)
    return combine(net, np.array([r["x"] for r in rows_x]), np.array([r["y"] for r in rows_x], np.float64), shares)


def score(docs: DataFrame, net: Network | float, text: str = "text") -> DataFrame:
    """docs with _score: the probability of label 1.

    Null and empty texts are scored as one chunk of padding. Every row gives one row; other columns pass through,
    whatever their names, but for one named _score, which is replaced; an empty table gives an empty table. A constant in
    place of a network is every row's score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in it:
            raw, at = binary_column(b.column(1))
            scores = [
                model if isinstance(model, float) else probability(model, raw[at[i] : at[i + 1]]) for i in range(b.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["row", "_score"])

    held = docs.select(carried(docs, "_score"), as_bytes(f"`{text}`").alias("bytes"))
    return held.mapInArrow(apply, StructType([held.schema["row"]]).add("_score", "double")).select("row.*", "_score")
