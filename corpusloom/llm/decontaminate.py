"""Benchmark decontamination by winnowed word fingerprints.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is WINDOW consecutive
words of an item; an item of fewer words is one window. Of every WINDOW - K + 1 consecutive K-grams the one with
the least hash is a fingerprint, on both sides alike, so every shared span of WINDOW words holds at least one shared
fingerprint. A document's fingerprints are joined with those of the items, hits are extended to whole windows, and
the windows' bytes are compared. Items shorter than a window are winnowed with K = their own length.

The item index is sent to all executors only if the benchmark's text is within a byte bound that is checked first;
beyond it, fingerprints are joined by a shuffle and only the documents with a joined fingerprint are extended, against
the items joined to them."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from corpusloom.llm.common import as_bytes, binary_column, carried, mix64

WINDOW, K = 13, 5
#: Of benchmark text; the index takes about 20 times as much.
BROADCAST_BYTES = 8_000_000

_CLASS = np.zeros(256, bool)
_CLASS[0x30:0x3A] = _CLASS[0x61:0x7B] = _CLASS[0x41:0x5B] = True
_CLASS[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TABLE = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD1342543DE82EF95)


_KEPT: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64; kept up to the longest so far asked for (64 KB at least)."""
    have = _KEPT.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 8192), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 20:
            _KEPT[int(base)] = have
    return have[:n]


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, hashes) of the words in some bytes."""
    low = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _CLASS[low]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[low] * powers(_BASE, len(raw)), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * powers(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
    return low, starts, ends, hashes


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _GRAM + hashes[i : i + n]
    return mix64(out)


def _sliding(values: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over every w consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def winnow(values: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value (all of equal ones) of some w consecutive values, or of all if fewer."""
    n = len(values)
    if n == 0 or w <= 1:
        return np.arange(n)
    w = min(w, n)
    least = _sliding(values, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, values.dtype), least, np.zeros(w - 1, values.dtype)])
    return np.flatnonzero(values == _sliding(padded, w, np.maximum))


class ItemIndex:
    """Windows of benchmark items by fingerprint. items: (item_id, text bytes) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        # by window length: fingerprint hash, and the windows themselves: hash -> [(item ids, window bytes)]
        self.prints: dict[int, np.ndarray] = {}
        self.windows: dict[int, np.ndarray] = {}
        self.exact: dict[int, dict[bytes, set[str]]] = {}
        prints, exact = defaultdict(set), defaultdict(lambda: defaultdict(set))
        for item, text in items:
            low, starts, ends, hashes = words_of(np.frombuffer(text, np.uint8))
            n = len(starts)
            if not n:
                continue
            size = min(n, window)
            words = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            g = grams(hashes, min(k, size))
            prints[size].update(g[winnow(g, size - min(k, size) + 1)].tolist())
            for i in range(n - size + 1):
                exact[size][b" ".join(words[i : i + size])].add(item)
        for size, found in prints.items():
            self.prints[size] = np.sort(np.array(list(found), np.uint64))
            self.exact[size] = dict(exact[size])
            self.windows[size] = np.sort(
                np.array([_window_hash(key) for key in exact[size]], np.uint64)
            )

    def gram(self, size: int) -> int:
        return min(self.k, size)


def _window_hash(key: bytes) -> int:
    hashes = words_of(np.frombuffer(key, np.uint8))[3]
    return int(grams(hashes, len(hashes))[0])


def member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def document_prints(hashes: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of a document's fingerprints for windows of some length."""
    g = grams(hashes, min(k, size))
    at = winnow(g, size - min(k, size) + 1) if len(hashes) >= size else np.zeros(0, np.int64)
    return g[at], at


def hits(raw: np.ndarray, index: ItemIndex) -> tuple[int, int, list[str]]:
    """(words, hit words, ids of the items with occurring windows) of one document."""
    low, starts, ends, hashes = words_of(raw)
    n = len(starts)
    hit, found = None, set()
    for size, prints in index.prints.items():
        if n < size:
            continue
        h, at = document_prints(hashes, size, index.k)
        at = at[member(prints, h)]
        if not len(at):
            continue
        # a window that holds the fingerprint starts up to size - k words before it
        reach = np.unique((at[:, None] - np.arange(size - index.gram(size) + 1)[None, :]).ravel())
        reach = reach[(reach >= 0) & (reach <= n - size)]
        spans = hashes[reach[:, None] + np.arange(size)[None, :]]
        full = np.zeros(len(reach), np.uint64)
        for i in range(size):
            full = full * _GRAM + spans[:, i]
        for p in reach[member(index.windows[size], mix64(full))].tolist():
            key = b" ".join(low[a:b].tobytes() for a, b in zip(starts[p : p + size], ends[p : p + size], strict=True))
            items = index.exact[size].get(key)
            if items:
                if hit is None:
                    hit = np.zeros(n, bool)
                hit[p : p + size] = True
                found |= items
    return n, 0 if hit is None else int(hit.sum()), sorted(found)


def _results(rows: list[tuple[int, int, list[str]]]) -> list[pa.Array]:
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.list_(pa.string())),
    ]


#: Parts that a fingerprint is dealt to where it is joined, since one passage may be in many documents.
SALT = 16


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs with _n_words, _n_hit (words inside any occurrence of an item's window) and _items (their ids as
    strings, sorted).

    Null and empty texts have no words and no hits; items with no words have no window; items with a null id take
    part as the id "null". Equal items count once per id. Every row of docs gives one row, repeated rows too. Empty
    tables on either side give rows without hits, or no rows. Other columns pass through, whatever their names; one
    named like an output is replaced by it."""
    spark, new = docs.sparkSession, ["_n_words", "_n_hit", "_items"]
    held = docs.select(carried(docs, *new), as_bytes(f"`{text}`").alias("bytes"))
    schema = StructType([held.schema["row"]]).add(new[0], "long").add(new[1], "long").add(new[2], ArrayType(StringType()))
    test = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), as_bytes(f"`{item_text}`").alias("words")
    ).distinct()
    size = test.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size <= broadcast_bytes:
        index = ItemIndex([(r["item"], bytes(r["words"])) for r in test.collect()])
        sent = spark.sparkContext.broadcast(index)

        def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                raw, at = binary_column(b.column(1))
                rows = [hits(raw[at[i] : at[i + 1]], sent.value) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), *_results(rows)], ["row", *new])

        return held.mapInArrow(apply, schema).select("row.*", *new)

    # beyond the bound: fingerprints joined by a shuffle, and hits extended against the joined items only
    key = [F.xxhash64("bytes").alias("hash"), F.octet_length("bytes").alias("length")]

    def item_prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for item, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for n, found in ItemIndex([(item, words)]).prints.items():
                    rows += [(x, n, item) for x in found.astype(np.int64).tolist()]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("p", "n", "item"), r, strict=True)) for r in rows],
                pa.schema([("p", pa.int64()), ("n", pa.int32()), ("item", pa.string())]),
            )

    prints = test.mapInArrow(item_prints, "p long, n int, item string")
    used = sorted(r["n"] for r in prints.select("n").distinct().collect())  # 13 at most

    def doc_prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h, ln, p, n = [], [], [], []
            for th, tl, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hashes = words_of(np.frombuffer(t, np.uint8))[3]
                for size in used:
                    own = np.unique(document_prints(hashes, size, K)[0]).astype(np.int64)
                    p += own.tolist()
                    n += [size] * len(own)
                    h += [th] * len(own)
                    ln += [tl] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(ln, pa.int32()), pa.array(p, pa.int64()), pa.array(n, pa.int32())],
                ["hash", "length", "p", "n"],
            )

    salted = prints.distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = (
        held.select(*key, "bytes")
        .mapInArrow(doc_prints, "hash long, length int, p long, n int")
        .withColumn("salt", F.pmod("hash", F.lit(SALT)).cast("int"))
        .join(salted, ["p", "n", "salt"])
        .select("hash", "length", "item")
        .distinct()
        .join(test, "item")
        .groupBy("hash", "length")
        .agg(F.collect_list(F.struct("item", "words")).alias("joined"))
    )

    def extend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw, at = binary_column(b.column(1))
            rows = []
            for i, own in enumerate(b.column(2).to_pylist()):
                index = ItemIndex([(x["item"], x["words"]) for x in own or []])
                rows.append(hits(raw[at[i] : at[i + 1]], index))
            yield pa.RecordBatch.from_arrays([b.column(0), *_results(rows)], ["row", *new])

    return held.select("*", *key).join(joined, ["hash", "length"], "left").select("row", "bytes", "joined").mapInArrow(extend, schema).select("row.*", *new)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
