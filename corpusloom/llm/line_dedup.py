"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

A run is a table (key, n), sorted by key: a line key's 64-bit hash, and in how many documents of some batches it
occurs. Batches add runs at level 0. Once a level holds `fanout` runs they are
merged into one run of the next level, so a key is rewritten once per level. A new batch is anti-joined with the
keys that the runs already show to be common: these need no more counting. Texts are read and hashed once, into a table
of (batch, key, n) that is summed within each task, so that a line of every document costs one row per task and batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import SPACE, as_bytes, carried, new_path

#: At most so many common keys are sent to all executors (8 bytes each); beyond it they are joined.
BROADCAST_KEYS = 500_000
#: Parts that a key is dealt to where it is joined, since one line may be in every document.
SALT = 16


def line_keys(text: bytes) -> list[bytes]:
    """Key of every line: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(SPACE).lower() for line in text.split(b"\n")]


def key_hash(key: bytes) -> int:
    """Signed 64-bit hash of a key."""
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


_COUNTS = "batch int, key long, n long"


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, key, n) from columns batch and text."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for key in {key_hash(k) for k in line_keys(text.as_py()) if k}:
                seen[number, key] = seen.get((number, key), 0) + 1
        if len(seen) > 200_000:
            yield _counted(seen)
            seen = {}
    if seen:
        yield _counted(seen)


def _counted(seen: dict[tuple[int, int], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in seen], pa.int32()), pa.array([k for _, k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())],
        ["batch", "key", "n"],
    )


class LineRuns:
    """Levelled runs in a shared folder. `levels` holds the paths of the live runs."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2, path: str | None = None):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs is at least 1, fanout at least 2")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or new_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> None:
        at = f"{self.path}/run-{self.written}-level-{level}"
        self.written += 1
        run.sortWithinPartitions("key").write.parquet(at)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(at)

    def merged(self) -> DataFrame | None:
        """Total (key, n) over the live runs; None before the first batch."""
        live = [p for level in self.levels for p in level]
        if not live:
            return None
        return self.spark.read.parquet(*live).groupBy("key").agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame | None:
        """Keys that at least min_docs documents hold."""
        total = self.merged()
        return None if total is None else total.filter(F.col("n") >= self.min_docs).select("key")

    def add(self, texts: DataFrame) -> None:
        """Adds one batch: a table with one binary column, the whole texts."""
        self.add_counts(texts.select(F.lit(0).alias("batch"), F.col(texts.columns[0]).alias("text")).mapInArrow(_count_lines, _COUNTS))

    def add_counts(self, counts: DataFrame) -> None:
        """Adds one batch: keys, and in how many documents of it they are; a key may have several rows."""
        counts = counts.groupBy("key").agg(F.sum("n").alias("n"))
        known = self.common()
        if known is not None:
            counts = counts.join(known, "key", "left_anti")
        self._write(counts, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            runs = self.levels[level]
            whole = self.spark.read.parquet(*runs).groupBy("key").agg(F.sum("n").alias("n"))
            self._write(whole, level + 1)
            self.levels[level] = []
            level += 1


def line_runs(docs: DataFrame, text: str = "text", batch_key: str = "doc_id", min_docs: int = 10, batches: int = 4) -> LineRuns:
    """Runs over all of docs, added in batches dealt by a hash of batch_key."""
    spark = docs.sparkSession
    runs, at = LineRuns(spark, min_docs), new_path(spark, "line-hashes")
    batch = F.pmod(F.xxhash64(F.col(f"`{batch_key}`")), F.lit(batches)).cast("int").alias("batch")
    docs.select(batch, as_bytes(f"`{text}`").alias("text")).mapInArrow(_count_lines, _COUNTS).write.partitionBy("batch").parquet(at)
    hashed = spark.read.schema("key long, n long, batch int").parquet(at)
    for b in range(batches):
        runs.add_counts(hashed.filter(F.col("batch") == b))
    return runs


def drop_lines(text: bytes, common: np.ndarray) -> tuple[int, int, bytes]:
    """(lines, dropped lines, kept text); common holds the sorted hashes of the common keys."""
    lines = text.split(b"\n")
    if not len(common):
        return len(lines), 0, text
    keys = [line.strip(SPACE).lower() for line in lines]
    mine = np.array([key_hash(k) for k in keys], np.int64)
    at = np.minimum(np.searchsorted(common, mine), len(common) - 1)
    gone = [bool(k) and hit for k, hit in zip(keys, (common[at] == mine).tolist(), strict=True)]
    return len(lines), sum(gone), b"\n".join([x for x, g in zip(lines, gone, strict=True) if not g])


_OUT = "_n_lines long, _n_dropped long, _kept binary"


def _dropped(values: list[bytes], commons: list[np.ndarray]) -> list[pa.Array]:
    rows = [drop_lines(t, c) for t, c in zip(values, commons, strict=True)]
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.binary()),
    ]


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    batch_key: str = "doc_id",
    min_docs: int = 10,
    batches: int = 4,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """docs with columns _n_lines, _n_dropped and _kept (binary: the text without its common lines).

    A line is common if its key (stripped, A-Z lower-cased) is not empty and at least min_docs rows hold it;
    it goes from every row, the first included. Null and empty texts are one empty line, which stays. Rows with
    equal ids each count as a document. Other columns pass through, whatever their names; one named like an output is
    replaced by it. An empty table gives an empty table. A text whose lines all go is empty, with all its lines counted
    as dropped."""
    spark, new = docs.sparkSession, ["_n_lines", "_n_dropped", "_kept"]
    common = line_runs(docs, text, batch_key, min_docs, batches).common()
    held = docs.select(carried(docs, *new), as_bytes(f"`{text}`").alias("bytes"))
    schema = StructType([held.schema["row"]]).add(new[0], "long").add(new[1], "long").add(new[2], "binary")
    few = common.limit(broadcast_keys + 1).toArrow()
    if few.num_rows <= broadcast_keys:
        sent = spark.sparkContext.broadcast(np.sort(few.column("key").to_numpy()))

        def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                values = b.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), *_dropped(values, [sent.value] * len(values))], ["row", *new])

        return held.mapInArrow(apply, schema).select("row.*", *new)

    # beyond the bound: the common keys that a text holds are joined to it, by a hash of the text
    id_of = [F.xxhash64("bytes").alias("hash"), F.octet_length("bytes").alias("length")]

    def lines_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h, n, key = [], [], []
            for th, tl, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = {key_hash(k) for k in line_keys(t) if k}
                h += [th] * len(own)
                n += [tl] * len(own)
                key += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(key, pa.int64())], ["hash", "length", "key"]
            )

    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = (
        held.select(*id_of, "bytes")
        .mapInArrow(lines_of, "hash long, length int, key long")
        .withColumn("salt", F.pmod("hash", F.lit(SALT)).cast("int"))
        .join(salted, ["key", "salt"], "left_semi")
        .groupBy("hash", "length")
        .agg(F.collect_set("key").alias("common"))
    )

    def apply_joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            commons = [np.sort(np.array(c or [], np.int64)) for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *_dropped(b.column(1).to_pylist(), commons)], ["row", *new])

    joined = held.select("*", *id_of).join(own, ["hash", "length"], "left").select("row", "bytes", "common")
    return joined.mapInArrow(apply_joined, schema).select("row.*", *new)


def kept_digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
