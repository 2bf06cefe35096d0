"""Helpers that the corpus operators share: checkpoints, Arrow columns as numpy arrays, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.components import connected_components
from corpusloom.functions.storage import checkpoint, new_path, shared_folder

__all__ = ["as_bytes", "binary_column", "bucketed", "carried", "checkpoint", "connected_components", "mix64", "new_path", "shared_folder", "SPACE", "WORD"]

#: Characters between words, and at the ends of a line key.
SPACE = b"\x20\t\n\x0b\x0c\r"
#: The same class for regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def carried(docs: DataFrame, *outputs: str) -> Column:
    """All columns of docs in one struct, so that no name in it, dotted or like one that an operator uses inside, can
    clash; `select("row.*", ...)` gives them back. Columns with the name of an output are left out: outputs replace them."""
    taken = {c.lower() for c in outputs}
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]).alias("row")


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """df, written once to the shared folder in buckets of key, so that grouping by key moves none of it again.

    Spark writes buckets only through its catalog; the entry goes again, the files stay."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "bucketed")
    name = "bucketed_" + path.rsplit("-", 1)[-1]
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    held = spark.table(name)
    held.schema  # noqa: B018  resolves the table while the catalog has it
    spark.sql(f"DROP TABLE {name}")
    return held


def as_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow column, without a copy; null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values, so that all bits depend on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
