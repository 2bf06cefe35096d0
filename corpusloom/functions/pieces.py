"""Functions of one text as Arrow UDFs that hold few texts at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Characters and rows of a batch that are Python strings at one time, at most; a longer text is alone.
CHARACTERS, ROWS = 1 << 20, 1_000


def in_pieces(texts: pa.Array, f: Callable[[str], Any], kind: pa.DataType) -> pa.Array:
    """f of every text that is not null. Spark's batches have up to 10,000 rows, so that a batch as strings with all results
    would grow with the texts; here a piece of it is read, worked on and turned into Arrow before the next."""
    out, now, size = [], [], 0
    for text in texts:
        t = text.as_py()
        now.append(None if t is None else f(t))
        size += len(t or "")
        if size >= CHARACTERS or len(now) >= ROWS:
            out.append(pa.array(now, kind))
            now, size = [], 0
    return pa.concat_arrays([*out, pa.array(now, kind)])


def pieced(f: Callable[[str], Any], kind: DataType) -> Callable[[Column], Column]:
    """f as a column function; null for null."""
    held = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def apply(text: pa.Array) -> pa.Array:
        return in_pieces(text, f, held)

    return apply
