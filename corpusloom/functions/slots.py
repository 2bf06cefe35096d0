"""Slots for functions of the user: scorers, encoders, text steps, strategies and expanders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType


class Strategy(Protocol):
    """Retrieval strategy: ranked rows (query_id, rank, chunk_id, score)."""

    def __call__(self, queries: DataFrame, corpus: DataFrame, k: int, min_score: float) -> DataFrame: ...


Expander = Callable[[Column], Column]


def pair_scorer(score: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A scorer of (query, text) pairs, called once per Arrow batch; an error gives nulls, which keep the prior order."""

    @F.pandas_udf(DoubleType())
    def apply(query: pd.Series, text: pd.Series) -> pd.Series:
        try:
            return pd.Series(score(list(zip(query, text, strict=True))), dtype="float64")
        except Exception:
            return pd.Series([None] * len(query), dtype="float64")

    return apply


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """Text to vector; `load` runs once per task and gives the function that encodes a batch."""

    @F.pandas_udf(ArrayType(FloatType()))
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(encode(texts.fillna("").tolist()), np.float32)))

    return apply


def text_step(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column], Column]:
    """Text to text, by a model that is loaded once per task."""

    @F.pandas_udf(StringType())
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for texts in batches:
            yield pd.Series(run(texts.fillna("").tolist()))

    return apply


def hashing_encoder(dims: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Unit vectors of hashed words, for tests and for corpora without a model."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                    out[i, h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(n > 0, n, 1)

        return encode

    return load
