"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q) words that no
neighbouring word extends. At each dyadic scale B (8, 16, 32, ...) the words are cut into blocks of B, and the exact
sum of squared differences between a block and every place B to 2 B - 1 words on (at the first scale 1 to 15) comes from
one cyclic number-theoretic transform of 2 B numbers. Where the sum is zero, the block occurs again without a mismatch.

No run is missed: of a run with period q, the words that have their copy q words on inside it are at least 2 q and at
least 16, so some whole block of the scale with B <= q < 2 B (of the first scale, for q < 16) lies among them.
Each distance found seeds an extension to both sides. Its length comes from names of the stretches of 1, 2, 4, ... words
(equal names, equal words), so that it takes a step per doubling however long it is. Of the periods of one
stretch the smallest counts; it divides the others and has its own seed.

Sums are exact: they are taken modulo as many primes as it takes for their product to exceed the largest possible sum, so
that they are zero modulo all of them only if they are zero. Blocks with a word that does not come again soon enough are
left out before the transform; they can't occur again.

The texts of a batch are laid end to end, each followed by a number that is no word's, so that transforms of
all their blocks run side by side and no run crosses from one text to the next. A task holds SLICE bytes of
text, or one text, at a time. Nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from corpusloom.llm.common import as_bytes, carried

LEAST, TIMES = 24, 3
#: Words of the smallest block; the first scale also takes the distances below it.
BLOCK = 8
#: Bytes of text that a task works on at once, and numbers in one transform of many blocks.
SLICE, CELLS = 4_000_000, 1 << 20
#: Primes with a power of two in p - 1 of at least 2^25, each with a primitive root.
PRIMES = ((2013265921, 31), (1811939329, 13), (2113929217, 5), (469762049, 3))
#: No block is longer; a run of a longer period would need over 100 million words in one text.
LONGEST = 1 << 24

RUNS = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def twiddles(half: int, prime: int, root: int, back: bool) -> np.ndarray:
    """The first `half` powers of a primitive root of unity of order 2 * half, or of its inverse."""
    w = pow(root, (prime - 1) // (2 * half), prime)
    w = pow(w, prime - 2, prime) if back else w
    out = np.ones(half, np.uint64)
    at, step = 1, w
    while at < half:  # out[at + i] = out[i] * w^at
        out[at : 2 * at] = out[:at] * np.uint64(step) % np.uint64(prime)
        at, step = 2 * at, step * step % prime
    return out


class Transform:
    """Cyclic convolution of rows of 2^k numbers modulo one prime."""

    def __init__(self, size: int, prime: int, root: int):
        self.size, self.prime = size, np.uint64(prime)
        halves = [1 << i for i in range(size.bit_length() - 1)]
        self.there = {h: twiddles(h, prime, root, False) for h in halves}
        self.back = {h: twiddles(h, prime, root, True) for h in halves}
        self.scale = np.uint64(pow(size, prime - 2, prime))

    def forward(self, a: np.ndarray) -> np.ndarray:
        """In bit-reversed order; `inverse` takes that order."""
        h, p = self.size // 2, self.prime
        while h:
            v = a.reshape(len(a), -1, 2, h)
            low, high = v[:, :, 0], v[:, :, 1]
            total = low + high
            v[:, :, 1] = (low + (p - high)) * self.there[h] % p
            v[:, :, 0] = np.where(total >= p, total - p, total)
            h //= 2
        return a

    def inverse(self, a: np.ndarray) -> np.ndarray:
        h, p = 1, self.prime
        while h < self.size:
            v = a.reshape(len(a), -1, 2, h)
            turned = v[:, :, 1] * self.back[h] % p
            low = v[:, :, 0].copy()
            total = low + turned
            v[:, :, 0] = np.where(total >= p, total - p, total)
            total = low + (p - turned)
            v[:, :, 1] = np.where(total >= p, total - p, total)
            h *= 2
        return a * self.scale % p

    def squared_differences(self, blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Modulo the prime, for every row the sums of (block - window)^2 at the shifts 0 to B - 1; windows hold 2 B - 1
        numbers and one that isn't used. What wraps around lands below index B - 1 and isn't read."""
        b, p = blocks.shape[1], self.prime
        turned = np.zeros((len(blocks), self.size), np.uint64)
        turned[:, :b] = blocks[:, ::-1] % p
        held = windows % p
        products = self.inverse(self.forward(turned) * self.forward(held.copy()) % p)[:, b - 1 : 2 * b - 1]
        own = (blocks % p) ** 2 % p
        squares = np.concatenate([np.zeros((len(held), 1), np.uint64), np.cumsum(held**2 % p, axis=1)], axis=1)
        theirs = (squares[:, b : 2 * b] - squares[:, :b]) % p
        return (own.sum(axis=1, keepdims=True) % p + theirs + 2 * (p - products)) % p


def occurrences(words: np.ndarray, starts: np.ndarray, block: int, first: int, primes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every block that occurs again `first` to `first + block - 1` words on. Words end in
    3 * block numbers or more that are no word's."""
    transforms = [Transform(2 * block, *p) for p in primes]
    found_starts, found_distances = [], []
    step = max(1, CELLS // (2 * block))
    for at in range(0, len(starts), step):
        own = starts[at : at + step, None]
        blocks = words[own + np.arange(block)]
        windows = words[own + first + np.arange(2 * block)]
        zero = np.logical_and.reduce([t.squared_differences(blocks, windows) == 0 for t in transforms])
        row, shift = np.nonzero(zero)
        found_starts.append(starts[at : at + step][row])
        found_distances.append(shift + first)
    return np.concatenate(found_starts), np.concatenate(found_distances)


def gaps(words: np.ndarray) -> np.ndarray:
    """How many places on the same number comes again; the length of all if it doesn't."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), len(words), np.int64)
    same = words[order[1:]] == words[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def seeds(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the blocks of all scales up to a third of the longest text that occur again at a distance of
    their scale."""
    n, gap, found = len(words), gaps(words), []
    block = BLOCK
    filled = np.concatenate([words, np.full(3 * max(BLOCK, min(longest, LONGEST)) + 1, words.max() + 1 if n else 0, words.dtype)]).astype(np.uint64)
    top = int(filled[-1])
    while block == BLOCK or (TIMES * block <= longest and block <= LONGEST):
        most = gap[: n // block * block].reshape(-1, block).max(axis=1) if n >= block else gap[:0]
        needed, bound = [], block * top * top
        for p in PRIMES:
            needed.append(p)
            if bound < np.prod([float(x) for x, _ in needed]) / 2:
                break
        for first in ([0, block] if block == BLOCK else [block]):
            starts = np.flatnonzero(most < first + block) * block
            if len(starts):
                found.append(occurrences(filled, starts, block, first, tuple(needed)))
        block *= 2
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    return at[distance > 0], distance[distance > 0]


class Names:
    """Equal stretches of 1, 2, 4, ... words of one text have equal names, and no others."""

    def __init__(self, words: np.ndarray):
        self.n, self.levels = len(words), [pd.factorize(words)[0].astype(np.int32)]
        while 2 << (len(self.levels) - 1) < self.n:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = below[:-half].astype(np.int64) << 32 | below[half:]
            self.levels.append(pd.factorize(pairs)[0].astype(np.int32))

    def _reach(self, a: np.ndarray, b: np.ndarray, right: bool) -> np.ndarray:
        """How many words from a and from b on (or before them) are the same, for a < b."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            size, level = 1 << k, self.levels[k]
            x, y = (a + done, b + done) if right else (a - done - size, b - done - size)
            ok = (y < len(level)) if right else (x >= 0)
            ok[ok] = level[x[ok]] == level[y[ok]]
            done[ok] += size
        return done

    def runs(self, at: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """(start, length, period) of the runs that the seeds lie in, by start, then period."""
        start = at - self._reach(at, at + distance, False)
        length = at - start + self._reach(at, at + distance, True) + distance
        long = length >= np.maximum(LEAST, TIMES * distance)
        rows = np.stack([start, length, distance], axis=1)[long]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        if len(rows):  # of one stretch the smallest period comes first
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(texts: list[list[bytes]]) -> dict[int, np.ndarray]:
    """By number of the text, the runs of the texts (lists of words) that have any."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return {}
    codes = pd.factorize(np.array([w for t in texts for w in t], dtype=object))[0].astype(np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1  # of each text in the line of all, with one number after each
    line = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    after = first + sizes
    line[after] = codes.max() + 1 + np.arange(len(texts))
    held = np.ones(len(line), bool)
    held[after] = False
    line[held] = codes
    at, distance = seeds(line, int(sizes.max()))
    owner = np.searchsorted(first, at, side="right") - 1
    inside = at + distance < after[owner]  # a block may come again in the next text
    at, distance, owner = at[inside], distance[inside], owner[inside]
    order = np.argsort(owner, kind="stable")
    out = {}
    for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []:
        t = int(owner[part[0]])
        runs = Names(line[first[t] : after[t]]).runs(at[part] - first[t], distance[part])
        if len(runs):
            out[t] = runs
    return out


def collapse(words: list[bytes], runs: np.ndarray | None) -> bytes:
    """The words, one space between, without those that a run holds after its first period."""
    if runs is None:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in it:
        sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(sizes)]) // SLICE)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(sizes)], strict=True):
            if lo == hi:
                continue
            texts = [x.as_py().split() for x in b.column(1).slice(lo, hi - lo)]
            found = find_runs(texts)
            runs = [[{"start": int(s), "length": int(n), "period": int(q)} for s, n, q in found.get(i, ())] for i in range(len(texts))]
            kept = [collapse(t, found.get(i)) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())],
                ["row", "_n_words", "_runs", "_kept"],
            )


def periodic_runs(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without its text, unless keep_text) and _n_words, _runs (start, length, period of each, by start, then
    period; word numbers from 0) and _kept: the text as UTF-8 bytes, words joined by one space, without the words that a run
    holds after its first period.

    Words are what lies between the characters 0x20 and 0x09-0x0D. Texts are whole. Null, empty and blank texts have no
    words, no runs and an empty _kept. Rows are independent: repeated rows and ids give a row each, an empty table an
    empty table. Other columns may have any name; one named like an output is replaced by it."""
    outputs = ("_n_words", "_runs", "_kept") if keep_text else (text, "_n_words", "_runs", "_kept")
    names = [c for c in docs.columns if c.lower() not in {o.lower() for o in outputs}]
    row = carried(docs, *outputs) if names else F.struct(F.lit(0).alias("none")).alias("row")
    held = docs.select(row, as_bytes(f"`{text}`").alias("_bytes"))
    kind = held.schema["row"].dataType
    schema = StructType().add("row", kind).add("_n_words", LongType()).add("_runs", ArrayType(RUNS)).add("_kept", BinaryType())
    return held.mapInArrow(_apply, schema).select(*[F.col(f"row.`{c}`") for c in names], "_n_words", "_runs", "_kept")


def stuttering(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, by crc32 of the id, rewritten so that they repeat from some word on; the words of the others
    as they are. A null id leaves a text as it is."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)

    # bound by an array of one element, so that the words aren't split anew for each word
    return F.when(h % 10 == 0, F.get(F.transform(F.array(split), rewritten), 0)).otherwise(text)
