"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most four bits differ in at most four bytes, so they share at
least four positional bytes: (position, value) pairs. Lists of single positional bytes hold 1/256 of all fingerprints
each, and pairs counted straight from them would grow with the square of the input. The index therefore holds the
lists intersected four at a time: a posting is a choice of four positions with their values, and two fingerprints meet
in a posting exactly if their tally of shared positional bytes reaches the guaranteed minimum of four. In a posting the
tally of each pair is taken, pairs below the minimum are left out, and the rest are verified on all 64 bits.

A posting with more than POSTING entries is indexed once more in the same way, on the eight half bytes of the four bytes that
are still open: at most four of them differ, so at least four are shared. Such a posting has 16 bits left and thus no
more than 65,536 entries. Equal fingerprints are one entry. Of the pairs in one posting only a spanning forest of the
verified links leaves its task. Components come from repeated joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import as_bytes, checkpoint, connected_components

SEED, SHINGLE, BITS, MAX_BITS = 42, 4, 64, 4
#: Entries of a posting that are compared at once; larger postings are indexed by half bytes first.
POSTING = 8192
#: The choices of four of eight positions; their order numbers the postings.
CHOICES = list(combinations(range(8), BITS // 8 - MAX_BITS))
LEAST_TALLY = BITS // 8 - MAX_BITS
#: A fingerprint with more than this share of the rows is hot; there are fewer than its inverse.
HOT = 1000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends[: len(words) - shingle + 1] - [len(w) + 1 for w in words[: len(words) - shingle + 1]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    total, value = np.zeros(BITS, np.int64), np.array(hashes, "<u8")
    for at in range(0, len(value), 1 << 16):
        part = value[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs without its text, with _fp: the fingerprint as a signed long. Null texts have no words."""
    names = [c for c in docs.columns if c != text]
    held = docs.select(*[F.col(f"`{c}`") for c in names], as_bytes(f"`{text}`").alias("_bytes"))
    schema = StructType(held.schema.fields[:-1]).add("_fp", "long")

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints.view(np.int64))], [*names, "_fp"])

    return held.mapInArrow(apply, schema)


def _masks() -> list[int]:
    """Per posting number the bits that it fixes: first the choices of four bytes, then of each of these the choices of
    four half bytes of the open bytes."""
    whole = [sum(0xFF << (8 * p) for p in c) for c in CHOICES]
    halves = []
    for mask in whole:
        open_halves = [i for i in range(16) if not mask >> (4 * i) & 1]
        halves += [mask | sum(0xF << (4 * open_halves[p]) for p in c) for c in CHOICES]
    return whole + halves


MASKS = np.array(_masks(), np.uint64)


def _postings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(choice, fp) for every posting of fp; of (fp, choice) for every posting of half bytes within that choice."""
    n = len(CHOICES)
    for b in it:
        prints = b.column(0).to_numpy(zero_copy_only=False)
        first = (b.column(1).to_numpy(zero_copy_only=False).astype(np.int32) + 1) * n if b.num_columns > 1 else np.zeros(len(prints), np.int32)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            choice = first[at : at + 4096, None] + np.arange(n, dtype=np.int32)[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(choice.ravel()), pa.array(np.repeat(part, n))], ["choice", "fp"])


def tally(prints: np.ndarray, one: np.uint64) -> np.ndarray:
    """How many positional bytes each fingerprint shares with one."""
    return ((prints ^ one).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def forest(prints: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct fingerprints that share enough bytes and differ in few bits."""
    rest, out = prints, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.flatnonzero(tally(rest, one) >= LEAST_TALLY)
            near = near[np.bitwise_count(rest[near] ^ one) <= bits]
            if len(near):
                found = rest[near]
                out += [(int(one), int(x)) for x in found]
                queue += list(found)
                rest = np.delete(rest, near)
    return out


def _pairs(posting: int | None):
    """Links within sorted postings, as (a, b, -1); entries of too large postings as (fp, null, choice)."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, large = [], None, False  # of the posting that may go on in the next batch

        def flush() -> list[tuple[int, int]]:
            return forest(np.unique(np.concatenate(held))) if not large and sum(map(len, held)) > 1 else []

        seen: set[tuple[int, int]] = set()
        for b in it:
            choice = b.column(0).to_numpy()
            prints = b.column(1).to_numpy().view(np.uint64)
            keys = prints & MASKS[choice]
            links, spill = [], []
            cut = np.flatnonzero((keys[1:] != keys[:-1]) | (choice[1:] != choice[:-1])) + 1
            bounds = np.concatenate([[0], cut, [len(keys)]])
            sizes = np.diff(bounds)
            # the first and last run may be parts of longer ones; runs of one entry in between have no pair
            busy = np.unique(np.concatenate([[0], np.flatnonzero(sizes > 1), [len(sizes) - 1]])) if len(keys) else []
            for r in busy:
                lo, hi = bounds[r], bounds[r + 1]
                own = (int(choice[lo]), int(keys[lo]))
                if own != key:
                    links += flush()
                    held, key, large = [], own, False
                held.append(prints[lo:hi])
                if posting is not None and (large or sum(map(len, held)) > posting):
                    large = True
                    spill += [(own[0], held)]
                    held = []
            seen_now = [x for x in dict.fromkeys(links) if x not in seen]
            if len(seen) < 200_000:
                seen.update(seen_now)
            yield from _out(seen_now, spill)
        yield from _out(flush(), [])

    return apply


def _out(links: list, spill: list) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "choice"]
    if links:
        ends = np.array(links, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(np.full(len(ends), -1, np.int32))], names)
    for choice, parts in spill:
        prints = np.concatenate(parts).view(np.int64)
        n = len(prints)
        yield pa.RecordBatch.from_arrays([pa.array(prints), pa.nulls(n, pa.int64()), pa.array(np.full(n, choice, np.int32))], names)


def _met(entries: DataFrame, masks: np.ndarray, posting: int | None) -> DataFrame:
    """Links and large postings among entries(choice, fp); a posting's key is not shuffled, it follows from both."""
    fixed = F.element_at(F.array(*[F.lit(int(m)) for m in masks.view(np.int64)]), F.pmod("choice", F.lit(len(masks))) + 1)
    key = F.col("fp").bitwiseAND(fixed)
    return checkpoint(
        entries.repartition("choice", key).sortWithinPartitions("choice", key).mapInArrow(_pairs(posting), "a long, b long, choice int")
    )


def fingerprint_links(prints: DataFrame, posting: int = POSTING) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (column _fp) within four bits of each other.

    They generate the components of all such pairs; pairs that others connect may be left out."""
    n = len(CHOICES)
    found = _met(prints.mapInArrow(_postings, "choice int, fp long"), MASKS[:n], posting)
    links = found.filter("choice < 0").select("a", "b")
    large = found.filter("choice >= 0").select(F.col("a").alias("fp"), "choice").distinct()
    if large.isEmpty():
        return links
    halves = large.mapInArrow(_postings, "choice int, fp long")
    return links.unionByName(_met(halves, MASKS, None).select("a", "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", posting: int = POSTING) -> DataFrame:
    """doc_id, _fp (signed long), component_id: the smallest doc_id reachable over links of fingerprints that
    differ in four bits or fewer, the document's own included; and _component, a number of its own for each component.

    Texts are whole; null, empty and blank texts have no words and the fingerprint 0, which is linked like any other.
    Rows with equal ids each give a row. A null id reaches others but is never a component's id, unless no
    document of the component has an id. An empty table gives an empty table; other columns are not read."""
    prints = checkpoint(with_fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))))
    distinct = checkpoint(prints.groupBy("_fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    links = fingerprint_links(distinct.select("_fp"), posting)
    groups = connected_components(links).withColumnRenamed("node", "_fp")
    least = (
        groups.join(distinct, "_fp")
        .groupBy("component")
        .agg(F.min("first_id").alias("component_id"))
        .join(groups, "component")
        .select("_fp", "component_id", "component")
    )
    chosen = checkpoint(
        distinct.join(least, "_fp", "left").select(
            "_fp", "n", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("component", "_fp").alias("_component")
        )
    )
    rows = prints.count()
    hot = F.broadcast(chosen.filter(F.col("n") * HOT > rows).drop("n"))  # fewer than HOT rows
    cold = chosen.filter(F.col("n") * HOT <= rows).drop("n")
    out = prints.join(hot, "_fp").unionByName(prints.join(hot, "_fp", "left_anti").join(cold, "_fp"))
    return out.select("doc_id", "_fp", "component_id", "_component")
