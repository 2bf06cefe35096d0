"""Removal of bytes inside long repeated strings, by blockwise suffix sorting over a difference-cover sample.

Every suffix that may tie with another for LENGTH bytes is sorted into a bucket; suffixes that
tie there are repeated strings. To bound memory, suffixes are sorted one bucket at a time, and a suffix enters a bucket only
if the cover sample lets it: the positions whose remainder modulo the period is in a difference cover are ranked first by
their next LENGTH - PERIOD + 1 bytes. For two suffixes at any i and j there is a shift below the period that
takes both into the cover, so if they tie for LENGTH bytes, some sampled position within PERIOD of i has the rank of
another sampled position. A suffix whose sampled positions all have ranks of their own cannot tie, and is left out.

Only equality matters here, so ranks and buckets are ordered by hashes of the strings in place of the strings. A suffix
is known by 80 bits and by the bits that choose its bucket; as buckets grow with the input, the expected number of false
ties stays far below one (below 1e-9 at 1 GB and 1e-4 at 100 TB). Distinct texts are dealt to blocks
of about BLOCK_BYTES, compressed; a block sends each bucket its sorted distinct keys as one packed row and gets back
one bit for each. So a string that a block holds many times costs one key, and no task gathers all occurrences of a
hot string. Texts that occur more than once are known to be repeated as a whole and are sent once.

The same is done for words in place of bytes, to tell how many words lie in passages that other texts hold too. Such a
passage has SHARED words or more and may be shorter than LENGTH bytes; nothing is removed for it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, as_bytes, carried, mix64

LENGTH, PERIOD = 400, 307
#: Residues modulo 307 = 17 * 17 + 17 + 1 whose differences give every residue once (a Singer difference set).
COVER = (0, 1, 3, 44, 56, 61, 67, 75, 82, 91, 95, 124, 160, 178, 200, 210, 237, 262)
#: Words of a shared passage, and the same for them: 31 = 5 * 5 + 5 + 1.
SHARED, WORD_PERIOD, WORD_COVER = 51, 31, (1, 5, 11, 24, 25, 27)
BLOCK_BYTES = 4_000_000
#: Bytes of distinct text for each bucket of the cover sample, and of suffixes.
SAMPLE_BUCKET_BYTES, SUFFIX_BUCKET_BYTES = 16_000_000, 2_000_000
#: Positions whose hashes are held at a time.
SPAN = 1 << 19

_TABLES = np.random.default_rng(400).integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[tuple[int, int], np.ndarray] = {}
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACE)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get((base, n))
    if have is None:
        have = np.full(n, np.uint64(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SPAN + LENGTH + 1:
            _POWERS[base, n] = have
    return have


def window_hashes(values: np.ndarray, length: int, which: int) -> np.ndarray:
    """A 64-bit polynomial hash of every `length` consecutive values; two kinds."""
    full = SPAN + LENGTH + 1
    up, down = _powers(_BASES[which], full), _powers(pow(_BASES[which], -1, 1 << 64), full)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[length:] - sums[:-length]) * down[: max(0, len(values) - length + 1)])


class Symbols:
    """Texts as one row of symbols, the ends of the texts, and the rule by which their strings are compared."""

    length, period, cover = LENGTH, PERIOD, COVER
    across = False  # whether a string must be in two texts to count as repeated

    def __init__(self, raw: np.ndarray, sizes: np.ndarray):
        self.raw, self.sizes = raw, sizes
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def values(self, which: int, at: int, to: int) -> np.ndarray:
        return _TABLES[which][self.raw[at:to]]

    def spans(self, length: int) -> Iterator[tuple[int, int]]:
        """Ranges of start positions to hash at a time."""
        for at in range(0, len(self.raw) - length + 1, SPAN):
            yield at, min(at + SPAN, len(self.raw) - length + 1)

    def whole(self, at: int, to: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(offset in its text, whether `length` symbols of it follow) of the positions at..to."""
        p = np.arange(at, to)
        text = np.searchsorted(self.ends, p, side="right")
        return p - self.starts[text], p + length <= self.ends[text]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the cover sample."""
        inside = np.zeros(self.period, bool)
        inside[list(self.cover)] = True
        length = self.length - self.period + 1
        places, hashes = [], []
        for at, to in self.spans(length):
            offset, fits = self.whole(at, to, length)
            use = np.flatnonzero(inside[offset % self.period] & fits)
            places.append(use + at)
            hashes.append(window_hashes(self.values(0, at, to + length - 1), length, 0)[use])
        return _join(places, np.int64), _join(hashes, np.uint64)

    def suffixes(self, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, keys, further bits) of the suffixes that a tied sampled position lets in."""
        near = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(near, np.maximum(tied - self.period + 1, self.starts[self.text_of(tied)]), 1)
        np.add.at(near, tied + 1, -1)
        near = np.cumsum(near) > 0
        places, keys, more = [], [], []
        for at, to in self.spans(self.length):
            if not near[at:to].any():
                continue
            use = np.flatnonzero(near[at:to] & self.whole(at, to, self.length)[1])
            places.append(use + at)
            for which, out in ((0, keys), (1, more)):
                out.append(window_hashes(self.values(which, at, to + self.length - 1), self.length, which)[use])
        return _join(places, np.int64), _join(keys, np.uint64), _join(more, np.uint64)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Of each symbol whether a string that starts at one of these positions covers it."""
        gone = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + self.length, -1)
        return np.cumsum(gone)[:-1] > 0


class Words(Symbols):
    """The words of texts of bytes, A-Z as a-z, as 64-bit hashes."""

    length, period, cover = SHARED, WORD_PERIOD, WORD_COVER
    across = True

    def __init__(self, texts: Symbols):
        raw = texts.raw
        inside = ~_BLANK[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = texts.starts[(texts.starts < len(raw)) & (texts.sizes > 0)]
        begins[cut] |= inside[cut]
        ends[cut[cut > 0] - 1] |= inside[cut[cut > 0] - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        hashes = np.zeros(len(first), np.uint64)
        up, down = _powers(_BASES[0], SPAN + LENGTH + 1), _powers(pow(_BASES[0], -1, 1 << 64), SPAN + LENGTH + 1)
        at = 0
        while at < len(first):
            lo = int(first[at])
            to = max(at + 1, int(np.searchsorted(last, lo + SPAN, side="right")))
            hi = int(last[to - 1])
            if hi - lo > SPAN:  # one word longer than a span
                hashes[at] = np.uint64(int.from_bytes(hashlib.md5(_FOLD[raw[lo:hi]].tobytes()).digest()[:8], "little"))
            else:
                sums = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(_TABLES[0][_FOLD[raw[lo:hi]]] * up[: hi - lo], out=sums[1:])
                a, b = first[at:to] - lo, last[at:to] - lo
                hashes[at:to] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
            at = to
        super().__init__(mix64(hashes), np.bincount(texts.text_of(first), minlength=len(texts.sizes)).astype(np.int64))

    def values(self, which: int, at: int, to: int) -> np.ndarray:
        return self.raw[at:to] if not which else mix64(self.raw[at:to] ^ np.uint64(_BASES[1]))


class Block:
    """Texts of one block, in the order of their digests; short ones are left out by the caller."""

    def __init__(self, digests: list[bytes], counts: list[int], texts: list[bytes]):
        order = sorted(range(len(texts)), key=lambda i: digests[i])
        self.digests: list[bytes] = []
        self.counts: list[int] = []
        kept = []
        for i in order:
            if self.digests and self.digests[-1] == digests[i]:
                self.counts[-1] += counts[i]
            else:
                self.digests.append(digests[i])
                self.counts.append(counts[i])
                kept.append(texts[i])
        self.bytes = Symbols(np.frombuffer(b"".join(kept), np.uint8), np.array([len(t) for t in kept], np.int64))
        self.words = Words(self.bytes)
        self.kinds = (self.bytes, self.words)


def _join(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _sorted(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each key in order equals the one before it)."""
    order = np.argsort(keys, kind="stable")
    k, m = keys[order], more[order]
    same = k[1:] == k[:-1]
    if (same & (m[1:] != m[:-1])).any():  # one hash of two strings
        order = np.lexsort((more, keys))
        k, m = keys[order], more[order]
        same = k[1:] == k[:-1]
    return order, np.concatenate([[False], same & (m[1:] == m[:-1])]) if len(k) else np.zeros(0, bool)


class Keys:
    """Sorted distinct keys of a block, dealt to buckets by further bits, and where each position's key is."""

    def __init__(self, symbols: Symbols, places: np.ndarray, keys: np.ndarray, more: np.ndarray, buckets: int, first: int):
        bucket = (more >> np.uint64(16)) % np.uint64(buckets)
        more = (more & np.uint64(0xFFFF)).astype(np.uint16)
        by_bucket = np.argsort(bucket, kind="stable")
        order, same = _sorted(keys[by_bucket], more[by_bucket])
        order = by_bucket[order]
        head = np.flatnonzero(~same)
        number = np.cumsum(~same) - 1
        tail = np.append(head[1:], len(order)) - 1
        if symbols.across:
            text = symbols.text_of(places[order])
            own = np.minimum.reduceat(text, head) != np.maximum.reduceat(text, head) if len(head) else same
        else:
            own = tail > head
        # distinct keys by bucket, then by value
        deal = np.argsort(bucket[order[head]], kind="stable")
        self.keys, self.more, self.own = keys[order[head]][deal], more[order[head]][deal], own[deal]
        back = np.empty(len(deal), np.int64)
        back[deal] = np.arange(len(deal))
        self.at = np.empty(len(order), np.int64)
        self.at[order] = back[number]
        self.numbers, bounds = np.unique(bucket[order[head]][deal].astype(np.int64), return_index=True)
        self.bounds = np.append(bounds, len(head)).tolist()
        self.numbers = self.numbers + first

    def rows(self, width: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed keys): 4 bytes of each are enough to let suffixes in, 10 decide."""
        for i, b in enumerate(self.numbers.tolist()):
            part = slice(self.bounds[i], self.bounds[i + 1])
            keys = self.keys[part]
            yield b, keys.astype(np.uint32).tobytes() if width == 4 else keys.tobytes() + self.more[part].tobytes()

    def repeated(self, replies: dict[int, bytes]) -> np.ndarray:
        """Of each position given, whether its key is repeated; replies: packed bits by bucket."""
        out = self.own.copy()
        for i, b in enumerate(self.numbers.tolist()):
            lo, hi = self.bounds[i], self.bounds[i + 1]
            if b in replies:
                out[lo:hi] |= np.unpackbits(np.frombuffer(replies[b], np.uint8), count=hi - lo).astype(bool)
        return out[self.at]


def _sample_keys(block: Block, buckets: tuple[int, int]) -> list[tuple[np.ndarray, Keys]]:
    out, first = [], 0
    for symbols, n in zip(block.kinds, buckets, strict=True):
        places, hashes = symbols.sample()
        out.append((places, Keys(symbols, places, hashes, hashes >> np.uint64(32) << np.uint64(16), n, first)))
        first += n
    return out


def _suffix_keys(block: Block, tied: list[np.ndarray], buckets: tuple[int, int]) -> list[tuple[np.ndarray, Keys] | None]:
    """Of bytes and of words the places and keys of what the tied sampled positions let in."""
    out, first = [], 0
    for symbols, t, n in zip(block.kinds, tied, buckets, strict=True):
        found = symbols.suffixes(t) if len(t) else None
        out.append((found[0], Keys(symbols, *found, n, first)) if found and len(found[0]) else None)
        first += n
    return out


def _pack(digest: bytes, count: int, text: bytes) -> bytes:
    return digest + count.to_bytes(8, "little") + len(text).to_bytes(8, "little") + text


def _unpack(payloads: list[bytes]) -> Block:
    digests, counts, texts = [], [], []
    d = zstandard.ZstdDecompressor()
    for payload in payloads:
        raw, at = d.decompress(payload), 0
        while at < len(raw):
            n = int.from_bytes(raw[at + 24 : at + 32], "little")
            digests.append(raw[at : at + 16])
            counts.append(int.from_bytes(raw[at + 16 : at + 24], "little"))
            texts.append(raw[at + 32 : at + 32 + n])
            at += 32 + n
    return Block(digests, counts, texts)


def _deal(blocks: int):
    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in it:
            found: dict[bytes, list] = {}
            for text in b.column(0):
                t = text.as_py()
                own = found.setdefault(hashlib.md5(t).digest(), [0, t])
                own[0] += 1
            groups: dict[int, list[bytes]] = {}
            for digest, (count, t) in found.items():
                groups.setdefault(int.from_bytes(digest[:8], "little") % blocks, []).append(_pack(digest, count, t))
            for block, rows in groups.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([z.compress(b"".join(rows))], pa.binary())], ["block", "payload"]
                )

    return apply


_ASK = "bucket long, block long, packed binary"
_ASK_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("packed", pa.binary())])


def _asked(block: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
        schema=_ASK_SCHEMA,
    )


def _rank_sample(buckets: tuple[int, int]):
    def apply(key: tuple, table: pa.Table) -> pa.Table:
        block = _unpack(table.column("payload").to_pylist())
        return _asked(key[0].as_py(), [row for _, keys in _sample_keys(block, buckets) for row in keys.rows(4)])

    return apply


def _answer(width: int):
    """One bucket: its keys sorted, and of every block's keys whether another block has it too."""

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # a block's note to itself
            return table.select(["bucket", "block", "packed"])
        packed = table.column("packed").to_pylist()
        sizes = [len(p) // width for p in packed]
        kind, bytes_of = (np.uint32, 4) if width == 4 else (np.uint64, 8)
        keys = np.concatenate([np.frombuffer(p, kind, n) for p, n in zip(packed, sizes, strict=True)])
        more = np.zeros(len(keys), np.uint16)
        if width > bytes_of:
            more = np.concatenate([np.frombuffer(p, np.uint16, n, 8 * n) for p, n in zip(packed, sizes, strict=True)])
        order, same = _sorted(keys, more)
        tied = np.zeros(len(keys), bool)
        tied[order] |= same
        tied[order[:-1]] |= same[1:]
        out, at = [], 0
        for n in sizes:
            out.append(np.packbits(tied[at : at + n]).tobytes())
            at += n
        return pa.Table.from_arrays([table.column("bucket"), table.column("block"), pa.array(out, pa.binary())], schema=_ASK_SCHEMA)

    return apply


def _replies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("packed").to_pylist(), strict=True))


def _sort_suffixes(sample_buckets: tuple[int, int], suffix_buckets: tuple[int, int]):
    def apply(key: tuple, blocks: pa.Table, ranks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _ASK_SCHEMA.empty_table()
        block, replies = _unpack(blocks.column("payload").to_pylist()), _replies(ranks)
        sampled = _sample_keys(block, sample_buckets)
        tied = [keys.repeated(replies) for _, keys in sampled]
        found = _suffix_keys(block, [places[t] for (places, _), t in zip(sampled, tied, strict=True)], suffix_buckets)
        rows = [row for f in found if f for row in f[1].rows(10)]
        note = zstandard.ZstdCompressor().compress(np.packbits(np.concatenate(tied)).tobytes())
        return _asked(key[0].as_py(), [*rows, (-1 - key[0].as_py(), note)])

    return apply


_FOUND = "digest binary, n_removed long, n_spans long, n_shared long, kept binary"
_FOUND_SCHEMA = pa.schema(
    [("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_shared", pa.int64()), ("kept", pa.binary())]
)


def _remove(suffix_buckets: tuple[int, int], whole: bool):
    def apply(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _FOUND_SCHEMA.empty_table()
        block = _unpack(blocks.column("payload").to_pylist())
        replies = _replies(answers)
        places = [symbols.sample()[0] for symbols in block.kinds]
        note = zstandard.ZstdDecompressor().decompress(replies[-1 - key[0].as_py()])
        tied = np.unpackbits(np.frombuffer(note, np.uint8), count=sum(map(len, places))).astype(bool)
        tied = [places[0][tied[: len(places[0])]], places[1][tied[len(places[0]) :]]]
        covered = []
        for symbols, found in zip(block.kinds, _suffix_keys(block, tied, suffix_buckets), strict=True):
            starts = found[0][found[1].repeated(replies)] if found else np.zeros(0, np.int64)
            covered.append(symbols.covered(starts))
        gone, shared = covered[0], np.concatenate([[0], np.cumsum(covered[1])])
        texts, words, out = block.bytes, block.words, []
        for i, (digest, count) in enumerate(zip(block.digests, block.counts, strict=True)):
            lo, hi, n_words = texts.starts[i], texts.ends[i], int(words.sizes[i])
            copied = count > 1 and hi - lo >= LENGTH
            own = np.ones(hi - lo, bool) if copied else gone[lo:hi]
            n = int(own.sum())
            n_shared = n_words if count > 1 and n_words >= SHARED else int(shared[words.ends[i]] - shared[words.starts[i]])
            if n or n_shared:
                kept = texts.raw[lo:hi][~own].tobytes()
                edges = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                out.append((digest, n, edges, n_shared, kept if whole else hashlib.sha256(kept).digest()))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], _FOUND_SCHEMA.types[i]) for i in range(5)], schema=_FOUND_SCHEMA)

    return apply


def repeated_strings(docs: DataFrame, text: str = "text", whole: bool = True) -> DataFrame:
    """digest (MD5 of the text's bytes), n_removed, n_spans, n_shared and kept of every distinct text that loses bytes or
    shares a passage; kept is what stays, or its SHA-256 if not whole."""
    long = docs.select(as_bytes(f"`{text}`").alias("t")).filter(F.octet_length("t") >= min(LENGTH, 2 * SHARED - 1))
    total = long.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))

    def buckets(size: int) -> tuple[int, int]:
        return max(2, math.ceil(total / size)), max(2, math.ceil(total / 4 / size))

    samples, suffixes = buckets(SAMPLE_BUCKET_BYTES), buckets(SUFFIX_BUCKET_BYTES)
    dealt = long.mapInArrow(_deal(blocks), "block long, payload binary").repartition("block")
    asked = dealt.groupBy("block").applyInArrow(_rank_sample(samples), _ASK)
    ranks = asked.groupBy("bucket").applyInArrow(_answer(4), _ASK)
    sent = dealt.groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(_sort_suffixes(samples, suffixes), _ASK)
    answers = sent.groupBy("bucket").applyInArrow(_answer(10), _ASK)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(suffixes, whole), _FOUND)


def remove_repeats(docs: DataFrame, text: str = "text", whole: bool = True) -> DataFrame:
    """docs with _n_bytes, _n_removed, _n_spans, _n_shared and _kept: the bytes that stay, or their SHA-256 if not whole.

    A byte goes if a string of LENGTH bytes that covers it also starts elsewhere, in the same text or another; texts
    that are equal are each other's elsewhere. Strings never cross texts. _n_shared counts the words in passages of
    SHARED or more words (A-Z as a-z, whatever blanks are between them) that another row's text holds too; they stay. A null
    text is empty; texts shorter than LENGTH lose nothing. Bytes are cut wherever the strings end, within a character
    too. Every row gives one row, repeated rows too. Other columns pass through whatever their names; one named like an
    output is replaced by it. An empty table gives an empty table."""
    raw = as_bytes(f"`{text}`")
    held = docs.select(
        carried(docs, "_n_bytes", "_n_removed", "_n_spans", "_n_shared", "_kept"),
        F.octet_length(raw).cast("long").alias("n_bytes"),
        F.unhex(F.md5(raw)).alias("digest"),
        (raw if whole else F.unhex(F.sha2(raw, 256))).alias("all"),
    )
    return held.join(repeated_strings(docs, text, whole), "digest", "left").select(
        "row.*",
        F.col("n_bytes").alias("_n_bytes"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(f"_{c}") for c in ("n_removed", "n_spans", "n_shared")],
        F.coalesce("kept", "all").alias("_kept"),
    )
