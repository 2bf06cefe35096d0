"""Brown class-based n-gram language model over all training documents.

1. Documents are coded once into blocks of about BLOCK_BYTES of text: a block's own vocabulary and its documents as
   numbers, written in buckets of blocks, so that no later step moves them again.
2. A start: the SEEDS most frequent words get classes by sequential exchange on their bigram counts, which cover all
   training text and fit on the driver (SEEDS squared at most). All other words are one class at first.
3. Exchange over all words, in sweeps. Blocks send each word's training count and the classes before and after it to the
   bucket of its hash, which sums them. The class bigram counts of all training text are known exactly, and every word,
   seeds too, moves to the class that raises the likelihood most; words with fewer than EXACT_FROM tokens by the first
   term of that gain. Classes go back to the blocks, which count the class bigrams anew. Words move side by side in a
   sweep, so a sweep stands only if the likelihood rose; SWEEPS bounds them. No word is left out.
4. Blocks score their documents: word emissions (count + 1/2) / (class tokens + words / 2), class transitions smoothed
   towards the class shares, and a probability of unknown words by the share of tokens seen once.

Every word of the training text has a count, a class and an emission: nothing is capped or sampled. Blocks exchange
packed rows with buckets, so that a frequent word costs one entry per block."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import as_bytes, bucketed, checkpoint

BLOCK_BYTES, BUCKET_BYTES = 12_000_000, 12_000_000
CLASSES, SEEDS, SEED_SWEEPS, SWEEPS = 24, 600, 12, 2
#: Tokens of a word from which its gains are exact.
EXACT_FROM = 16
#: Words of each block that are offered as seeds; they only start the exchange.
OFFERED = 4 * SEEDS
#: Weight of the class shares in a transition.
PULL = 20.0
END, OTHER = CLASSES, CLASSES + 1  # the end token's class; unknown words, or words that are not seeds
K = CLASSES + 2
END_KEY = 0


def pack(**arrays: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpack(raw: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _encode(size: int):
    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str | None, bool, bytes]] = []
        have = 0
        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(row)
                have += len(row[2])
                if have >= size:
                    yield _coded(rows)
                    rows, have = [], 0
        if rows:
            yield _coded(rows)

    return apply


def _coded(rows: list[tuple[str | None, bool, bytes]]) -> pa.RecordBatch:
    number: dict[bytes, int] = {b"": 0}  # no word is empty: 0 is the end token
    parts, lengths = [], []
    for _, _, text in rows:
        words = text.lower().split()
        for w in words:
            if w not in number:
                number[w] = len(number)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
        lengths.append(len(words) + 1)
    keys = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    keys[0] = END_KEY
    held = np.array([bool(r[1]) for r in rows])
    tokens = np.concatenate(parts)
    taught = np.repeat(~held, lengths)
    counts = np.bincount(tokens[taught], minlength=len(keys))
    payload = pack(tokens=tokens, keys=keys, lengths=np.array(lengths), held=held, ids=[r[0] for r in rows])
    top = np.argsort(-counts, kind="stable")[: OFFERED + 1]
    top = top[(counts[top] > 0) & (top > 0)]
    return pa.RecordBatch.from_arrays(
        [pa.array([payload], pa.binary()), pa.array([keys[top].astype(np.int64)], pa.list_(pa.int64())), pa.array([counts[top]], pa.list_(pa.int64()))],
        ["payload", "top", "top_n"],
    )


class Coded:
    """A block: tokens of all documents end to end, each document closed by the end token."""

    def __init__(self, payload: bytes):
        x = unpack(payload)
        self.tokens, self.keys, self.lengths, self.held, self.ids = x["tokens"], x["keys"], x["lengths"], x["held"], x["ids"]
        self.taught = np.repeat(~self.held, self.lengths)

    def before(self, classes: np.ndarray) -> np.ndarray:
        """Class of the token before each token; of the end token at a document's start."""
        out = np.empty(len(self.tokens), np.int64)
        out[:1] = END
        out[1:] = classes[self.tokens[:-1]]
        return out

    def seed_numbers(self, seeds: np.ndarray) -> np.ndarray:
        """Of each word its place among the sorted seed keys, or -1."""
        at = np.minimum(np.searchsorted(seeds, self.keys), max(0, len(seeds) - 1))
        return np.where(seeds[at] == self.keys, at, -1) if len(seeds) else np.full(len(self.keys), -1)


def _seed_bigrams(seeds: np.ndarray):
    n = len(seeds) + 2  # the end token, and all other words as one

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for b in it:
            for payload in b.column(0):
                c = Coded(payload.as_py())
                if not len(c.tokens):
                    continue
                number = c.seed_numbers(seeds)
                number = np.where(number < 0, n - 1, number)
                number[0] = n - 2
                now = number[c.tokens].astype(np.int64)
                prev = np.empty_like(now)
                prev[0], prev[1:] = n - 2, now[:-1]
                total += np.bincount((prev * n + now)[c.taught], minlength=n * n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "n"])

    return apply


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """The part of the log-likelihood that classes decide, from their bigram counts."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def gains(m: np.ndarray, right: np.ndarray, left: np.ndarray, s: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of each word and class, the gain in likelihood of having the word there rather than nowhere.

    m: class bigram counts; right, left: classes after and before each word, itself left out; s: how often it follows
    itself; of: the class that it leaves."""
    w, k = np.arange(len(of)), m.shape[0]
    rest = np.repeat(m[None], len(of), axis=0)
    rest[w, of] -= right
    rest[w, :, of] -= left
    rest[w, of, of] -= s
    rows, cols = rest.sum(axis=2) + left, rest.sum(axis=1) + right  # wherever the word is, its neighbours have it
    logs, diag = _xlogx(rest), np.arange(k)
    add_row = _xlogx(rest + right[:, None, :]) - logs
    add_col = _xlogx(rest + left[:, :, None]) - logs
    both = _xlogx(rest[:, diag, diag] + right + left + s[:, None]) - logs[:, diag, diag]
    gain = add_row.sum(axis=2) - add_row[:, diag, diag] + add_col.sum(axis=1) - add_col[:, diag, diag] + both
    gain -= _xlogx(rows + (right.sum(axis=1) + s)[:, None]) - _xlogx(rows)
    return gain - _xlogx(cols + (left.sum(axis=1) + s)[:, None]) + _xlogx(cols)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SEED_SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each word, class bigram counts) for counts whose last two rows are the end token and all other words,
    which keep the classes `classes` and `classes + 1`.

    Words start dealt round by frequency. In a sweep every word in turn leaves its class and joins the one
    with the greatest gain in likelihood."""
    n, k = len(bigrams), classes + 2
    b = bigrams.astype(np.float64)
    of = np.empty(n, np.int64)
    order = np.argsort(-b.sum(axis=1)[:-2], kind="stable")
    of[order] = np.arange(n - 2) % classes
    of[-2:] = classes, classes + 1
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    m = member.T @ b @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, s = of[w], b[w, w]
            member[w, a] = 0
            right, left = b[w] @ member, b[:, w] @ member  # without the word itself
            gain = gains(m, right[None], left[None], np.array([s]), np.array([a]))[0]
            best = int(np.argmax(gain[:classes]))
            if gain[best] > gain[a] + 1e-9:
                moved += 1
                for c, sign in ((a, -1), (best, 1)):
                    m[c] += sign * right
                    m[:, c] += sign * left
                    m[c, c] += sign * s
                of[w] = best
            member[w, of[w]] = 1
        if not moved:
            break
    return of[:-2], m


_ASK = "bucket long, block long, packed binary"
_ASK_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("packed", pa.binary())])


def bucket_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(order by bucket and key, bucket numbers, bounds) of a block's words."""
    bucket = keys % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    numbers, first = np.unique(bucket[order], return_index=True)
    return order, numbers.astype(np.int64), [*first.tolist(), len(keys)]


def _neighbours(c: Coded, cls: np.ndarray, block: int, buckets: int) -> pa.RecordBatch:
    """A block's rows for the buckets: of each word its count, how often it follows itself, and the classes around it."""
    now = cls[c.tokens]
    prev, after = c.before(cls), np.append(now[1:], END)
    after[c.tokens == 0] = END
    t, taught = c.tokens.astype(np.int64)[c.taught], c.taught
    counts = np.bincount(t, minlength=len(c.keys))
    twice = np.flatnonzero(c.taught[1:] & (c.tokens[1:] == c.tokens[:-1])) + 1
    itself = np.bincount(c.tokens[twice], minlength=len(c.keys))
    order, numbers, bounds = bucket_order(c.keys, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sides = []
    for side in (prev, after):
        pair, n = np.unique(place[t] * K + side[taught], return_counts=True)
        sides.append((pair, n, np.searchsorted(pair, np.asarray(bounds) * K)))
    rows = []
    for i in range(len(numbers)):
        pick = order[bounds[i] : bounds[i + 1]]
        entry: dict = {"keys": c.keys[pick], "n": counts[pick].astype(np.uint32), "self": itself[pick].astype(np.uint32), "cls": cls[pick].astype(np.uint8)}
        for name, (pair, n, cut) in zip(("prev", "after"), sides, strict=True):
            own = pair[cut[i] : cut[i + 1]]
            word = own // K - bounds[i]
            entry[name] = (np.bincount(word, minlength=len(pick)).astype(np.uint8), (own % K).astype(np.uint8), n[cut[i] : cut[i + 1]].astype(np.uint32))
        rows.append(pack(**entry))
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())], schema=_ASK_SCHEMA
    )


def _first_ask(seeds: np.ndarray, seed_class: np.ndarray, buckets: int):
    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = Coded(payload.as_py())
                number = c.seed_numbers(seeds)
                cls = np.where(number >= 0, np.append(seed_class, OTHER)[number], OTHER)
                cls[0] = END
                yield _neighbours(c, cls, block, buckets)

    return apply


def _told(c: Coded, told: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(training count, class) of each word of a block."""
    order, numbers, bounds = bucket_order(c.keys, buckets)
    replies = dict(zip(told.column("bucket").to_pylist(), told.column("packed").to_pylist(), strict=True))
    n, cls = np.zeros(len(c.keys), np.int64), np.full(len(c.keys), OTHER, np.int64)
    for i, b in enumerate(numbers.tolist()):
        x = unpack(replies[b])
        n[order[bounds[i] : bounds[i + 1]]] = x["n"]
        cls[order[bounds[i] : bounds[i + 1]]] = x["cls"]
    return n, cls


def _ask_again(buckets: int):
    def apply(key: tuple, blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _ASK_SCHEMA.empty_table()
        c = Coded(blocks.column("payload")[0].as_py())
        return pa.Table.from_batches([_neighbours(c, _told(c, told, buckets)[1], key[0].as_py(), buckets)])

    return apply


_PAIR_SCHEMA = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def _class_bigrams(buckets: int):
    def apply(key: tuple, blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _PAIR_SCHEMA.empty_table()
        c = Coded(blocks.column("payload")[0].as_py())
        cls = _told(c, told, buckets)[1]
        total = np.bincount((c.before(cls) * K + cls[c.tokens])[c.taught], minlength=K * K)
        used = np.flatnonzero(total)
        return pa.Table.from_arrays([pa.array(used), pa.array(total[used])], schema=_PAIR_SCHEMA)

    return apply


_TOLD = "block long, bucket long, packed binary, class int, tokens long, words long, once long"
_TOLD_SCHEMA = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int64()), ("packed", pa.binary()), ("class", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64()), ("once", pa.int64())]
)


def moved(m: np.ndarray, of: np.ndarray, n: np.ndarray, itself: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The best class of each word, given the classes around its tokens, before it and after it."""
    smooth = m + 0.1
    size = smooth[:, :CLASSES].sum(axis=0)
    out = (before @ np.log(smooth[:, :CLASSES] / size) + after @ np.log(smooth[:CLASSES, :].T / size)).argmax(axis=1)
    often = np.flatnonzero(n >= EXACT_FROM)
    for at in range(0, len(often), 1024):
        w = often[at : at + 1024]
        right, left, s, a = after[w].astype(np.float64), before[w].astype(np.float64), itself[w].astype(np.float64), of[w]
        own = np.arange(len(w))
        right[own, a] -= s
        left[own, a] -= s
        gain = gains(m, right, left, s, a)
        best = gain[:, :CLASSES].argmax(axis=1)
        stay = (a < CLASSES) & (gain[own, best] <= gain[own, a] + 1e-9)
        out[w] = np.where(stay, a, best)
    return out


def _tell(m: np.ndarray):
    """One bucket: total counts, and the class that each word moves to."""

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        asked = [unpack(p) for p in table.column("packed").to_pylist()]
        keys, at = np.unique(np.concatenate([a["keys"] for a in asked]), return_inverse=True)
        n, itself = (np.bincount(at, np.concatenate([a[f] for a in asked]).astype(np.float64), len(keys)).astype(np.int64) for f in ("n", "self"))
        of = np.zeros(len(keys), np.int64)
        of[at] = np.concatenate([a["cls"] for a in asked])
        sides = []
        for name in ("prev", "after"):
            word = np.repeat(at, np.concatenate([a[name][0] for a in asked]))
            side, count = (np.concatenate([a[name][i] for a in asked]) for i in (1, 2))
            sides.append(np.bincount(word * K + side, count.astype(np.float64), len(keys) * K).astype(np.float32).reshape(-1, K))
        cls = moved(m, of, n, itself, *sides)
        cls = np.where(keys == END_KEY, END, np.where(n == 0, OTHER, cls))
        rows, lo = [], 0
        for a in asked:
            own = at[lo : lo + len(a["keys"])]
            lo += len(own)
            rows.append(pack(n=n[own].astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64), cls=cls[own].astype(np.uint8)))
        k = len(rows)
        known = n > 0
        stats = [np.bincount(cls[known], w[known].astype(np.float64), K).astype(np.int64) for w in (n, np.ones_like(n), (n == 1).astype(np.int64))]
        return pa.Table.from_arrays(
            [
                pa.concat_arrays([table.column("block").combine_chunks(), pa.array([-1] * K, pa.int64())]),
                pa.array([key[0].as_py()] * (k + K), pa.int64()),
                pa.array([*rows, *[None] * K], pa.binary()),
                pa.array([*[-1] * k, *range(K)], pa.int32()),
                *[pa.array([*[0] * k, *s.tolist()], pa.int64()) for s in stats],
            ],
            schema=_TOLD_SCHEMA,
        )

    return apply


_DOC = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_DOC_SCHEMA = pa.schema(
    [("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


class Model:
    """Counts by class: tokens, words and class bigrams; of unknown words the probability."""

    def __init__(self, tokens: np.ndarray, words: np.ndarray, once: int, steps: np.ndarray):
        self.tokens, self.words, self.total = tokens, words, int(tokens.sum())
        self.unknown = (once + 0.5) / (self.total + 1) if words.sum() else 1.0
        self.floor = self.total + 0.5 * (int(words.sum()) + 1)
        share = tokens / max(1.0, tokens.sum())
        self.step = (steps + PULL * share) / (steps.sum(axis=1, keepdims=True) + PULL)

    def emission(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of the probability of words in their classes; of unknown ones, of an unknown word."""
        size = np.maximum(self.tokens + 0.5 * self.words, 0.5)
        known = np.log10((n + 0.5) / size[cls]) + math.log10(max(1 - self.unknown, 1e-300))
        return np.where(n > 0, known, math.log10(self.unknown))


def _score(model: Model, buckets: int):
    with np.errstate(divide="ignore"):
        log_step = np.log10(model.step)
    log_step = np.where(np.isfinite(log_step), log_step, 0.0).ravel()  # classes without words are never reached

    def apply(key: tuple, blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _DOC_SCHEMA.empty_table()
        c = Coded(blocks.column("payload")[0].as_py())
        n, cls = _told(c, told, buckets)
        base, emission = np.log10((n + 0.5) / model.floor), model.emission(n, cls)
        starts = np.concatenate([[0], np.cumsum(c.lengths)[:-1]])
        known = (n > 0)[c.tokens]
        score = emission[c.tokens] + np.where(known, log_step[c.before(cls) * K + cls[c.tokens]], 0.0)
        sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base[c.tokens], score)]
        return pa.Table.from_arrays(
            [pa.array(c.ids, pa.string()), pa.array(c.held), pa.array(c.lengths, pa.int64()), *map(pa.array, sums)], schema=_DOC_SCHEMA
        )

    return apply


def _matrix(pairs: DataFrame, width: int) -> np.ndarray:
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # width squared rows at most
    out = np.zeros(width * width)
    out[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    return out.reshape(width, width)


def coded_blocks(docs: DataFrame, held_out: Column, doc_id: str, text: str, size: int) -> DataFrame:
    """block, payload, top and top_n, written in buckets of block."""
    source = docs.select(F.col(f"`{doc_id}`").cast("string").alias("i"), held_out.alias("h"), as_bytes(f"`{text}`").alias("t"))
    coded = source.mapInArrow(_encode(BLOCK_BYTES), "payload binary, top array<long>, top_n array<long>")
    parts = min(100_000, max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / BLOCK_BYTES)))
    return bucketed(coded.withColumn("block", F.monotonically_increasing_id()), parts, "block")


def classes_of(coded: DataFrame, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """(what buckets tell blocks: counts and classes; class bigram counts of all training text)."""
    offered = coded.select(F.explode(F.arrays_zip("top", "top_n")).alias("x")).groupBy("x.top").agg(F.sum("x.top_n").alias("n"))
    chosen = offered.orderBy(F.col("n").desc(), "top").limit(SEEDS).select("top").toArrow().column("top").to_numpy()
    seeds = np.sort(chosen.astype(np.int64).view(np.uint64)) if len(chosen) else np.zeros(0, np.uint64)
    bigrams = _matrix(coded.select("payload").mapInArrow(_seed_bigrams(seeds), "pair long, n long"), len(seeds) + 2)
    seed_class, m = exchange(bigrams)
    blocks = coded.select("block", "payload")
    asked, told = blocks.mapInArrow(_first_ask(seeds, seed_class, buckets), _ASK), None
    for sweep in range(SWEEPS):
        new = checkpoint(asked.groupBy("bucket").applyInArrow(_tell(m), _TOLD))
        replies = new.filter("class < 0").select("block", "bucket", "packed")
        counted = _matrix(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_class_bigrams(buckets), "pair long, n long"), K)
        if sweep and likelihood(counted) <= likelihood(m):
            break
        told, m = new, counted
        asked = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_ask_again(buckets), _ASK)
    return told, m


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from the documents for which held_out is false. A null or empty text is its end token alone.
    Every row gives one row and counts once, rows with equal ids too; a null id stays null. Without training documents
    every token is unknown and has probability 1. An empty table gives an empty table; other columns are not read."""
    kind = docs.schema[doc_id].dataType
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    coded = coded_blocks(docs, held_out, doc_id, text, size)
    told, steps = classes_of(coded, buckets)
    stats = told.filter("class >= 0").groupBy("class").agg(F.sum("tokens"), F.sum("words"), F.sum("once")).collect()  # K rows
    tokens, words, once = np.zeros(K), np.zeros(K), 0
    for r in stats:
        tokens[r[0]], words[r[0]] = r[1], r[2]
        once += r[3]
    model = Model(tokens, words, once, steps)
    replies = told.filter("class < 0").select("block", "bucket", "packed")
    rows = coded.select("block", "payload").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(model, buckets), _DOC)
    return rows.select(
        F.col("doc_id").cast(kind), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
