"""N-gram Jaccard join by parity sketches.

A document's set is that of its word shingles. Every shingle hashes to one bit of a sketch, and a bit is the parity of how many
shingles hash to it; so the sketches of two sets differ in no more bits than the sets differ in shingles. Sets of a
and b shingles with a Jaccard similarity of s differ in at most (a + b) (1 - s) / (1 + s) shingles.

Sizes fall in bands, each twice as wide as the one before. Each band has its own sketch; its sets meet there those of the
same band, and larger ones that can be similar to them. The sketch is cut into r segments, more than a set can differ
in from a similar one. If at most d of them differ, two sets share r - d whole segments (the pigeonhole); and of
each set the D + 1 segments with most odd bits are enough to meet in, D being the most shingles that it can differ in from
any partner in the band: all sets put their segments in one order, and had two sets nothing in common among these, they
would share fewer than r - d. Each of them becomes a key; empty segments hardly ever do.

Sets that share a key are compared in three steps: by the Hamming distance of short sketches, which is a lower bound like
that of the long ones, then by their whole sets of shingles. First each set meets one set nearby in the same key
(a centre), then a few neighbours of other components, and components are made from the links found each time. Then only pairs
of one key that lie in different components are left; these are all compared, in cells of bounded size. No pair of a key that could change the components is
left out, and a group of thousands of near copies costs a few comparisons for each of its members.

Equal sets are one set. Texts are never gathered in a group: a pair of texts is compared in a row of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import as_bytes, checkpoint, connected_components, mix64, new_path

SHINGLE, NUM, DEN, SEED = 5, 4, 5, 42
#: Segments of a sketch for each one that similar sets can differ in, with room for those of few bits; bits of a segment.
SEGMENTS, BITS = (5, 4), 4096
#: One set in so many is a centre; sets of a key that one task compares with each other.
CENTRE, CELL = 64, 1024
#: A set of more than this share of the rows is hot; there are fewer than its inverse.
HOT = 1000
#: Neighbours of other components that a set meets in each key, before all pairs of these that are left.
NEIGHBOURS = 3
#: Rows of a batch that are worked on at once.
PIECE = 512
#: Numbers of sets that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000


def shingles(text: bytes, n: int = SHINGLE) -> set[bytes]:
    """The distinct shingles of n words (one of all words, if they are fewer), A-Z in lower case; none without words."""
    words = text.lower().split()
    if len(words) <= n:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False)))


def hashed(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles, in order."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles(text, n)], np.uint64))


class Bands:
    """Sizes in bands for similarities of num / den and more: band k has the sizes over 2^(k-1) up to 2^k."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, D) for each band whose sketch a set of this size meets others in, its own first. D is the most
        shingles that it can differ in from a similar set there; with none, equal sets being one, the band is left out."""
        own = (size - 1).bit_length()
        found = [(own, self.allowed(size, size * self.den // self.num))]
        for band in range(own - 1, -1, -1):
            top = 1 << band
            if size * self.num > top * self.den:
                break
            found.append((band, self.allowed(size, top)))
        return [(band, most) for band, most in found if most]

    def allowed(self, a: int, b: int) -> int:
        """In so many shingles can similar sets of a and b differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int) -> int:
        top = 1 << band
        return (self.allowed(top, top * self.den // self.num) + 1) * SEGMENTS[0] // SEGMENTS[1] + 1

    def keys(self, hashes: np.ndarray, band: int, most: int) -> np.ndarray:
        """The keys of a set in the sketch of a band: `most` + 1 of its segments."""
        segments = self.segments(band)
        bits = np.sort(mix64(hashes + np.uint64(band + 1)) % np.uint64(segments * BITS))
        first = np.flatnonzero(np.concatenate([[True], bits[1:] != bits[:-1]]))
        odd = bits[first][np.diff(np.append(first, len(bits))) % 2 == 1]
        segment = (odd // np.uint64(BITS)).astype(np.int64)
        count = np.bincount(segment, minlength=segments)
        # a value stands for the segment and its odd bits; a collision of 64 bits only adds a candidate
        value = mix64(np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 40))
        np.add.at(value, segment, mix64(odd + np.uint64(1 << 60)))
        value = mix64(value)
        return value[np.lexsort((value, -count))[: most + 1]]


def short_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of 2^k bits, some two for each shingle; halves laid on each other give one of half the bits."""
    bits = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    where = (mix64(hashes) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(where, minlength=bits) % 2 == 1, bitorder="little").tobytes()


def folded(sketch: bytes, words: int) -> np.ndarray:
    """The sketch, its halves laid on each other until it has so many numbers of 64 bits."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def differing(a: bytes, b: bytes) -> int:
    """In so many bits do two short sketches differ, on the bits of the shorter one."""
    words = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


_ROWS = StructType().add("doc_id", "long").add("n", "long").add("digest", "binary").add("sketch", "binary").add("text", "binary")


def _with_sets(n: int):
    """(doc_id, n, digest, sketch, text): size and digest of each set (no digest for an empty one); sketch and text only
    with the first row of a set in a partition, so that copies aren't written again and again."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in it:
            for b in (whole.slice(at, PIECE) for at in range(0, whole.num_rows, PIECE)):
                sizes, digests, sketches, texts = [], [], [], []
                for t in b.column(1):
                    text = t.as_py()
                    h = hashed(text, n)
                    digest = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                    new = digest is not None and digest not in seen
                    if new:
                        seen.add(digest)
                    sizes.append(len(h))
                    digests.append(digest)
                    sketches.append(short_sketch(h) if new else None)
                    texts.append(text if new else None)
                made = [pa.array(sizes, pa.int64()), *[pa.array(c, pa.binary()) for c in (digests, sketches, texts)]]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], _ROWS.names)

    return apply


def _keyed(bands: Bands, n: int):
    """(key, set): the keys of each set in its bands. Sets are doubled, and one more where a set is in its own band."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, owners, held = [], [], 0
            names = b.column(0).to_numpy()
            for i, t in enumerate(b.column(1)):
                h = hashed(t.as_py(), n)
                for band, most in bands.of(len(h)):
                    keys.append(bands.keys(h, band, most))
                    owners.append(np.full(len(keys[-1]), 2 * names[i] + (2 * len(h) > 1 << band and len(h) <= 1 << band)))
                    held += len(keys[-1])
                if keys and (held > 200_000 or i + 1 == b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "set"])
                    keys, owners, held = [], [], 0

    return apply


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has too."""
    before: pa.RecordBatch | None = None  # the last row, not yet decided
    before_key, met = None, False
    for b in it:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        same = np.flatnonzero(key[1:] == key[:-1])
        keep = np.zeros(len(key), bool)
        keep[same] = keep[same + 1] = True
        if before is not None:
            again = bool(key[0] == before_key)
            keep[0] |= again
            if met or again:
                yield before
        before, before_key, met = b.slice(len(key) - 1, 1), key[-1], bool(keep[-1])
        if keep[:-1].any():
            yield b.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
    if before is not None and met:
        yield before


def _to_centres(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and at: each set with the centre before it in its key (or the key's first set), and each
    centre with the first set."""
    key, first, centre = None, -1, -1
    for b in it:
        keys, at, sets = b.column("key").to_numpy(), b.column("at").to_numpy(), b.column("set").to_numpy() >> 1
        if not len(keys):
            continue
        place = np.arange(len(keys))
        starts = np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]])
        centres = at % CENTRE == 0
        start = np.maximum.accumulate(np.where(starts, place, -1))
        heads = np.where(start >= 0, sets[np.maximum(start, 0)], first)
        latest = np.maximum.accumulate(np.where(starts | centres, place, -1))
        previous = np.concatenate([[-1], latest[:-1]])
        before = np.where(previous >= 0, sets[np.maximum(previous, 0)], centre)
        partner = np.where(centres, heads, before)
        met = ~starts & (partner != sets)
        pairs = np.unique(np.stack([np.minimum(partner, sets)[met], np.maximum(partner, sets)[met]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        key, first = keys[-1], heads[-1]
        centre = sets[latest[-1]] if latest[-1] >= 0 else centre


def _near(bands: Bands):
    """The pairs whose sizes and short sketches leave them a chance."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = zip(b.column("n_a").to_pylist(), b.column("n_b").to_pylist(), strict=True)
            sketches = zip(b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist(), strict=True)
            keep = [
                bands.den * min(x, y) >= bands.num * max(x, y) and differing(s, t) <= bands.allowed(x, y)
                for (x, y), (s, t) in zip(sizes, sketches, strict=True)
            ]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return apply


def _compared(bands: Bands, n: int):
    """The pairs (a, b) of (a, b, text of a, text of b) whose sets are similar."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for b in it:
            keep = []
            for name, one, other in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if name != last:
                    last, own = name, shingles(one.as_py(), n)
                theirs = shingles(other.as_py(), n)
                both = len(own & theirs)
                keep.append(bands.den * both >= bands.num * (len(own) + len(theirs) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return apply


def _crossing(bands: Bands):
    """Of rows sorted by key, i and j: the pairs of a cell that lie in different components and that sizes and short
    sketches leave a chance. A cell has two blocks of sets at most."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        block, sets, group, n = (rows.column(c).to_numpy() for c in ("block", "set", "group", "n"))
        low, sets = sets & 1 == 1, sets >> 1
        sketches = rows.column("sketch").to_pylist()
        words = min(map(len, sketches)) // 8
        matrix = np.stack([folded(s, words) for s in sketches])
        a, b = [], []
        for x in np.flatnonzero(block == i):
            fits = (block == j) & (group != group[x]) & (low | low[x]) & (bands.den * np.minimum(n, n[x]) >= bands.num * np.maximum(n, n[x]))
            if i == j:
                fits[: x + 1] = False
            others = np.flatnonzero(fits)
            if len(others):
                differ = np.bitwise_count(matrix[others] ^ matrix[x]).sum(axis=1, dtype=np.int64)
                others = others[differ <= (n[others] + n[x]) * (bands.den - bands.num) // (bands.den + bands.num)]
                a.append(np.minimum(sets[others], sets[x]))
                b.append(np.maximum(sets[others], sets[x]))
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the cell that may go on in the next batch
        for b in it:
            if not b.num_rows:
                continue
            cells = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cut = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), len(cells)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if held and tuple(cells[lo].tolist()) != tuple(held[-1].column(c)[0].as_py() for c in ("key", "i", "j")):
                    yield pairs(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return apply


def _chosen(held: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of held whose key is among the ids; these are broadcast up to BROADCAST of them."""
    return held.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, key, "left_semi")


class Join:
    """The distinct sets, the keys that several of them share, and the links found among them."""

    def __init__(self, sets: DataFrame, n: int, num: int, den: int):
        """sets: set (a number), n, sketch, text; one row for each set."""
        self.bands, self.n, self.sets = Bands(num, den), n, sets
        keys = sets.select("set", "text").mapInArrow(_keyed(self.bands, n), "key long, set long")
        keys = keys.repartition("key").withColumn("at", F.pmod(F.xxhash64(F.shiftright("set", 1)), F.lit(1 << 40)))
        self.keys = checkpoint(keys.sortWithinPartitions("key", "at").mapInArrow(_shared, "key long, set long, at long"))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, b): by sizes and sketches, then by whole sets."""

        def side(name: str, held: DataFrame, *columns: str) -> DataFrame:
            return held.select(F.col("set").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

        sized = pairs.join(side("b", self.sets, "n", "sketch"), "b").join(side("a", self.sets, "n", "sketch"), "a")
        near = checkpoint(sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_near(self.bands), "a long, b long"))
        ids = near.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        texts = _chosen(self.sets.select("set", "text"), ids, "set")
        both = near.join(side("b", texts, "text"), "b").join(side("a", texts, "text"), "a").select("a", "b", "text_a", "text_b")
        return checkpoint(both.mapInArrow(_compared(self.bands, self.n), "a long, b long"))

    def centred(self) -> DataFrame:
        """Distinct pairs of each set and a centre of each of its keys."""
        return checkpoint(self.keys.mapInArrow(_to_centres, "a long, b long").distinct())

    def _grouped(self, groups: DataFrame) -> DataFrame:
        """(node, key, set, group): the shared keys with the component of each set."""
        held = self.keys.select("key", "set", F.shiftright("set", 1).alias("node")).join(groups, "node", "left")
        return held.withColumn("group", F.coalesce("component", "node")).drop("component")

    def beside(self, groups: DataFrame, met: DataFrame) -> DataFrame:
        """Distinct pairs of different components that lie NEIGHBOURS places or fewer apart in one of their keys, without
        those met before."""
        order = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(1)), "node")
        before = [F.struct(F.lag("node", i).over(order).alias("node"), F.lag("group", i).over(order).alias("group")) for i in range(1, NEIGHBOURS + 1)]
        held = self._grouped(groups).select("node", "group", F.array(*before).alias("before"))
        held = held.select("node", "group", F.explode("before").alias("x")).filter("x.group <> group")
        pairs = held.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b"))
        return checkpoint(pairs.distinct().join(met, ["a", "b"], "left_anti"))

    def across(self, groups: DataFrame, met: DataFrame, cell: int) -> DataFrame:
        """Distinct pairs that share a key but lie in different components, without those met before."""
        held = self._grouped(groups)
        several = held.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("group").alias("x"), F.max("group").alias("y"))
        several = several.filter("x <> y and rows > 2").select("key", F.ceil(F.col("rows") / cell).cast("int").alias("blocks"))
        held = held.join(several, "key").join(self.sets.select(F.col("set").alias("node"), "n", "sketch"), "node")
        held = held.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
        held = held.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        held = held.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "group", "n", "sketch")
        found = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "set").mapInArrow(_crossing(self.bands), "a long, b long")
        return checkpoint(found.distinct().join(met, ["a", "b"], "left_anti"))

    def components(self, cell: int) -> DataFrame:
        """(node, component) of all sets that have a link."""
        met = self.centred()
        groups = checkpoint(connected_components(self.similar(met)))

        def joined(links: DataFrame) -> DataFrame:
            own = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
            return checkpoint(connected_components(own.unionByName(links)))

        pairs = self.beside(groups, met)
        met, groups = met.unionByName(pairs), joined(self.similar(pairs))
        rest = self.across(groups, met, cell)
        return groups if rest.isEmpty() else joined(self.similar(rest))


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, num: int = NUM, den: int = DEN, cell: int = CELL
) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id: the smallest doc_id reachable over links of documents whose sets
    have num / den or more of their union in common, the document's own included.

    Words are what lies between the characters 0x20 and 0x09-0x0D; a text of fewer than n words is one shingle. Null, empty
    and blank texts have an empty set and no link: each is its own component. Texts are whole. Rows with equal ids each give
    a row; a null id reaches others but is a component's id only where none of its documents has one. An empty table
    gives an empty table; other columns are not read. Candidates and equality of sets go by hashes of 64 and 128 bits, the
    decision on a pair by its shingles."""
    spark = docs.sparkSession
    path = new_path(spark, "sets")
    held = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), as_bytes(f"`{text}`").alias("text"))
    held.mapInArrow(_with_sets(n), _ROWS).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(StructType([*_ROWS.fields]).add("row", "long")).parquet(path)
    owner = F.min(F.when(F.col("text").isNotNull(), F.col("row"))).alias("set")
    distinct = rows.filter("digest is not null").groupBy("digest").agg(owner, F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    distinct = checkpoint(distinct)
    # other partitions may hold a set of this digest with its text
    again = rows.filter("text is not null").select("row", "digest").join(distinct, "digest").filter("row <> set").select("row")
    again = checkpoint(again)
    again = F.broadcast(again) if again.count() <= BROADCAST else again
    sets = rows.filter("text is not null").join(again, "row", "left_anti").select(F.col("row").alias("set"), "n", "sketch", "text")
    groups = checkpoint(Join(sets, n, num, den).components(cell).withColumnRenamed("node", "set"))
    least = groups.join(distinct, "set").groupBy("component").agg(F.min("first_id").alias("component_id")).join(groups, "component")
    chosen = distinct.join(least.select("set", "component_id"), "set", "left")
    chosen = checkpoint(chosen.select("digest", "rows", F.coalesce("component_id", "first_id").alias("component_id")))
    members, total = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest"), rows.count()
    hot = F.broadcast(chosen.filter(F.col("rows") * HOT > total).drop("rows"))  # fewer than HOT sets
    cold = chosen.filter(F.col("rows") * HOT <= total).drop("rows")
    some = members.filter("digest is not null")
    out = some.join(hot, "digest").unionByName(some.join(hot, "digest", "left_anti").join(cold, "digest")).drop("digest")
    return out.unionByName(members.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
