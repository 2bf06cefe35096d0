"""Deduplication of chunks by normalised hash and by SimHash, with the keep rule of a list scanned in order."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from corpusloom.functions.components import connected_components
from corpusloom.functions.pieces import pieced
from corpusloom.functions.storage import checkpoint, spread

BITS, THRESHOLD = 64, 0.95
#: Keys of a value in near_values at most, where the distance allows a choice.
KEYS = 32
#: Pairs that one task scans in order at a time; more are dealt by component, and by blocks of a component.
SCAN = 1_000_000
#: Rows of the first part that near_dropped takes, about.
PART = 20_000


nfkc = pieced(lambda t: unicodedata.normalize("NFKC", t), StringType())


#: Besides single blanks and line ends, the white space that NFKC leaves; beyond ASCII it makes all other white space a blank.
SPACES = ("  ", "\t", "\x0b", "\f", "\r", "\x85", "\u1680", "\u2028", "\u2029")


def normalize_text(text: Column) -> Column:
    """NFKC, lower case, white space collapsed and trimmed; null is empty. Texts that are ASCII skip the Python step, and a
    pattern, which is tried at every character, searches only texts that have white space to collapse."""
    whole = F.coalesce(text, F.lit(""))
    ascii_ = (F.octet_length(whole) == F.length(whole)) & F.is_valid_utf8(whole)
    other = F.when(~ascii_, whole)  # null where ASCII, so that such texts are not sent
    line = F.replace(F.lower(F.coalesce(nfkc(other), whole)), F.lit("\n"), F.lit(" "))
    # bound as a lambda variable, so that it is computed once
    odd = lambda x: reduce(lambda a, b: a | b, [x.contains(c) for c in SPACES])
    return F.trim(F.transform(F.array(line), lambda x: F.when(odd(x), F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x))[0])


def content_hash(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def first_or_last(order: str, keep: str) -> Column:
    return F.col(order).asc() if keep == "first" else F.col(order).desc()


def mark_exact(df: DataFrame, order: str, text: str = "text", keep: str = "first") -> DataFrame:
    """df with content_hash and is_exact_duplicate. order must be unique; the kept row of a hash is found by a grouped
    minimum or maximum, so a hash of very many rows is not sorted in one task."""
    hashed = spread(df).withColumn("content_hash", content_hash(normalize_text(F.col(text))))
    pick = F.min(order) if keep == "first" else F.max(order)
    kept = hashed.groupBy("content_hash").agg(pick.alias("_kept"))
    return hashed.join(kept, "content_hash").withColumn("is_exact_duplicate", F.col(order) != F.col("_kept")).select(*df.columns, "content_hash", "is_exact_duplicate")


def dedup_exact(df: DataFrame, order: str, text: str = "text", keep: str = "first") -> DataFrame:
    return mark_exact(df, order, text, keep).filter(~F.col("is_exact_duplicate")).select(*df.columns)


_TOKEN = re.compile(r"\w+")


def _print_of(text: str) -> int:
    total = np.zeros(BITS, np.int64)
    counts = Counter(_TOKEN.findall(text))
    if counts:
        digests = b"".join(hashlib.md5(t.encode()).digest()[8:][::-1] for t in counts)
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        total = (2 * bits - 1).T @ np.fromiter(counts.values(), np.int64, len(counts))
    return int(np.packbits((total > 0).astype(np.uint8), bitorder="little").view("<i8")[0])


simhash_of_normal = pieced(_print_of, LongType())


def simhash64(text: Column) -> Column:
    """SimHash of the normalised words, weighted by count, from the low 64 bits of their MD5; 0 without words."""
    return simhash_of_normal(normalize_text(text))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / BITS


def max_distance(threshold: float) -> int:
    """The greatest number of differing bits with 1 - d / 64 >= threshold; -1 if none."""
    return max([d for d in range(BITS + 1) if 1 - d / BITS >= threshold], default=-1)


def bands(value: Column, n: int) -> Column:
    """The bits in n bands, as array of struct(no, bits)."""
    edges = [BITS * i // n for i in range(n + 1)]
    cut = [
        F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(F.shiftleft(value, BITS - edges[i + 1]), BITS - edges[i + 1] + edges[i]).alias("bits"))
        for i in range(n)
    ]
    return F.array(*cut)


def masks(distance: int) -> list[int]:
    """Masks of which two values within the distance share the bits of at least one: of distance + m bands m are equal.
    Three bands of six (distance 3) make keys of 32 bits, so that values that are not near seldom meet."""
    free = max([m for m in (1, 2, 3) if distance + m <= BITS and math.comb(distance + m, m) <= KEYS], default=1)
    n = min(distance + free, BITS)
    edges = [BITS * i // n for i in range(n + 1)]
    spans = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [signed(sum(c)) for c in itertools.combinations(spans, free)]


def near_values(values: DataFrame, distance: int, others: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with a < b of distinct values (column simhash) within a distance, or with a of values and b of others, which
    hold none of them. Pairs are found by their equal bands, each by the first key that its values share. The join is never
    a broadcast: its keys are as many times the values as there are masks, which Spark's sizes of the exploded rows leave out."""
    keys = masks(distance)
    cut = [F.struct(F.lit(i).alias("no"), F.col("simhash").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(keys)]
    keyed = lambda df: df.select("simhash", F.explode(F.array(*cut)).alias("b")).select("simhash", "b.no", "b.bits")
    left, right = keyed(values).withColumnRenamed("simhash", "a"), keyed(values if others is None else others).withColumnRenamed("simhash", "b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differing.bitwiseAND(F.lit(m).cast("long")) == 0, i) for i, m in enumerate(keys)])
    wanted = F.bit_count(differing) <= distance
    met = left.hint("merge").join(right, ["no", "bits"]).filter((F.col("a") < F.col("b")) & wanted if others is None else wanted)
    return met.filter(F.col("no") == first).select("a", "b")


def near_pairs(df: DataFrame, order: str, threshold: float = THRESHOLD, simhash: str = "simhash") -> DataFrame:
    """Pairs (earlier, later) of rows with similar hashes. Distinct values meet first; equal values pair by themselves."""
    d = max_distance(threshold)
    if d < 0:
        return df.select(F.col(order).alias("earlier"), F.col(order).alias("later")).filter(F.lit(False))
    rows = checkpoint(df.select(F.col(order).alias("r"), F.col(simhash).alias("simhash")))  # hashed once, read five times
    values = rows.select("simhash").distinct()
    met = near_values(values, d)
    same = values.select(F.col("simhash").alias("a"), F.col("simhash").alias("b"))
    pairs = met.unionByName(same)
    out = (
        pairs.join(rows.select(F.col("simhash").alias("a"), F.col("r").alias("x")), "a")
        .join(rows.select(F.col("simhash").alias("b"), F.col("r").alias("y")), "b")
        .filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    )
    return out.select(F.least("x", "y").alias("earlier"), F.greatest("x", "y").alias("later"))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs by component, later and earlier row: an earlier row is decided before any pair in which it could make another
    fall. What has fallen is held for one component at a time."""
    fallen, own = set(), None
    for b in batches:
        new, groups = [], []
        for component, earlier, later in zip(b["component"], b["earlier"], b["later"], strict=True):
            if component != own:
                fallen, own = set(), component
            if earlier not in fallen and later not in fallen:
                fallen.add(later)
                new.append(later)
                groups.append(component)
        yield pd.DataFrame({"r": pd.Series(new, dtype=b["later"].dtype), "component": pd.Series(groups, dtype=b["component"].dtype)})


def _scanned(pairs: DataFrame) -> DataFrame:
    kind = f"r {pairs.schema['later'].dataType.simpleString()}, component {pairs.schema['component'].dataType.simpleString()}"
    return pairs.sortWithinPartitions("component", "later", "earlier").select("component", "earlier", "later").mapInPandas(_scan, kind)


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs of a component in one task. They are dealt by a hash of the component: Spark drops a repartition by the key of a join
    before it, and where it then broadcasts that join's other side, nothing keeps a component together."""
    return pairs.repartition(F.xxhash64("component"))


def fuzzy_dropped(pairs: DataFrame, keep: str = "first", scan: int = SCAN) -> DataFrame:
    """Rows (column r) that a scan in order drops: with keep first, those with an earlier similar row that stays; with
    keep last, those with any later similar row.

    Pairs up to `scan` are scanned in order by one task. Of more, all rows without an earlier similar row stay, those similar to
    them fall, and pairs with rows that fell are gone; this is repeated while it halves the pairs. What is still more
    is dealt by connected component, as components decide for themselves, and a task scans the components it has one after the other. A component of more pairs than that is
    cut in order into blocks of about so many; the first block of each such component is scanned, then the second, and so on, each
    without the pairs whose rows have fallen. So no task scans more at a time, and the blocks of the largest component are
    the number of rounds, whatever the pairs look like."""
    if keep == "last":
        return pairs.select(F.col("earlier").alias("r")).distinct()
    open_ = checkpoint(pairs.distinct())
    out, before = pairs.select(F.col("later").alias("r")).limit(0), 0
    while (n := open_.count()) > scan and (not before or 2 * n <= before):
        before, later = n, open_.select(F.col("later").alias("earlier")).distinct()
        fell = checkpoint(open_.join(later, "earlier", "left_anti").select(F.col("later").alias("r")).distinct())
        out = out.unionByName(fell)
        for name in ("earlier", "later"):
            open_ = open_.join(fell.select(F.col("r").alias(name)), name, "left_anti")
        open_ = checkpoint(open_)
    if n <= scan:
        return out.unionByName(_scanned(open_.withColumn("component", F.lit(0)).coalesce(1)).select("r"))
    groups = checkpoint(connected_components(open_.select(F.col("earlier").alias("a"), F.col("later").alias("b"))))
    named = checkpoint(open_.join(groups.withColumnRenamed("node", "earlier"), "earlier"))
    huge = checkpoint(named.groupBy("component").agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") > scan))  # at most a row for `scan` pairs
    dropped = out.unionByName(_scanned(_dealt(named.join(huge, "component", "left_anti"))).select("r"))
    total = huge.agg(F.sum("pairs").alias("n")).first()["n"]
    if not total:
        return dropped
    wide = named.join(F.broadcast(huge.select("component")) if huge.count() <= scan else huge.select("component"), "component", "left_semi")
    blocks = wide.repartitionByRange(math.ceil(total / max(1, scan)), "component", "later", "earlier").withColumn("_at", F.spark_partition_id())
    blocks = checkpoint(blocks)
    turn = F.row_number().over(Window.partitionBy("component").orderBy("_at"))
    turns = checkpoint(blocks.select("component", "_at").distinct().withColumn("turn", turn))
    blocks, fallen = blocks.join(F.broadcast(turns), ["component", "_at"]), None  # a row for a block and component
    for i in range(1, turns.agg(F.max("turn")).first()[0] + 1):
        own = blocks.filter(F.col("turn") == i).select("component", "earlier", "later")
        for name in ("earlier", "later") if fallen is not None else ():
            own = own.join(fallen.select("component", F.col("r").alias(name)), ["component", name], "left_anti")
        new = checkpoint(_scanned(_dealt(own)))
        fallen = new if fallen is None else fallen.unionByName(new)
    return dropped.unionByName(fallen.select("r"))


def near_dropped(rows: DataFrame, order: str, threshold: float = THRESHOLD, part: int = PART, scan: int = SCAN) -> DataFrame:
    """fuzzy_dropped(near_pairs(rows), "first") for rows (order, simhash) of different hashes, without making all pairs, whose
    number grows faster than the rows.

    The rows are taken in order in parts, each three times as long as all before it. Rows of a part that are similar to a row
    that stayed before fall; then the pairs of the others among themselves are scanned. So rows that fell meet no
    later rows, and dense groups are mostly gone after the first parts."""
    distance = max_distance(threshold)
    n = max(1, math.ceil(rows.count() / part))
    rows = checkpoint(rows.select(order, "simhash").repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    parts = (rows.agg(F.max("_part")).first()[0] or 0) + 1
    stayed, dropped, low, high = None, None, 0, max(1, parts // n)
    while low < parts:
        own = rows.filter((F.col("_part") >= low) & (F.col("_part") < high)).select(order, "simhash")
        if stayed is not None:
            hit = near_values(stayed, distance, own).select(F.col("b").alias("simhash"), F.lit(True).alias("_hit")).distinct()
            own = checkpoint(own.join(hit, "simhash", "left"))
            dropped = dropped.unionByName(own.filter("_hit").select(F.col(order).alias("r")))
            own = own.filter("_hit is null").select(order, "simhash")
        fell = checkpoint(fuzzy_dropped(near_pairs(own, order, threshold), scan=scan))
        dropped = fell if dropped is None else dropped.unionByName(fell)
        stays = checkpoint(own.join(fell.withColumnRenamed("r", order), order, "left_anti").select("simhash"))
        stayed = stays if stayed is None else stayed.unionByName(stays)
        low, high = high, 4 * high
    return dropped


def mark_duplicates(df: DataFrame, order: str, text: str = "text", keep: str = "first", threshold: float = THRESHOLD) -> DataFrame:
    """df with content_hash, is_exact_duplicate and is_fuzzy_duplicate; the fuzzy step runs over the exact survivors. Texts are
    read once, for both hashes, and only these are shuffled."""
    if threshold >= 1.0:
        return mark_exact(df, order, text, keep).withColumn("is_fuzzy_duplicate", F.lit(False))
    normal = spread(df.select(order, text)).select(order, normalize_text(F.col(text)).alias("_normal"))
    hashed = checkpoint(normal.select(order, content_hash(F.col("_normal")).alias("content_hash"), simhash_of_normal(F.col("_normal")).alias("simhash")))
    pick = F.min if keep == "first" else F.max
    left = hashed.filter(F.col(order).isNotNull()).groupBy("content_hash").agg(pick(F.struct(order, "simhash")).alias("m"))
    left = checkpoint(left.select("m.*"))
    # of rows with equal hashes all but the first (or last) fall whatever else happens: only that one is compared
    ends = checkpoint(left.groupBy("simhash").agg(pick(order).alias(order)))
    fallen = near_dropped(ends, order, threshold) if keep == "first" else fuzzy_dropped(near_pairs(ends, order, threshold), keep)
    equal = left.select(order).join(ends.select(order), order, "left_anti")
    fallen = fallen.select(F.col("r").alias(order)).unionByName(equal).withColumn("_f", F.lit(True))
    marks = hashed.select(order, "content_hash").join(left.select(order, F.lit(True).alias("_left")), order, "left").join(fallen, order, "left")
    marks = marks.select(order, "content_hash", F.col("_left").isNull().alias("is_exact_duplicate"), F.col("_f").isNotNull().alias("_f"))
    fuzzy = F.coalesce("_f", F.lit(False)).alias("is_fuzzy_duplicate")
    return df.join(marks, order, "left").select(*df.columns, "content_hash", "is_exact_duplicate", fuzzy)


def dedup_stats(marked: DataFrame) -> DataFrame:
    exact, fuzzy = F.count_if(F.col("is_exact_duplicate")), F.count_if(F.col("is_fuzzy_duplicate"))
    total = F.count(F.lit(1))
    return marked.agg(
        total.alias("input"), (total - exact - fuzzy).alias("output"), exact.alias("exact_removed"), fuzzy.alias("fuzzy_removed"),
        F.when(total > 0, F.round((exact + fuzzy) / total * 100, 2)).otherwise(0.0).alias("rate_percent"),
    )


def duplicates_by_source(marked: DataFrame, source_type: str, source: str, limit: int = 20) -> DataFrame:
    """Removed rows by `source_type:source`, fuzzy ones apart; the sources with most."""
    key = F.concat(F.coalesce(F.col(source_type), F.lit("unknown")), F.lit(":"), F.coalesce(F.col(source), F.lit("unknown")))
    named = F.when(F.col("is_fuzzy_duplicate"), F.concat(key, F.lit(" (fuzzy)"))).otherwise(key)
    removed = marked.filter(F.col("is_exact_duplicate") | F.col("is_fuzzy_duplicate"))
    return removed.groupBy(named.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "key").limit(limit)


def duplicate_groups(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Hashes of more than one row: number of rows and the first of them. The members are rows of mark_exact."""
    hashed = df.select(F.col(order).alias("r"), content_hash(normalize_text(F.col(text))).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first")).filter("n > 1")


def audit_duplicates(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """One row over all rows: points, distinct texts within a source, groups of copies, surplus rows and their share."""
    counts = df.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("s"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("h")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    surplus = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return counts.agg(
        total.alias("points"), F.count(F.lit(1)).alias("unique"), F.count_if(F.col("n") > 1).alias("groups"), surplus.alias("surplus"),
        F.when(total > 0, F.round(surplus / total * 100, 2)).otherwise(0.0).alias("rate_percent"),
    )
