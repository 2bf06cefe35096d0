"""Secret scan in DataFrame expressions only: fixed patterns, and sliding-window entropy over candidate strings.

The base patterns are matched leftmost and without overlap, each kind by itself; the offsets of all matches come from
the lengths of the matches and of the text between them. The method adds spans: candidate strings of a character class
are scanned by a window of WINDOW characters whose Shannon entropy is kept by incremental counts (one count falls, one
rises as the window moves), and a candidate whose highest entropy reaches its class's bound is a span, unless the
allow-list knows it. A character outside the candidates' class ends a candidate. A candidate that a base span overlaps
is a span of its own: both kinds of evidence are listed. Each character is looked at once, so the work is in proportion to a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import carried

#: The base patterns, the group whose length is tested, and its least length in characters.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What a text must hold for a base pattern to be worth matching.
HINT = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")
WINDOW = 20
#: A candidate string: so many characters of these, with a letter and a digit among them, and the padding that may follow.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Class, what all of a candidate must match, its characters by number, and the least entropy in bits of its best
#: window. A candidate belongs to the first class that it matches.
CLASSES = (
    ("entropy_hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
#: Candidates that are known not to be secrets: examples, identifiers with a fixed form, dates and counters.
ALLOW = (
    r"(?i)example|sample|dummy|changeme|placeholder",
    r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"0123456789|(?i)abcdefghij",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*([-_/]?[0-9]{1,4})?$",
)

_SPAN = "struct<kind:string,first:bigint,last:bigint,hit:string>"


def matches(
    text: Column, pattern: str, group: int = 0, least: int = 1, kind: str = "", good: Callable[[Column], Column] = lambda hit: F.lit(True)
) -> Column:
    """All leftmost non-overlapping matches that are good and whose group has at least so many characters:
    struct(kind, first, last, hit) with offsets in code points, the end exclusive. A match starts where the texts between
    and before it end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), tested.alias("tested"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        first = acc["at"] + F.length(row["gap"])
        last = first + F.coalesce(F.length(row["hit"]), F.lit(0))
        new = F.struct(F.lit(kind).alias("kind"), first.cast("long").alias("first"), last.cast("long").alias("last"), row["hit"].alias("hit"))
        keep = (F.length(row["tested"]) >= least) & good(row["hit"])
        return F.struct(last.cast("long").alias("at"), F.when(keep, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, state, step, lambda acc: acc["out"])


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def highest_entropy(text: Column, characters: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of `window` consecutive characters; of the whole if the text is shorter.

    The state holds the count of every character of the class in the window, one letter each, and the sum of n * log2(n).
    A step adds the character that enters and takes out the one that leaves: two counts change, and the sum by their
    differences. The two rows of characters, now and `window` places before, are made once."""
    width = F.least(F.lit(window), F.length(text))
    zero = ord("0")
    start = F.struct(F.lit("0" * len(characters)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("top"), F.lit(0).alias("i"))
    numbers = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(characters)))
    before = F.slice(F.concat(F.array_repeat(F.lit(0), window), numbers), F.lit(1), F.length(text))

    def count(n: Column, at: Column) -> Column:
        return F.ascii(F.substring(n, at, F.lit(1))) - zero

    def put(n: Column, at: Column, value: Column) -> Column:
        return F.overlay(n, F.char(value + zero), at, F.lit(1))

    def step(acc: Column, row: Column) -> Column:
        enters, leaves, i = row["enters"], row["leaves"], acc["i"] + 1
        without = F.when(leaves > 0, put(acc["n"], leaves, count(acc["n"], leaves) - 1)).otherwise(acc["n"])
        n_out, n_in = count(acc["n"], leaves), count(without, enters)
        fall = F.when(leaves > 0, _weight(n_out) - _weight(n_out - 1)).otherwise(F.lit(0.0))
        s = acc["s"] - fall + _weight(n_in + 1) - _weight(n_in)
        entropy = F.log2(width.cast("double")) - s / width
        top = F.when(i >= width, F.greatest(acc["top"], entropy)).otherwise(acc["top"])
        return F.struct(put(without, enters, n_in + 1).alias("n"), s.alias("s"), top.alias("top"), i.alias("i"))

    return F.aggregate(F.arrays_zip(numbers.alias("enters"), before.alias("leaves")), start, step, lambda acc: acc["top"])


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by kind as listed and then by start."""
    none = F.array().cast(f"array<{_SPAN}>")
    parts = [
        F.when(text.rlike(hint), matches(text, pattern, group, least, kind)).otherwise(none)
        for (kind, pattern, group, least), hint in zip(BASE, HINT, strict=True)
    ]
    return F.concat(*parts)


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of candidates with a window of high entropy that the allow-list doesn't know."""
    none = F.array().cast(f"array<{_SPAN}>")

    def likely(hit: Column) -> Column:
        listed = F.lit(False)
        for pattern in allow:
            listed = listed | hit.rlike(pattern)
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~listed

    found = F.when(text.rlike(CANDIDATE), matches(text, CANDIDATE, good=likely)).otherwise(none)

    def judged(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, shape, characters, least in reversed(CLASSES):
            high = F.when(highest_entropy(m["hit"], characters) >= least, F.lit(name))
            kind = F.when(m["hit"].rlike(shape), high).otherwise(kind)
        return F.struct(kind.alias("kind"), m["first"].alias("first"), m["last"].alias("last"), m["hit"].alias("hit"))

    return F.filter(F.transform(found, judged), lambda m: m["kind"].isNotNull())


def listing(spans: Column) -> Column:
    """kind:start:end of spans by start, then by kind as listed, comma-joined."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate([*[b[0] for b in BASE], *[c[0] for c in CLASSES]]) for x in (k, i)])
    keyed = F.transform(
        spans, lambda m: F.struct(m["first"].alias("a"), F.element_at(order, m["kind"]).alias("b"), m["last"].alias("c"), m["kind"].alias("d"))
    )
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda m: F.concat_ws(":", m["d"], m["a"].cast("string"), m["c"].cast("string"))), ","
    )


def find_secrets(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with _base and _spans: arrays of struct(kind, first, last, hit), the base spans and all spans.

    Offsets count code points; a span of an `assign` pattern is the whole assignment. Null and empty texts have no
    spans. Every row gives one row, repeated rows too. Other columns pass through whatever their names; one named like
    an output is replaced by it. An empty table gives an empty table."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    parts = docs.select(carried(docs, "_base", "_spans"), base_spans(whole).alias("base"), entropy_spans(whole, allow).alias("added"))
    return parts.select("row.*", F.col("base").alias("_base"), F.concat("base", "added").alias("_spans"))
