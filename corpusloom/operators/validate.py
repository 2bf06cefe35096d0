"""Answer validation: issues found in a response, and a confidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of uncertainty, of details that are often made up, of citations and of claims, in order.
UNCERTAIN = (
    r"as of my (knowledge|training|last update)", r"as of my cutoff", r"i don'?t have access to", r"i cannot (verify|confirm|access|check)",
    r"i'?m not able to (verify|confirm|access|check)", r"i don'?t have (current|real-?time|live|up-to-date) (information|data|access)",
    r"my (training|knowledge) (data|cutoff)", r"i cannot browse", r"i'?m unable to access", r"i believe (this|that|it) (may|might|could)",
    r"if i (recall|remember) correctly", r"i think (this|that|it) (should|would|could|might)", r"i'?m not (entirely |completely |100% )?sure",
    r"i'?m not certain", r"i cannot guarantee", r"this (may|might|could) (not )?be (accurate|correct|up-to-date)",
    r"i'?m (just )?making (this|an) (assumption|guess)", r"i'?m guessing", r"this is (just )?my (assumption|speculation|guess)",
    r"i don'?t have (specific|exact|precise) (information|data|details)", r"i cannot find (any|specific) (information|documentation|reference)",
    r"(typically|usually|generally),? (i would|one would|you would) expect", r"based on (common|general|typical) (practice|patterns|conventions)",
    r"(from|in) my (experience|understanding)",
)
FABRICATED = (
    r"version (\d+\.\d+\.\d+\.\d+)",
    r"released (on|in) (january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2},? \d{4}",
    r"(visit|see|check|go to) (https?://[^\s]+)",
    r"(approximately|about|around|roughly) \d+\.?\d*%",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
)
CITATIONS = (
    r"\[source\s*\d+\]", r"\[source\s+\d+\s*[-–]\s*[^\]]+\]", r"according to (source|the documentation|the context)",
    r"from the (provided |given )?(context|documentation|sources)", r"as (mentioned|stated|shown|described) in",
)
CLAIMS = (
    r"you (must|should|need to|have to)", r"it is (required|necessary|mandatory|essential) to", r"the (correct|proper|right|best) way", r"always use",
    r"never use", r"this will (cause|result in|lead to)", r"by default,? (\w+ )*(is|are|will)", r"the (official|recommended|standard) (approach|method|way)",
)
COMMON_WORDS = (  # fixed values
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has",
    "have", "been", "will", "more", "when", "who", "which", "their", "said", "each", "she", "how", "this", "from",
    "they", "with", "that", "what", "were", "would", "there", "about", "into", "than", "them", "could", "only",
    "other", "then", "these", "also", "after", "before", "some", "such", "very", "just", "over", "made", "your",
    "source", "unknown",
)
SHORT, LONG = 10, 50_000

_ISSUE = "struct<code:string,message:string,severity:string,position:int,snippet:string>"
NONE = "array<struct<first:int,hit:string>>"


def needed(pattern: str) -> str:
    """The longest lower-case piece of text that every match of a pattern holds: what is left between groups, classes,
    escapes and characters that may be missing. Empty where that is not plain, as with nested groups."""
    one = r"\([^()]*\)|\[[^\]\[]*\]|\\[dDsSwWbB.]"
    fixed = re.sub(rf"({one}|[^\\])([*?]|\{{\d+,?\d*\}})|({one})\+?|[+.^$]", "\0", pattern)
    return "" if re.search(r"[()\[\]{}|*?\\]", fixed) else max(fixed.lower().split("\0"), key=len)


def positions(text: Column, pattern: str, low: Column | None = None) -> Column:
    """All matches with their starts, from 0. The pattern is tried on texts that hold what it needs; low: the text in
    lower case, where it is known."""
    p = "(?i)" + pattern
    part = needed(pattern)
    some = text.rlike(p) if len(part) < 2 else (F.lower(text) if low is None else low).contains(part) & text.rlike(p)
    rows = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("out"))

    def step(acc: Column, row: Column) -> Column:
        first = acc["at"] + F.length(row["gap"])
        one = F.array(F.struct(first.alias("first"), row["hit"].alias("hit")))
        end = first + F.coalesce(F.length(row["hit"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(row["hit"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(some, F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(NONE))


def all_positions(text: Column, patterns: tuple[str, ...]) -> Column:
    """The same for several patterns, in order; the text and its lower case are bound, so that they are found once."""
    bound = F.array(F.struct(text.alias("text"), F.lower(text).alias("low")))
    return F.transform(bound, lambda x: F.concat(*[positions(x["text"], p, x["low"]) for p in patterns]))[0]


def issue(code: str, message: Column, severity: str, position: Column | None = None, snippet: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity"),
        (null.cast("int") if position is None else position).alias("position"), (null.cast("string") if snippet is None else snippet).alias("snippet"),
    )


def _around(text: Column, first: Column, length: Column, before: int, after: int) -> Column:
    low = F.greatest(first - before, F.lit(0))
    return F.substring(text, low + 1, first + length + after - low)


def length_issues(text: Column) -> Column:
    n = F.length(text)
    return F.array_compact(F.array(
        F.when(n < SHORT, issue("RESPONSE_TOO_SHORT", F.format_string("Response has %d characters, fewer than %d", n, F.lit(SHORT)), "warning")),
        F.when(n > LONG, issue("RESPONSE_TOO_LONG", F.format_string("Response has %d characters, more than %d", n, F.lit(LONG)), "warning")),
    ))


def markers(text: Column) -> Column:
    """Uncertainty markers with starts; of equal matched texts the first."""
    found = all_positions(text, UNCERTAIN)
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(NONE).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        known = F.array_contains(acc["seen"], m["hit"])
        return F.struct(
            F.when(known, acc["seen"]).otherwise(F.array_append(acc["seen"], m["hit"])).alias("seen"),
            F.when(known, acc["out"]).otherwise(F.concat(acc["out"], F.array(m))).alias("out"),
        )

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def marker_issues(text: Column, found: Column) -> Column:
    return F.transform(
        found,
        lambda m: issue("HALLUCINATION_MARKER", F.concat(F.lit("Uncertain wording: "), m["hit"]), "warning", m["first"], _around(text, m["first"], F.length(m["hit"]), 20, 20)),
    )


def fabrication_issues(text: Column) -> Column:
    found = all_positions(text, FABRICATED)
    return F.transform(
        found,
        lambda m: issue("POTENTIAL_FABRICATION", F.concat(F.lit("Detail without support: "), m["hit"]), "info", m["first"], _around(text, m["first"], F.length(m["hit"]), 20, 20)),
    )


def citation_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit("(?i)" + p)) for p in CITATIONS])


def citation_issues(text: Column, context: Column, n_sources: Column, count: Column) -> Column:
    """No citation in a long response with context; numbers of sources that do not exist."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[source\s*(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long"))
    wrong = F.filter(numbers, lambda x: x.isNull() | (x < 1) | (x > n_sources))
    none = (F.length(F.coalesce(context, F.lit(""))) > 0) & (count == 0) & (F.length(text) > 200)
    no_citation = F.array_compact(F.array(F.when(none, issue("NO_SOURCE_CITATIONS", F.lit("Response uses context without citing it"), "info"))))
    invalid = F.transform(
        wrong, lambda x: issue("INVALID_SOURCE_REFERENCE", F.format_string("Source %s of %d", x.cast("string"), n_sources), "error", None, F.format_string("[Source %s]", x.cast("string")))
    )
    return F.concat(no_citation, F.when(n_sources > 0, invalid).otherwise(F.array().cast(f"array<{_ISSUE}>")))


def claims(text: Column) -> Column:
    """Claims without a citation in the 200 characters from their start."""
    found = all_positions(text, CLAIMS)
    cited = "(?i)" + "|".join(CITATIONS)
    return F.filter(found, lambda m: ~F.substring(text, m["first"] + 1, F.lit(200)).rlike(cited))


def claim_issues(text: Column, found: Column) -> Column:
    return F.transform(
        found, lambda m: issue("UNSUPPORTED_CLAIM", F.concat(F.lit("Claim without citation: "), m["hit"]), "info", m["first"], _around(text, m["first"], F.length(m["hit"]), 10, 50))
    )


def key_words(text: Column) -> Column:
    """Distinct lower-case ASCII words of three letters or more that are not common."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), F.lit(0)), lambda w: F.lower(w))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, COMMON_WORDS)))


def share_of(own: Column, given: Column) -> Column:
    return F.when((F.size(own) > 0) & (F.size(given) > 0), F.size(F.array_intersect(own, given)) / F.size(own))


def grounding(text: Column, context: Column) -> Column:
    """Share of the response's key words that the context has; null if either has none."""
    return share_of(key_words(text), key_words(context))


def low_grounding(share: Column, n_words: Column) -> Column:
    low = (share < 0.1) & (n_words > 20)
    return F.array_compact(F.array(F.when(low, issue("LOW_CONTEXT_GROUNDING", F.format_string("%.1f%% of the words are in the context", share * 100), "warning"))))


def grounding_issues(text: Column, context: Column) -> Column:
    return low_grounding(grounding(text, context), F.size(key_words(text)))


def validate_answers(answers: DataFrame, response: str = "response", context: str = "context", sources: str = "n_sources") -> DataFrame:
    """answers with issues, n_markers, n_citations, n_claims, confidence and is_valid. A null or blank response is
    invalid with confidence 0."""
    text, given = F.coalesce(F.col(response), F.lit("")), F.coalesce(F.col(context), F.lit(""))
    n = F.coalesce(F.col(sources), F.lit(0))
    out = (
        answers.withColumn("_m", markers(text))
        .withColumn("n_citations", citation_count(text))
        .withColumn("_c", F.when(given != "", claims(text)).otherwise(F.array().cast(NONE)))
        .withColumn("n_markers", F.size("_m"))
        .withColumn("n_claims", F.size("_c"))
        # one step each, so that the words of a text are found once for all that read them
        .withColumn("_own", key_words(text)).withColumn("_given", key_words(given))
        .withColumn("_n_own", F.size("_own")).withColumn("_share", share_of(F.col("_own"), F.col("_given")))
    )
    blank = text.rlike(r"^(?U)\s*$")
    empty = F.array(issue("EMPTY_RESPONSE", F.lit("Response is empty"), "error"))
    found = F.concat(
        length_issues(text), marker_issues(text, F.col("_m")), fabrication_issues(text), citation_issues(text, given, n, F.col("n_citations")),
        claim_issues(text, F.col("_c")), low_grounding(F.col("_share"), F.col("_n_own")),
    )
    out = out.withColumn("issues", F.when(blank, empty).otherwise(found)).withColumn("_blank", blank)
    return out.withColumn("confidence", F.when(F.col("_blank"), 0.0).otherwise(confidence(F.col("issues"), n, F.col("n_citations"), F.col("n_markers"), F.col("n_claims")))).withColumn(
        "is_valid", ~F.exists("issues", lambda i: i["severity"] == "error")
    ).drop("_m", "_c", "_own", "_given", "_n_own", "_share", "_blank")


def confidence(issues: Column, n_sources: Column, citations: Column, n_markers: Column, n_claims: Column) -> Column:
    def count(severity: str) -> Column:
        return F.size(F.filter(issues, lambda i: i["severity"] == severity))

    cited = F.when((n_sources > 0) & (citations > 0), F.least(F.lit(0.1), citations * 0.02)).otherwise(0.0)
    raw = 1.0 - count("error") * 0.25 - count("warning") * 0.10 - count("info") * 0.02 + cited - n_markers * 0.15 - F.least(n_claims, F.lit(5)) * 0.05
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
