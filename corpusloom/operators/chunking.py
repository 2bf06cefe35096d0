"""Structure-aware chunking of markdown: content types, code blocks, header sections and sized chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions.pieces import pieced
from corpusloom.functions.storage import spread

#: Size, overlap and separators of each content type.
SPLITS = {
    "prose": (1000, 200, ("\n\n", "\n", ". ", " ", "")),
    "code": (1500, 100, ("\n\n", "\n", " ", "")),
    "list": (800, 150, ("\n\n", "\n- ", "\n* ", "\n", " ", "")),
    "table": (2000, 50, ("\n\n", "\n", "")),
    "mixed": (1000, 200, ("\n\n", "\n", ". ", " ", "")),
}
LEGACY = (1000, 200, ("\n\n", "\n", " ", ""))
CODE = r"(?s)```(\w*)\n(.*?)```"
#: Code blocks longer than twice the code size are cut into pieces of that size.
CODE_SIZE = SPLITS["code"][0]
#: What \\s matches in a pattern without (?U).
_SPACE = " \t\n\x0b\f\r"


def pieces(text: str, separator: str) -> list[str]:
    """A text cut before every separator, which stays with what follows."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *[separator + r for r in rest]] if p]


def merge(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts packed greedily into chunks of at most `size` characters; a new chunk starts with the last parts of the one
    before, `overlap` characters at most."""
    out, now, total = [], [], 0
    for part in parts:
        if now and total + len(part) > size:
            out.append("".join(now).strip())
            while now and (total > overlap or total + len(part) > size):
                total -= len(now.pop(0))
        now.append(part)
        total += len(part)
    out.append("".join(now).strip())
    return [c for c in out if c]


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """A text cut at its coarsest separator, what is still too long at the next one, and the rest packed."""
    here = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out, small = [], []
    for part in pieces(text, separators[here]):
        if len(part) < size or here + 1 == len(separators):
            small.append(part)
        else:
            out += merge(small, size, overlap)
            small = []
            out += split_text(part, size, overlap, separators[here + 1 :])
    return out + merge(small, size, overlap)


def cut_code(block: str, size: int = CODE_SIZE) -> list[str]:
    """A fenced block cut between lines into fenced blocks of about `size` characters."""
    m = re.fullmatch(r"(?s)```(\w*)\n(.*?)```", block)
    if not m:
        return [block]
    out, now, total = [], [], 0
    for line in m[2].split("\n"):
        if now and total + len(line) + 1 > size:
            out.append(now)
            now, total = [], 0
        now.append(line)
        total += len(line) + 1
    return [f"```{m[1]}\n" + "\n".join(lines) + "\n```" for lines in [*out, now]]


def split_code(text: str) -> list[str]:
    """Code blocks as chunks of their own, long ones cut; the text between them split like code."""
    size, overlap, separators = SPLITS["code"]
    parts = re.split(r"(```\w*\n(?s:.*?)```)", text)
    if len(parts) == 1:
        return split_text(text, size, overlap, separators)
    out = []
    for i, part in enumerate(parts):
        if i % 2:
            out += cut_code(part) if len(part) > 2 * CODE_SIZE else [part]
        elif part.strip():
            own = part.strip()
            out += split_text(own, size, overlap, separators) if len(own) > size else [own]
    return out


def _udf(split: Callable[[str], list[str]]):
    whole = pieced(split, ArrayType(StringType()))
    return lambda text: F.coalesce(whole(text), F.array().cast("array<string>"))


def split_fixed(text: Column, size: int = LEGACY[0], overlap: int = LEGACY[1], separators: tuple[str, ...] = LEGACY[2]) -> Column:
    """Array of chunks by size alone."""
    return _udf(lambda t: split_text(t, size, overlap, separators))(text)


def filled(text: Column) -> Column:
    """Whether a text is more than white space; mostly the first character says so."""
    return F.substring(text, 1, 1).rlike(r"(?U)\S") | text.rlike(r"(?U)\S")


def strip(text: Column) -> Column:
    """A text without the white space at its ends. A pattern is tried at every character, so only texts that have some are searched."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1)).rlike(r"(?U)\s")
    return F.when(ends, F.regexp_replace(F.regexp_replace(text, r"^(?U)\s+", ""), r"(?U)\s+$", "")).otherwise(text)


def content_type(text: Column) -> Column:
    """code, table or list if more than half the lines are, mixed if any is, else prose. A line that starts with three
    backticks opens or closes a fence; lines inside count as code. Blank texts are prose."""
    lines = F.split(strip(text), "\n", -1)
    zero = F.lit(0)
    start = F.struct(F.lit(False).alias("fence"), zero.alias("n"), zero.alias("code"), zero.alias("table"), zero.alias("list"))

    def step(acc: Column, line: Column) -> Column:
        fence = line.startswith("```")
        code = fence | acc["fence"]
        # the first character decides for most lines, so that these are not searched
        marked = F.substring(F.ltrim(line, F.lit(_SPACE)), 1, 1).isin(*"-*+0123456789")
        listed = ~code & marked & line.rlike(r"^\s*[-*+]\s|^\s*\d+\.\s")
        table = ~code & ~listed & line.startswith("|") & line.rlike(r"^\|.*\|")
        return F.struct(
            (acc["fence"] != fence).alias("fence"), (acc["n"] + 1).alias("n"), (acc["code"] + code.cast("int")).alias("code"),
            (acc["table"] + table.cast("int")).alias("table"), (acc["list"] + listed.cast("int")).alias("list"),
        )

    def name(acc: Column) -> Column:
        half = acc["n"] * 0.5
        return (
            F.when(acc["code"] > half, "code")
            .when(acc["table"] > half, "table")
            .when(acc["list"] > half, "list")
            .when(acc["code"] + acc["table"] + acc["list"] > 0, "mixed")
            .otherwise("prose")
        )

    blank = ~filled(F.coalesce(text, F.lit("")))
    return F.when(blank, "prose").otherwise(F.aggregate(lines, start, step, name))


_BLOCK = "struct<code:string,language:string,first:int,last:int>"


def code_blocks(text: Column) -> Column:
    """Fenced blocks as array of struct(code, language, first, last); the language is `unknown` where none is named."""
    rows = F.arrays_zip(
        F.split(text, CODE, -1).alias("gap"), F.regexp_extract_all(text, F.lit(CODE), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(CODE), F.lit(1)).alias("lang"), F.regexp_extract_all(text, F.lit(CODE), F.lit(2)).alias("code"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_BLOCK}>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        first = acc["at"] + F.length(row["gap"])
        last = first + F.coalesce(F.length(row["hit"]), F.lit(0))
        language = F.when(row["lang"] == "", "unknown").otherwise(row["lang"])
        block = F.struct(row["code"].alias("code"), language.alias("language"), first.alias("first"), last.alias("last"))
        return F.struct(last.alias("at"), F.when(row["hit"].isNotNull(), F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


_SECTION = "struct<h1:string,h2:string,h3:string,h4:string,text:string>"
_HEADS = ("h1", "h2", "h3", "h4")


def sections(text: Column) -> Column:
    """Sections at headers of one to four marks outside fences, as array of struct(h1, h2, h3, h4, text). The header stays
    in the text; a header clears the deeper ones. Blank sections are left out."""
    none = F.lit(None).cast("string")
    start = F.struct(
        F.lit(False).alias("fence"), *[none.alias(h) for h in _HEADS], F.array().cast("array<string>").alias("lines"),
        F.array().cast(f"array<{_SECTION}>").alias("out"),
    )

    def closed(acc: Column) -> Column:
        whole = F.array_join(acc["lines"], "\n")
        own = F.struct(*[acc[h].alias(h) for h in _HEADS], whole.alias("text"))
        return F.when(filled(whole), F.concat(acc["out"], F.array(own))).otherwise(acc["out"])

    def step(acc: Column, line: Column) -> Column:
        fence = line.startswith("```")
        head = ~acc["fence"] & ~fence & line.startswith("#") & line.rlike(r"^#{1,4}(\s|$)")
        level = F.length(F.regexp_extract(line, r"^(#{1,4})", 1))
        title = F.trim(F.regexp_replace(line, r"^#{1,4}\s*", ""))
        heads = [
            F.when(head, F.when(level == i + 1, title).when(level > i + 1, acc[h])).otherwise(acc[h]).alias(h) for i, h in enumerate(_HEADS)
        ]
        return F.struct(
            (acc["fence"] != fence).alias("fence"), *heads,
            F.when(head, F.array(line)).otherwise(F.concat(acc["lines"], F.array(line))).alias("lines"),
            F.when(head, closed(acc)).otherwise(acc["out"]).alias("out"),
        )

    headed = text.startswith("#") | text.contains("\n#")
    one = F.array(F.struct(*[none.alias(h) for h in _HEADS], text.alias("text")))  # a text without headers need not be cut
    return F.when(headed, F.aggregate(F.split(text, "\n", -1), start, step, closed)).when(filled(text), one).when(text.isNotNull(), F.array().cast(f"array<{_SECTION}>"))


def heading_path(*heads: Column) -> Column:
    """Headings that are not blank, joined by ' > '; marks at the start are taken off."""
    clean = [F.nullif(F.trim(F.regexp_replace(F.trim(h), r"^#+\s*", "")), F.lit("")) for h in heads]
    return F.concat_ws(" > ", *clean)


def chunk_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of documents: their columns without the text, and section, h1 to h4, heading_path, content_type,
    chunk_index, total_chunks_in_section, code_languages (sorted) and text.

    A section that fits its type's size stays whole; code sections keep their blocks together. A document without
    any section is one chunk of prose."""
    docs, whole = spread(docs), F.coalesce(F.col(text), F.lit(""))
    others = [c for c in docs.columns if c != text]
    blank = F.array(F.struct(*[F.lit(None).cast("string").alias(h) for h in _HEADS], whole.alias("text")))
    found = sections(whole)
    # bound as lambda variables, so that sections and types are computed once for each document and section
    chosen = F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(blank))[0]
    whole_or_sections = F.transform(
        chosen, lambda s: F.struct(*[s[h].alias(h) for h in _HEADS], s["text"].alias("text"), content_type(s["text"]).alias("content_type"))
    )
    typed = docs.select(*others, F.posexplode(whole_or_sections).alias("section", "s")).select(*others, "section", "s.*")
    size = F.create_map(*[x for k, v in SPLITS.items() for x in (F.lit(k), F.lit(v[0]))])[F.col("content_type")]
    cut = F.when(F.col("content_type") == "code", _udf(split_code)(F.when(F.col("content_type") == "code", F.col("text"))))
    for kind, (n, overlap, separators) in SPLITS.items():
        if kind not in ("code", "mixed"):
            same = F.col("content_type").isin("prose", "mixed") if kind == "prose" else F.col("content_type") == kind
            long = same & (F.length("text") > n)
            cut = cut.when(same, split_fixed(F.when(long, F.col("text")), n, overlap, separators))
    parts = F.when(F.length("text") <= size, F.array("text")).otherwise(cut)
    chunks = typed.withColumn("_parts", parts).withColumn("total_chunks_in_section", F.size("_parts")).select(
        *others, "section", *_HEADS, heading_path(*map(F.col, _HEADS)).alias("heading_path"), "content_type", "total_chunks_in_section",
        F.posexplode_outer("_parts").alias("chunk_index", "_part"),
    )
    fenced = F.transform(code_blocks(F.col("_part")), lambda b: b["language"])
    languages = F.array_join(F.array_sort(F.array_distinct(F.filter(fenced, lambda x: x != "unknown"))), ",")
    # rows of no part are dropped here: a plain posexplode would have Spark infer a filter on the parts and cut every text twice
    keep = filled(F.col("_part")) | (F.col("total_chunks_in_section") == 1)
    return chunks.filter(keep).select(
        *others, "section", *_HEADS, "heading_path", "content_type", "chunk_index", "total_chunks_in_section",
        F.when((F.col("content_type") == "code") & (languages != ""), languages).alias("code_languages"),
        strip(F.col("_part")).alias("text"),
    )


def chunk_type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))
