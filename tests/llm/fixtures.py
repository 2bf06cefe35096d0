"""Small tables with the cases that every operator must take: nulls, blanks, long texts, ties, copies, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, _bytes2 string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeémnorst") for _ in range(rng.randint(1, 8))) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(3)
    long = words(rng, 6000)
    passage = words(rng, 120)
    same = words(rng, 90)
    near = [f"{same} {words(rng, 1)}" for _ in range(12)]
    out: list[str | None] = [None, "", " \n\t ", "one", "Two words", "ÀÉ ß ñ 漢字", "a" * 3000, long, long + "\n" + passage]
    out += [same] * 6 + near + [f"{words(rng, 40)} {passage} {words(rng, 30)}" for _ in range(6)]
    out += [f"Shared LINE \n{words(rng, 20)}\n\n  shared line\t\n{words(rng, 5)}" for _ in range(12)]
    out += ["shared line"] + [words(rng, rng.randint(1, 60)) for _ in range(20)]
    out += [words(rng, 30) + " " + "ab" * 300 + " x", "ab" * 450, "short", "short"]
    return out


def documents(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, "k", 1, None) for i, t in enumerate(texts())]
    rows.append(rows[12])  # a repeated row
    rows.append((None, "no id at all", None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that operators use or might use inside, a dotted one too.
CLASHES = [
    "row", "digest", "_digest", "_less", "_bytes", "_h", "_l", "_joined", "_common", "_base", "_added", "_spans", "_n_dropped", "a.b",
    "block", "keys", "bucket", "payload", "t", "_kept_id", "_fp", "component_id", "_rows", "_n_bytes", "_kept", "n_removed", "kept", "all",
]


def clashing(spark):
    """Documents with extra columns of all these names, each holding 7."""
    from pyspark.sql import functions as F

    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])
