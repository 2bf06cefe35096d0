"""Readers of documents, telemetry and evaluation sets, and writers of reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a scan takes and leaves out.
EXTENSIONS = (".md", ".txt", ".rst")
UPLOADS = (".md", ".txt", ".markdown")
EXCLUDED = ("node_modules", ".git", "__pycache__", ".venv")
UPLOAD_BYTES = 50 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def read_corpus(
    spark: SparkSession,
    path: str,
    source_type: str,
    extensions: tuple[str, ...] = EXTENSIONS,
    excluded: tuple[str, ...] = EXCLUDED,
    max_bytes: int | None = None,
) -> DataFrame:
    """Text files under a path: source, source_type, file_type, file_name, relative_path, content_hash, file_size, text.

    Folders named in `excluded` are left out at any depth; a limit on the size drops larger files, before any is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.filter(extension(F.col("path")).isin(*extensions))
    for name in excluded:
        files = files.filter(~F.col("path").contains(f"/{name}/"))
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    kind = F.when(extension(F.col("path")).isin(".md", ".markdown"), "markdown").otherwise("text")
    return files.select(
        F.col("path").alias("source"),
        F.lit(source_type).alias("source_type"),
        kind.alias("file_type"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.regexp_replace("path", r"^.*?" + "\\Q" + path.rstrip("/").removeprefix("file:") + "\\E/?", "").alias("relative_path"),
        file_hash(F.col("content")).alias("content_hash"),
        F.col("length").alias("file_size"),
        F.decode("content", "UTF-8").alias("text"),
    )


def file_hash(content: Column) -> Column:
    """SHA-256 of raw bytes."""
    return F.sha2(content, 256)


def read_telemetry(spark: SparkSession, path: str, schema: StructType | str, last_n: int = 100, ts: str = "ts", key: str = "id") -> DataFrame:
    """The newest last_n rows of a JSON-lines log; malformed lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.col(ts).desc(), F.col(key)).limit(last_n)


EVAL_SCHEMA = "question string, answer string, ground_truth string, topic string"


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a file that is one JSON array, or of a folder of such files."""
    return spark.read.schema(EVAL_SCHEMA).option("multiLine", True).json(path)


def export_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """Rows as JSON lines."""
    report.write.mode(mode).json(path)


def as_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
