"""A corpus from documents to a mix: quality filter, line dedup, near-dedup, decontamination, mixing to weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. SQL cannot state the stages. Operators get the whole
row as one column beside the id and the text, so further columns may have any name. Nulls, empty texts, repeated rows
and empty tables are taken as the operators define; an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import quality
from corpusloom.llm.common import checkpoint, new_path
from corpusloom.llm.decontaminate import find_contamination
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.mixing import mix
from corpusloom.llm.near_dup import near_duplicates, with_fingerprints

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc (the whole row), doc_id and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of documents that are not held out."""
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(whole_rows(docs), net).filter(F.col("_score") >= quality.THRESHOLD).select("doc.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that 10 or more of them hold; a text that loses no line stays as it is."""
    kept, dropped = F.col("_kept").cast("string"), F.col("_n_dropped") > 0
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    old = {c: F.col("doc").getField(c) for c in docs.columns}
    return dedup_lines(whole_rows(docs), min_docs=10).select(
        *[(F.when(dropped, new[c]).otherwise(old[c]) if c in new else old[c]).alias(c) for c in docs.columns]
    )


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints one document: that with the smallest id, a null id last; of several rows with
    that id the one with the least fingerprint, and then the least text."""
    near = checkpoint(near_duplicates(docs.select("doc_id", "text")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_fp").alias("fp")))
    rows = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    best = near.groupBy("_component").agg(least.alias("best")).select("_component", F.col("best.id").alias("id"), F.col("best.fp").alias("fp"))
    kept = checkpoint(best.join(rows, F.col("id").eqNullSafe(F.col("doc_id"))).select("_component", "id", "fp", "n"))
    docs = whole_rows(docs)

    def chosen(ids: DataFrame) -> DataFrame:
        return docs.join(ids.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    repeated = kept.filter("n > 1")
    alone = chosen(kept.filter("n = 1")).select("doc.*")
    if repeated.isEmpty():
        return alone
    prints = with_fingerprints(chosen(repeated).select("doc", "doc_id", "text"))
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_fp") == F.col("fp"))
    order = Window.partitionBy("_component").orderBy(F.col("doc.text"), F.xxhash64("doc"))
    one = prints.join(repeated, match).withColumn("place", F.row_number().over(order)).filter("place = 1").select("doc.*")
    return alone.unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in 20 lie in windows of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))
    return find_contamination(whole_rows(docs), items).filter(~bad).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source, source_size, target, taken."""
    return mix(docs.select("doc_id", "text", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_common_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = new_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
