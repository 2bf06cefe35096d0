"""Change tracking of an ingested corpus: registry, configuration, staging and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.telemetry import at

#: Days up to which a source is fresh, of low and of medium risk.
THRESHOLDS = {
    "kubernetes": (7, 30, 90),
    "terraform": (14, 60, 180),
    "docker": (14, 60, 180),
    "ansible": (30, 90, 365),
    "prometheus": (30, 90, 180),
    "github-actions": (7, 21, 60),
    "helm": (14, 60, 180),
    "default": (30, 90, 365),
}
#: Fixed value: the DNS namespace of name-based UUIDs.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
RISKS = ("fresh", "low", "medium", "high", "critical")


def detect_changes(current: DataFrame, registry: DataFrame, source_type: str | None = None) -> DataFrame:
    """(file_path, state): new, changed, deleted or unchanged by path and content hash. A source type limits the
    registry only, so that the other types' files are not reported as deleted."""
    old = registry if source_type is None else registry.filter(F.col("source_type") == source_type)
    both = current.select("file_path", F.col("content_hash").alias("_new")).join(
        old.select("file_path", F.col("content_hash").alias("_old")), "file_path", "full_outer"
    )
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_new") != F.col("_old"), "changed")
    return both.select("file_path", state.otherwise("unchanged").alias("state"))


def change_summary(changes: DataFrame) -> DataFrame:
    states = ("new", "changed", "deleted", "unchanged")
    counts = changes.agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    return counts.withColumn("to_process", F.col("new") + F.col("changed"))


def registry_upsert(registry: DataFrame, done: DataFrame, as_of: str) -> DataFrame:
    """The registry after the files in `done`: the first ingested_at stays, updated_at is as_of."""
    columns = [c for c in registry.columns if c not in ("file_path", "ingested_at", "updated_at")]
    both = registry.alias("r").join(done.select("file_path", *columns).alias("d"), "file_path", "full_outer")
    is_done = F.col("d.content_hash").isNotNull()
    return both.select(
        "file_path",
        *[F.when(is_done, F.col(f"d.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in columns],
        F.coalesce("r.ingested_at", at(as_of)).alias("ingested_at"),
        F.when(is_done, at(as_of)).otherwise(F.col("r.updated_at")).alias("updated_at"),
    )


def registry_stats(registry: DataFrame) -> DataFrame:
    """Files, chunks and bytes of each source type, most chunks first, and the totals in the row with is_total."""
    return (
        registry.rollup("source_type")
        .agg(
            F.count(F.lit(1)).alias("files"), F.sum("chunk_count").alias("chunks"), F.sum("file_size").alias("bytes"),
            (F.grouping_id() == 1).alias("is_total"),
        )
        .orderBy(F.col("is_total"), F.col("chunks").desc(), "source_type")
    )


def config_hash(size: Column, overlap: Column, mode: Column, model: Column, dims: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in (size, overlap, mode, model, dims)])), 1, 16)


def config_changed(config: DataFrame, stored: DataFrame) -> DataFrame:
    """config (size, overlap, mode, model, dims) with config_hash and changed; no stored row is no change."""
    now = config.withColumn("config_hash", config_hash(*[F.col(c) for c in ("size", "overlap", "mode", "model", "dims")]))
    old = stored.select(F.col("config_hash").alias("_stored"))
    return now.join(F.broadcast(old.limit(1)), F.lit(True), "left").withColumn("changed", F.coalesce(F.col("config_hash") != F.col("_stored"), F.lit(False))).drop("_stored")


def uuid5(name: Column) -> Column:
    """The name-based (version 5) UUID in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def text_digest(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return uuid5(F.concat_ws(":", source, index.cast("string"), text_digest(text)))


def number_digests(chunks: DataFrame, source: str = "source", order: tuple[str, ...] = ("section", "chunk_index"), digest: str = "digest") -> DataFrame:
    """The same as number_chunks for rows that hold a text_digest in place of their text."""
    running = F.row_number().over(Window.partitionBy(source).orderBy(*order)) - 1
    numbered = chunks.withColumn("source_index", running)
    name = F.concat_ws(":", F.coalesce(F.col(source), F.lit("unknown")), F.col("source_index").cast("string"), F.col(digest))
    return numbered.withColumn("chunk_id", uuid5(name))


def number_chunks(chunks: DataFrame, source: str = "source", order: tuple[str, ...] = ("section", "chunk_index"), text: str = "text") -> DataFrame:
    """chunks with source_index, a running number from 0 per source, and chunk_id."""
    running = Window.partitionBy(source).orderBy(*order)
    return chunks.withColumn("source_index", F.row_number().over(running) - 1).withColumn(
        "chunk_id", chunk_id(F.coalesce(F.col(source), F.lit("unknown")), F.col("source_index"), F.col(text))
    )


def stage(chunks: DataFrame, transaction: str, as_of: str) -> DataFrame:
    """Staging rows of a transaction."""
    return chunks.select(
        F.lit(transaction).alias("transaction_id"), "chunk_id", F.lit("staged").alias("status"), at(as_of).alias("staged_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )


def finish(staging: DataFrame, transaction: str, status: str, as_of: str) -> DataFrame:
    """Staging after a transaction is committed or rolled_back; only staged rows change."""
    if status not in ("committed", "rolled_back"):
        raise ValueError(f"a transaction ends committed or rolled_back, not {status}")
    own = (F.col("transaction_id") == transaction) & (F.col("status") == "staged")
    return staging.withColumn("finished_at", F.when(own, at(as_of)).otherwise(F.col("finished_at"))).withColumn(
        "status", F.when(own, status).otherwise(F.col("status"))
    )


def staging_stats(staging: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("staged", "committed", "rolled_back")]
    return staging.agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("transaction_id").alias("transactions"), *counts,
        F.min(F.when(F.col("status") == "staged", F.col("staged_at"))).alias("oldest_staged"),
    )


def orphans(staging: DataFrame, as_of: str, max_age_hours: int = 24) -> DataFrame:
    """Transactions with rows staged before the cutoff: number of chunks and the earliest time."""
    cutoff = at(as_of) - F.make_interval(hours=F.lit(max_age_hours))
    return (
        staging.filter((F.col("status") == "staged") & (F.col("staged_at") < cutoff))
        .groupBy("transaction_id")
        .agg(F.count(F.lit(1)).alias("chunks"), F.min("staged_at").alias("since"))
    )


def orphan_chunks(staging: DataFrame, as_of: str, max_age_hours: int = 24) -> DataFrame:
    """The rows of these transactions' stale chunks, one per row however many there are."""
    cutoff = at(as_of) - F.make_interval(hours=F.lit(max_age_hours))
    return staging.filter((F.col("status") == "staged") & (F.col("staged_at") < cutoff)).select("transaction_id", "chunk_id")


def purge_finished(staging: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    cutoff = at(as_of) - F.make_interval(days=F.lit(days))
    return staging.filter((F.col("status") == "staged") | (F.coalesce("finished_at", "staged_at") >= cutoff))


def freshness(sources: DataFrame, as_of: str, thresholds: dict[str, tuple[int, int, int]] = THRESHOLDS) -> DataFrame:
    """sources (source_type, last_commit) with whole days since the commit, a risk and an action; -1 and unknown
    without a commit. Types without thresholds take those of `default`."""
    table = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(F.try_element_at(table, F.col("source_type")), table["default"])
    days = F.floor((F.unix_timestamp(at(as_of)) - F.unix_timestamp("last_commit")) / 86400).cast("int")
    out = sources.withColumn("days", F.coalesce(days, F.lit(-1))).withColumn("_t", own)
    d, t = F.col("days"), F.col("_t")
    risk = (
        F.when(F.col("last_commit").isNull(), "unknown").when(d <= t[0], "fresh").when(d <= t[1], "low").when(d <= t[2], "medium").otherwise("high")
    )
    action = (
        F.when(F.col("risk") == "unknown", "Run ingestion to track freshness")
        .when(F.col("risk") == "fresh", "No action needed")
        .when(F.col("risk") == "low", "Consider updating soon")
        .when(F.col("risk") == "medium", "Update recommended")
        .otherwise("Update required - documentation may be outdated")
    )
    return out.withColumn("risk", risk).withColumn("action", action).drop("_t")


def stale_sources(fresh: DataFrame, least: str = "medium") -> DataFrame:
    """Sources of at least a risk; unknown ones are never stale."""
    return fresh.filter(F.col("risk").isin(*RISKS[RISKS.index(least) :]))


def freshness_report(fresh: DataFrame) -> DataFrame:
    return fresh.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("risk").isin("medium", "high", "critical")).alias("stale"),
        F.count_if(F.col("risk") == "fresh").alias("fresh"),
    )
