"""Incremental ingestion: change detection, chunking, dedup, ids, upsert and registry, over the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.storage import checkpoint, remove, stored
from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.dedup import content_hash, mark_duplicates, normalize_text
from corpusloom.operators.tracking import change_summary, detect_changes, number_digests, registry_upsert, text_digest
from corpusloom.sources.store import upsert_chunks


@dataclass
class Ingested:
    """store and registry after the run, its changes (file_path, state), their counts, and the chunks that were made. Chunks
    are read from a written table; `forget` removes it when they are no longer needed."""

    store: DataFrame
    registry: DataFrame
    changes: DataFrame
    summary: DataFrame
    chunks: DataFrame
    path: str

    def forget(self) -> None:
        remove(self.chunks.sparkSession, self.path)


_PLACE = ["source", "section", "chunk_index"]
#: What is known of a file besides its text.
ENTRY = ["file_path", "content_hash", "source_type", "file_size"]


def _numbered(chunks: DataFrame, fuzzy_threshold: float) -> DataFrame:
    """Place and chunk_id of the chunks that dedup keeps. Texts were hashed when they were cut; only the hashes are shuffled,
    unless there is a fuzzy step."""
    order = F.concat_ws("/", "source", F.format_string("%08d", "section"), F.format_string("%08d", "chunk_index")).alias("_order")
    if fuzzy_threshold >= 1.0:
        hashed = checkpoint(chunks.select(*_PLACE, order, "digest", "normal_hash"))
        kept = hashed.join(hashed.groupBy("normal_hash").agg(F.min("_order").alias("_order")).drop("normal_hash"), "_order", "left_semi")
    else:
        marked = mark_duplicates(chunks.select(*_PLACE, order, "digest", "text"), "_order", threshold=fuzzy_threshold)
        kept = marked.filter(~F.col("is_exact_duplicate") & ~F.col("is_fuzzy_duplicate"))
    return checkpoint(number_digests(kept.select(*_PLACE, "digest")).select(*_PLACE, "chunk_id"))


def ingest(
    current: DataFrame,
    registry: DataFrame,
    store: DataFrame,
    as_of: str,
    source_type: str | None = None,
    force_full: bool = False,
    dry_run: bool = False,
    fuzzy_threshold: float = 1.0,
    entries: DataFrame | None = None,
) -> Ingested:
    """current (file_path, content_hash, source_type, file_size, text) into store (chunk_id, source, source_type,
    content_type, heading_path, text) and registry. Only new and changed files are parsed, all with force_full; chunks of
    changed and deleted files go first. A dry run leaves store and registry as they are. Rerunning changes nothing.
    entries: the columns ENTRY of current, where they can be had without its texts."""
    entries = checkpoint(current.select(*ENTRY)) if entries is None else entries
    changes = checkpoint(detect_changes(entries, registry, source_type))
    todo = changes.filter("state <> 'deleted'") if force_full else changes.filter("state in ('new', 'changed')")
    files = current.select("file_path", "source_type", "text").join(todo.select("file_path"), "file_path", "left_semi")
    docs = files.select(F.col("file_path").alias("source"), "source_type", "text")
    hashes = [text_digest(F.col("text")).alias("digest")]
    if fuzzy_threshold >= 1.0:
        hashes.append(content_hash(normalize_text(F.col("text"))).alias("normal_hash"))
    chunks, path = stored(chunk_documents(docs).select(*_PLACE, "source_type", "content_type", "heading_path", "text", *hashes))
    ids = _numbered(chunks, fuzzy_threshold)
    numbered = chunks.join(ids, _PLACE).select("chunk_id", "source", "source_type", "content_type", "heading_path", "text")
    if dry_run:
        return Ingested(store, registry, changes, change_summary(changes), numbered, path)
    stale = changes.filter("state in ('changed', 'deleted')") if not force_full else changes.filter("state <> 'new'")
    left = store.join(stale.select(F.col("file_path").alias("source")), "source", "left_anti")
    new_store = upsert_chunks(left.select(*numbered.columns), numbered)
    per_file = ids.groupBy(F.col("source").alias("file_path")).agg(F.count(F.lit(1)).alias("chunk_count"))
    done = entries.join(todo.select("file_path"), "file_path", "left_semi").join(per_file, "file_path", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0))
    )
    alive = registry.join(changes.filter("state = 'deleted'"), "file_path", "left_anti")
    return Ingested(new_store, registry_upsert(alive, done, as_of), changes, change_summary(changes), numbered, path)
