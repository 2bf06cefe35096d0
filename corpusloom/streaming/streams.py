"""Stream forms of the operators: event time, watermarks, and tables as sinks.

Event times are timestamps (cast a TIMESTAMP_NTZ column first). The default watermark is ten minutes; rows later than it are
dropped by Spark, and `late_rows` reads their number from a query's progress. Windows are written once, when they
close, so that their results equal the batch operators' on the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.functions import storage
from corpusloom.operators.dedup import content_hash, max_distance, normalize_text, simhash64
from corpusloom.operators.drift import LEAST, check_drift, valid_scores
from corpusloom.operators.experiments import bucket, pick_variant
from corpusloom.operators.telemetry import query_hash, rate_per_minute, share_percent
from corpusloom.plans.ingest import ENTRY, ingest
from corpusloom.sources.store import CHUNKS, Batches

WATERMARK = "10 minutes"
#: Equal parts of the scores from 0 to 1 in which a quartile is looked for.
SLOTS = 10_000
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def read_table(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs until all present input is taken, into a parquet table."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def for_batches(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark dropped so far."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def realtime_metrics(requests: DataFrame, window: str = "5 minutes", slide: str | None = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Per sliding window: rate, error and cache percentages, latency and score means and bounds."""
    x, s = F.col("latency_ms"), F.col("avg_similarity_score")
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        requests.withWatermark("ts", watermark).groupBy(span)
        .agg(
            F.count(F.lit(1)).alias("n"), rate_per_minute(F.count(F.lit(1)), F.min("ts"), F.max("ts")).alias("rate_per_minute"),
            share_percent(F.count_if(F.col("status_code") >= 400), F.count(F.lit(1))).alias("error_rate"),
            share_percent(F.count_if(F.col("cache_hit")), F.count("cache_hit")).alias("cache_hit_rate"),
            F.avg(x).alias("latency_avg"), F.min(x).alias("latency_min"), F.max(x).alias("latency_max"), F.percentile_approx(x, F.lit(0.5), F.lit(10000)).alias("latency_median"),
            F.avg(s).alias("score_avg"), F.min(s).alias("score_min"), F.max(s).alias("score_max"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "*").drop("window")
    )


def query_counts(requests: DataFrame, window: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    return (
        requests.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), query_hash(F.col("query")).alias("query_hash"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
        .select(F.col("window.start").alias("start"), "query_hash", "n", "last_seen")
    )


def rank_queries(counts: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent hashes of each window; for the batches of query_counts."""
    order = Window.partitionBy("start").orderBy(F.col("n").desc(), "query_hash")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_queries(requests: DataFrame, path: str, checkpoint: str, limit: int = 10, window: str = "1 hour") -> StreamingQuery:
    """Each closed window's ranking, in a folder per batch; a batch that runs again replaces its folder."""
    return for_batches(query_counts(requests, window), lambda df, i: rank_queries(df, limit).write.mode("overwrite").parquet(f"{path}/batch={i}"), checkpoint)


def query_sketches(requests: DataFrame, window: str = "1 hour", items: int = 1024, watermark: str = WATERMARK) -> DataFrame:
    """A sketch of the frequent query hashes of each window when it closes, with the number of its requests: the state of a
    window is bounded by `items`, however many different queries there are. query_counts is the exact form."""
    return (
        requests.filter(F.col("query").isNotNull()).withWatermark("ts", watermark).select("ts", query_hash(F.col("query")).alias("h"))
        .groupBy(F.window("ts", window)).agg(F.expr(f"approx_top_k_accumulate(h, {int(items)})").alias("sketch"), F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").alias("start"), "sketch", "requests")
    )


def top_of_sketches(sketches: DataFrame, limit: int = 10, items: int = 1024, by: list[str] | None = None) -> DataFrame:
    """The most frequent hashes over all sketches (of a value of `by`): query_hash, n and the least that it can be.

    Sketches add up, so that any windows make a longer one. A count lies between least and n; the room between them is 3.5 /
    size of the requests for a sketch of that size, the power of two from 4 / 3 of `items`. Hashes that aren't among those
    returned by their n can have up to the room; up to 3 / 4 of the size of different hashes are counted exactly."""
    by, size = by or [], 1 << max(3, math.ceil(math.log2(items / 0.75)))
    # always by some key: without one, Spark fails to merge no sketch at all, as in an empty partition
    merged = sketches.groupBy(*by, F.lit(1).alias("_all")).agg(F.expr(f"approx_top_k_combine(sketch, {int(items)})").alias("s"), F.sum("requests").alias("requests"))
    found = merged.select(*by, F.ceil(F.col("requests") * 3.5 / size).alias("room"), F.explode(F.expr(f"approx_top_k_estimate(s, {int(items)})")).alias("e"))
    rows = found.select(*by, F.col("e.item").alias("query_hash"), F.col("e.count").alias("n"), F.greatest(F.col("e.count") - F.col("room"), F.lit(0)).alias("least"))
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col("n").desc(), "query_hash")  # at most `items` rows each
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def tumbling_counts(events: DataFrame, window: str, keys: list[str], good: Column | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Counts per tumbling window and keys, and how many are good: daily counts, feedback rates, series for alerts."""
    good = F.lit(True) if good is None else good
    return (
        events.withWatermark("ts", watermark).groupBy(F.window("ts", window), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"))
        .select(F.col("window.start").alias("start"), *keys, "n", "good")
    )


def session_activity(messages: DataFrame, gap: str = "24 hours", key: str = "session_id", watermark: str = WATERMARK) -> DataFrame:
    """Messages per stretch of activity; a session that is idle for the gap ends."""
    return (
        messages.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def score_counts(scores: DataFrame, window: str = "24 hours", watermark: str = WATERMARK) -> DataFrame:
    """How often each valid score occurs in a window, when it closes. The state is a count for each different value, so that
    partial counts add up and any percentile of the window follows from them."""
    return (
        valid_scores(scores).withWatermark("ts", watermark).groupBy(F.window("ts", window), "score")
        .agg(F.count(F.lit(1)).alias("c")).select(F.col("window.end").alias("ts"), "score", "c")
    )


def metrics_of_counts(counts: DataFrame) -> DataFrame:
    """The metrics of drift_metrics for each window (ts) from the counts (c) of its scores, quartiles by the index rule.

    A place is looked for among the sums of SLOTS equal parts of the scores from 0 to 1 first, then among the values of the one
    part that holds it, so that no task orders the values of a window."""
    rows = counts.withColumn("slot", F.floor(F.col("score") * SLOTS))
    x, c = F.col("score"), F.col("c")
    stats = rows.groupBy("ts").agg(F.sum("c").alias("n"), (F.sum(x * c) / F.sum("c")).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))
    spread = rows.join(F.broadcast(stats.select("ts", "mean")), "ts").groupBy("ts").agg(F.sum((x - F.col("mean")) ** 2 * c).alias("_s"))
    stats = stats.join(spread, "ts").withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("_s") / (F.col("n") - 1))))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1).alias("place")) for k, p in QUARTILES.items()])
    places = stats.select("ts", F.explode(wanted).alias("w")).select("ts", "w.*")
    sums = rows.groupBy("ts", "slot").agg(F.sum("c").alias("c"))  # at most SLOTS + 1 rows a window
    below = sums.withColumn("below", F.sum("c").over(Window.partitionBy("ts").orderBy("slot")) - F.col("c"))
    held = below.join(F.broadcast(places), "ts").filter((F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("c")))
    inside = rows.join(F.broadcast(held.select("ts", "slot", "name", "place", "below")), ["ts", "slot"])
    upto = F.col("below") + F.sum("c").over(Window.partitionBy("ts", "name").orderBy("score"))
    found = inside.withColumn("_to", upto).filter((F.col("place") < F.col("_to")) & (F.col("place") >= F.col("_to") - F.col("c")))
    quartiles = found.groupBy("ts").agg(*[F.max(F.when(F.col("name") == k, F.col("score"))).alias(k) for k in QUARTILES])
    names = ("mean", "std", *QUARTILES, "min", "max")
    return stats.join(quartiles, "ts").select("ts", *[F.when(F.col("n") >= LEAST, F.col(k)).alias(k) for k in names], "n")


def drift_checks(scores: DataFrame, baseline: DataFrame, path: str, checkpoint: str, window: str = "24 hours") -> StreamingQuery:
    """Each closed window checked against the baseline."""
    return for_batches(score_counts(scores, window), lambda df, i: check_drift(metrics_of_counts(df), baseline).write.mode("overwrite").parquet(f"{path}/batch={i}"), checkpoint)


def dedup_exact_stream(chunks: DataFrame, text: str = "text", watermark: str = WATERMARK) -> DataFrame:
    """The first row of every normalised text; a repeat within the watermark is dropped."""
    hashed = chunks.withColumn("content_hash", content_hash(normalize_text(F.col(text))))
    return hashed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["content_hash"])


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as states with lists and timers need it."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class LastKept(StatefulProcessor):
    """Per lane the SimHashes of the last `window` rows kept, oldest first, and a timer that forgets a lane at rest.

    Rows of a batch are taken in the order of their times and ids; only these and the hashes, 24 bytes a row, are held for
    the batch. A row is similar if one of the last kept is within the distance; else it is kept and pushes the oldest out."""

    def __init__(self, window: int, distance: int, ttl: int):
        self.window, self.distance, self.ttl = window, distance, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", StructType().add("simhash", "long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(b["ts"].to_numpy("datetime64[ms]").astype(np.int64), b["row_id"].to_numpy(), b["simhash"].to_numpy(np.int64).view(np.uint64)) for b in rows]
        ts, ids, hashes = (np.concatenate([part[i] for part in parts]) for i in range(3))
        order = np.lexsort((ids, ts))
        before = np.array([h for (h,) in self.kept.get()] if self.kept.exists() else [], np.int64).view(np.uint64)
        ring, at = np.zeros(self.window, np.uint64), min(len(before), self.window)
        ring[:at] = before[-self.window :]
        similar = np.zeros(len(order), bool)
        for i in order:
            h = hashes[i]
            similar[i] = (np.bitwise_count(ring[: min(at, self.window)] ^ h) <= self.distance).any()
            if not similar[i]:
                ring[at % self.window] = h
                at += 1
        oldest = at % self.window if at > self.window else 0
        now = np.concatenate([ring[oldest : min(at, self.window)], ring[:oldest]])
        self.kept.put([(h,) for h in now.view(np.int64).tolist()])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int(ts.max()) + self.ttl * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"row_id": ids, "ts": ts.astype("datetime64[ms]"), "similar": similar})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def near_seen_stream(
    chunks: DataFrame, threshold: float = 0.95, window: int = 1000, text: str = "text", watermark: str = WATERMARK, ttl: int = 86400, lane: Column | None = None
) -> DataFrame:
    """(row_id, ts, similar) for the chunks (row_id long, ts, text) whose normalised text is new: whether one of the last
    `window` rows kept is similar. Repeats of a text within the watermark are exact copies and have no row.

    Texts are compared and hashed in parallel; then the hashes of a lane meet its last kept rows. Without a lane there is
    one for all rows, as the window counts the rows kept anywhere: its hashes pass through one task in their order. A lane
    (a source, say) gives each of its values a window of its own, side by side. A lane without rows for `ttl` seconds
    of event time is forgotten."""
    distance = max_distance(threshold)
    own = chunks.select("row_id", "ts", F.col(text).alias("_text"), (F.lit("") if lane is None else lane).cast("string").alias("lane"))
    new = dedup_exact_stream(own, "_text", watermark)
    hashed = new.select("row_id", "ts", F.coalesce("lane", F.lit("")).alias("lane"), simhash64(F.col("_text")).alias("simhash"))
    return hashed.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=LastKept(window, distance, ttl), outputStructType="row_id long, ts timestamp, similar boolean", outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts"
    )


def dedup_fuzzy_stream(chunks: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """The rows of near_seen_stream, in a folder per batch; a batch that runs again replaces its folder."""
    with rocksdb_state(chunks.sparkSession):
        return for_batches(near_seen_stream(chunks, **options), lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"), checkpoint)


def assign_stream(sessions: DataFrame, existing: DataFrame, split: Column) -> DataFrame:
    """Sessions of a stream with their variant: that of the static table of assignments, else by hash."""
    old = existing.select("session_id", F.col("variant_id").alias("_old"))
    return sessions.join(old, "session_id", "left").withColumn("variant_id", F.coalesce("_old", pick_variant(split, bucket(F.col("session_id"))))).drop("_old")


def ingest_stream(files: DataFrame, store: Batches, registry: Batches, checkpoint: str, as_of: str) -> StreamingQuery:
    """Arriving files (file_path, content_hash, source_type, file_size, text) ingested batch by batch into a chunk_store and a
    file_registry. A batch reads the registry's buckets of its files and writes their chunks and entries, nothing
    else; unchanged files are not written. It sees only its own files, so none is taken for deleted. Of one path
    that arrives twice in a batch, the greatest content hash counts. A batch that runs again, after a stop between the two
    tables too, reads what was before it and replaces what it wrote."""

    def act(batch: DataFrame, number: int) -> None:
        own, entries = batch, storage.checkpoint(batch.select(*ENTRY))  # a batch is read anew, texts and all, each time it is used
        if not entries.groupBy("file_path").count().filter("count > 1").isEmpty():
            greatest = F.max(F.struct(F.coalesce("content_hash", F.lit("")).alias("_k"), F.struct(*[F.col(c) for c in batch.columns]).alias("row")))
            own = batch.groupBy("file_path").agg(greatest.alias("m")).select("m.row.*")
            entries = storage.checkpoint(own.select(*ENTRY))
        known = registry.current(number, entries.select("file_path"))
        done = ingest(own, known, store.spark.createDataFrame([], CHUNKS), as_of, entries=entries)
        touched = done.changes.filter("state in ('new', 'changed')").select("file_path")
        store.write(number, done.chunks, touched.withColumnRenamed("file_path", "source"))
        registry.write(number, done.registry.join(touched, "file_path", "left_semi"), touched)
        done.forget()

    return for_batches(files, act, checkpoint)


class Answers(StatefulProcessor):
    """The newest stored answer of a key, and a timer at the end of its life."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", StructType().add("answer", "string").add("until", "long"))

    def _expire_at(self, until: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(row.ts, row.event_id, row.stored) for b in rows for row in b[["ts", "event_id", "stored"]].itertuples(index=False)]
        answer, until = self.entry.get() if self.entry.exists() else (None, -1)
        out, begun = [], until
        for ts, event, stored in sorted(parts, key=lambda x: (x[0], x[1])):
            now = (ts.value + 500_000) // 1_000_000  # nanoseconds, to the nearest millisecond
            if stored is not None and stored == stored:
                if answer is not None and until < now:  # its life ended before this batch could see it
                    out.append((None, pd.Timestamp(until, unit="ms"), "expired", answer))
                answer, until = stored, now + self.ttl * 1000
            else:
                hit = now <= until
                out.append((event, ts, "hit" if hit else "miss", answer if hit else None))
        if until != begun:
            self.entry.update((answer, until))
            self._expire_at(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            ids, times, outcomes, answers = zip(*out, strict=True)
            # nullable, as ids next to a null are floats else
            yield pd.DataFrame({"key": key[0], "event_id": pd.array(ids, "Int64"), "ts": times, "outcome": outcomes, "answer": answers})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        answer, until = self.entry.get()
        self.entry.clear()
        yield pd.DataFrame({"key": [key[0]], "event_id": [None], "ts": [pd.Timestamp(until, unit="ms")], "outcome": ["expired"], "answer": [answer]})

    def close(self) -> None:
        pass


def answer_cache_stream(events: DataFrame, ttl: int = 3600, watermark: str = WATERMARK) -> DataFrame:
    """events (event_id long, key, ts, stored: an answer to keep, or null for a question) to (key, event_id, ts, outcome,
    answer): hit or miss for each question, and expired, at the end of its life, for each entry that no newer one replaced.

    An entry lives for `ttl` seconds of event time after it was stored, times counted to the nearest millisecond; then a timer takes it out of the state, without a
    row of its key or a batch job. Events of a key in a batch are taken by time, then id. The state holds the live
    entries alone. Start it within rocksdb_state."""
    own = events.withWatermark("ts", watermark).select("key", "event_id", "ts", "stored").filter("key is not null")
    return own.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Answers(ttl), outputStructType="key string, event_id long, ts timestamp, outcome string, answer string", outputMode="Append", timeMode="EventTime"
    )


def live_entries(cache: DataFrame, now: Column, ttl: int = 3600) -> DataFrame:
    """Cache rows that have not expired at a time."""
    return cache.filter((F.col("stored_at") <= now) & (F.unix_timestamp(now) - F.unix_timestamp("stored_at") <= ttl))
