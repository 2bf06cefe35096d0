"""Queries of the stream operators: each runs a stream over files derived from the given tables and returns its table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import slots
from corpusloom.functions.storage import new_path
from corpusloom.operators import drift as R
from corpusloom.operators.dedup import dedup_exact
from corpusloom.operators import retrieval
from corpusloom.operators.query import chain_expanders
from corpusloom.plans import views as V
from corpusloom.plans.corpus_queries import _NORMAL, _SIM
from corpusloom.plans.registry import query
from corpusloom.plans.telemetry_queries import _EARLY, _METRICS, _NEWEST
from corpusloom.sources.store import chunk_store, file_registry
from corpusloom.streaming import streams as T


def _stream(spark, frame, files=None):
    at = new_path(spark, "arriving")
    frame.write.parquet(at)
    return T.read_table(spark, at, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields), files)


def _done(spark, stream, mode="append"):
    at = new_path(spark, "stream")
    T.write_table(stream, at, f"{at}-checkpoint", mode).awaitTermination()
    return spark.read.parquet(at)


def _ran(spark, start):
    at = new_path(spark, "stream")
    start(at, f"{at}-checkpoint").awaitTermination()
    return spark.read.parquet(at)


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_CLOSED = "(SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE"


@query(
    f"""WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, * FROM requests)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(100.0 * count(*) FILTER (WHERE status_code >= 400) / count(*), 4) AS error_rate, round(avg(latency_ms), 8) AS latency_avg, max(latency_ms) AS latency_max
FROM w WHERE start + INTERVAL 2 HOUR <= {_CLOSED} GROUP BY w.start""",
    "requests",
)
def t01_realtime_metrics(spark, d):
    out = _done(spark, T.realtime_metrics(_stream(spark, V.requests(spark, d)), "2 hours", "1 hour"))
    return out.select(_stamp("start"), "n", F.round("error_rate", 4).alias("error_rate"), F.round("latency_avg", 8).alias("latency_avg"), "latency_max")


@query(
    f"""WITH c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, substr(sha256(query), 1, 12) AS query_hash, count(*) AS n FROM requests GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, query_hash) AS rank FROM c WHERE start + INTERVAL 1 DAY <= {_CLOSED}) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, query_hash, n, rank FROM r WHERE rank <= 5""",
    "requests",
)
def t02_top_queries(spark, d):
    stream = _stream(spark, V.requests(spark, d))
    out = _ran(spark, lambda at, check: T.top_queries(stream, at, check, 5, "1 day"))
    return out.select(_stamp("start"), "query_hash", "n", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH c AS (SELECT substr(sha256(query), 1, 12) AS query_hash, count(*) AS n FROM requests WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1)
SELECT query_hash, n, row_number() OVER (ORDER BY n DESC, query_hash) AS rank FROM c ORDER BY rank LIMIT 20""",
    "requests",
)
def t02_query_sketches(spark, d):
    """The top queries of all closed days from the sketches of the days; there are fewer different ones than a sketch holds."""
    out = _done(spark, T.query_sketches(_stream(spark, V.requests(spark, d)), "1 day"))
    return T.top_of_sketches(out, 20).select("query_hash", "n", F.col("rank").cast("long").alias("rank"))


@query(
    f"""SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, model, count(*) AS n, count(*) FILTER (WHERE cache_hit) AS good FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, * FROM requests) t
WHERE start + INTERVAL 1 DAY <= {_CLOSED} GROUP BY t.start, model""",
    "requests",
)
def t03_tumbling_counts(spark, d):
    out = _done(spark, T.tumbling_counts(_stream(spark, V.requests(spark, d)), "1 day", ["model"], F.col("cache_hit")))
    return out.select(_stamp("start"), "model", "n", "good")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM requests WINDOW w AS (PARTITION BY session_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts) AS k FROM g)
SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY session_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE""",
    "requests",
)
def t04_session_activity(spark, d):
    out = _done(spark, T.session_activity(_stream(spark, V.requests(spark, d)), "6 hours"))
    return out.select("session_id", _stamp("start"), "n")


_EXACT = _METRICS.replace("round(", "(").replace(", 6)", ")")


@query(
    f"""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, avg_similarity_score AS x, ts, id FROM requests WHERE avg_similarity_score BETWEEN 0 AND 1),
m AS (SELECT start, {_EXACT} FROM w GROUP BY start HAVING start + INTERVAL 1 DAY <= {_CLOSED}), b AS (SELECT {_EXACT} FROM (SELECT x FROM w WHERE {_EARLY} {_NEWEST})),
s AS (SELECT m.*, abs(m.mean - b.mean) / b.mean * 100 AS shift, abs(m.std - b.std) / b.std * 100 AS std_shift, abs(m.p50 - b.p50) / b.p50 * 100 AS p50_shift FROM m, b)
SELECT strftime(start + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS ts, n, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(shift, 4) AS mean_shift, round(std_shift, 4) AS std_shift, round(p50_shift, 4) AS p50_shift,
CASE WHEN n < 10 THEN 'insufficient_data' WHEN shift >= 15 THEN 'drift_detected' WHEN shift >= 8 THEN 'warning' ELSE 'stable' END AS status FROM s""",
    "requests",
)
def t05_drift_checks(spark, d):
    scores = V.requests(spark, d).select("id", "ts", F.col("avg_similarity_score").alias("score"))
    base = R.drift_metrics(R.score_window(scores, "2024-01-08 12:00:00"))
    stream = _stream(spark, scores)
    out = _ran(spark, lambda at, check: T.drift_checks(stream, base, at, check))
    return out.select(_stamp("ts"), "n", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], *[F.round(c, 4).alias(c) for c in ("mean_shift", "std_shift", "p50_shift")], "status")


def _chunks(spark, d):
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("doc_id") * 0)
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", ts.alias("ts"))


@query(f"WITH {_NORMAL} SELECT DISTINCT sha256(t) AS content_hash FROM normal")
def t06_dedup_exact_stream(spark, d):
    return _done(spark, T.dedup_exact_stream(_stream(spark, _chunks(spark, d)))).select("content_hash")


@query(
    f"""WITH RECURSIVE {_SIM}, s AS (SELECT min(n.doc_id) AS doc_id FROM normal n GROUP BY t),
line AS MATERIALIZED (SELECT sim.*, row_number() OVER (ORDER BY doc_id) AS i FROM sim JOIN s USING (doc_id)),
scan AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS row_id, false AS falls, []::UBIGINT[] AS kept
UNION ALL SELECT i, doc_id, hit, CASE WHEN hit THEN kept ELSE list_append(kept, v)[-1000:] END
FROM (SELECT l.i, l.doc_id, l.v, scan.kept, len(list_filter(scan.kept, lambda k: bit_count(xor(k, l.v)) <= 3)) > 0 AS hit FROM scan JOIN line l ON l.i = scan.i + 1))
SELECT row_id FROM scan WHERE falls"""
)
def d12_dedup_fuzzy_stream(spark, d):
    """Near copies of one of the last 1,000 rows kept. Exact copies are dropped before they arrive, so that it is the first
    of each that does; the stream would take whichever it meets first."""
    stream = _stream(spark, dedup_exact(_chunks(spark, d), "row_id"))
    return _ran(spark, lambda at, check: T.dedup_fuzzy_stream(stream, at, check)).filter("similar").select("row_id")


@query(
    """WITH s AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id FROM events) SELECT event_id, session_id, CASE WHEN CAST(session_id AS INT) % 10 = 0 THEN 'old'
WHEN CAST(('0x' || substr(md5(session_id), 1, 8)) AS BIGINT) % 100 < 50 THEN 'a' ELSE 'b' END AS variant_id FROM s"""
)
def t07_assign_stream(spark, d):
    own = V.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"))
    existing = own.select("session_id").distinct().filter(F.col("session_id").cast("int") % 10 == 0).withColumn("variant_id", F.lit("old"))
    split = F.array(*[F.struct(F.lit(v).alias("variant_id"), F.lit(50.0).alias("pct")) for v in ("a", "b")])
    return _done(spark, T.assign_stream(_stream(spark, own), existing, split)).select("event_id", "session_id", "variant_id")


ARRIVALS = 4


def _ingested(spark, d):
    """(store, registry) after all documents have arrived, and then a tenth of them once more with other texts: each arrival
    is a run of the stream over the same checkpoint, so that the batches are the same however many files an arrival has."""
    own = V.table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("source").alias("source_type"), F.col("n_chars").alias("file_size"), "text"
    )
    store, registry = chunk_store(spark, new_path(spark, "store")), file_registry(spark, new_path(spark, "registry"))
    at, check = new_path(spark, "arriving"), new_path(spark, "ingest")
    schema = "file_path string, content_hash string, source_type string, file_size long, text string"
    part = F.coalesce(F.pmod("doc_id", F.lit(ARRIVALS)), F.lit(0))
    again = own.filter("doc_id % 10 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nA closing line of its own."))).withColumn("file_size", F.col("file_size") + 30)
    for i in range(ARRIVALS + 1):
        files = own.filter(part == i) if i < ARRIVALS else again
        files.withColumn("content_hash", F.md5("text")).select("file_path", "content_hash", "source_type", "file_size", "text").write.mode("append").parquet(at)
        T.ingest_stream(T.read_table(spark, at, schema), store, registry, check, f"2024-01-0{2 + i} 00:00:00").awaitTermination()
    return store, registry


@query(
    "SELECT source AS source_type, count(*) AS files, count(*) FILTER (WHERE doc_id % 10 = 0) AS updated, CAST(sum(n_chars + CASE WHEN doc_id % 10 = 0 THEN 30 ELSE 0 END) AS BIGINT) AS bytes FROM documents GROUP BY source"
)
def t08_ingest_stream(spark, d):
    """Files, updated files and bytes of the registry by source, after all documents have arrived and a tenth again."""
    files = _ingested(spark, d)[1].current()
    return files.groupBy("source_type").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("updated_at") > F.col("ingested_at")).alias("updated"), F.sum("file_size").alias("bytes"))


@query()
def t08_ingest_stream_chunks(spark, d):
    """Files of the registry and chunks of the store after all documents have arrived, by source."""
    store, registry = _ingested(spark, d)
    files = registry.current().groupBy("source_type").agg(F.count(F.lit(1)).alias("files"), F.sum("chunk_count").alias("registered_chunks"))
    chunks = store.current().groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("files_with_chunks"))
    return files.join(chunks, "source_type", "full")


@query("SELECT vec_id AS entry_id FROM embeddings WHERE vec_id * 10 BETWEEN 1400 AND 5000")
def t09_live_entries(spark, d):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    cache = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("entry_id"), (base + F.make_interval(secs=F.col("vec_id") * 10)).alias("stored_at"))
    return _done(spark, T.live_entries(_stream(spark, cache), base + F.make_interval(secs=F.lit(5000)))).select("entry_id")


@query(
    f"""WITH e AS (SELECT id, session_id AS key, ts, id % 3 = 0 AS stores FROM requests), s AS (SELECT * FROM e WHERE stores),
l AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, id) AS newer FROM s)
SELECT q.id AS event_id, CASE WHEN a.id IS NULL THEN 'miss' ELSE 'hit' END AS outcome, CASE WHEN a.id IS NULL THEN NULL ELSE 'answer ' || a.id END AS answer FROM e q
LEFT JOIN LATERAL (SELECT s.id FROM s WHERE s.key = q.key AND (s.ts < q.ts OR (s.ts = q.ts AND s.id < q.id)) AND epoch_ms(q.ts) <= epoch_ms(s.ts) + 86400000
                   AND NOT EXISTS (SELECT 1 FROM s n WHERE n.key = s.key AND (n.ts > s.ts OR (n.ts = s.ts AND n.id > s.id)) AND (n.ts < q.ts OR (n.ts = q.ts AND n.id < q.id)))) a ON true WHERE NOT q.stores
UNION ALL SELECT NULL, 'expired', 'answer ' || id FROM l WHERE epoch_ms(newer) > epoch_ms(ts) + 86400000 OR (newer IS NULL AND epoch_ms(ts) + 86400000 <= epoch_ms({_CLOSED}))""",
    "requests",
)
def t09_answer_cache(spark, d):
    """Every third request of a session stores an answer for a day, the others look for it; two arrivals, earlier half first."""
    own = V.requests(spark, d).select(F.col("id").alias("event_id"), F.col("session_id").alias("key"), "ts", F.when(F.col("id") % 3 == 0, F.concat(F.lit("answer "), F.col("id").cast("string"))).alias("stored"))
    at, check, out = (new_path(spark, x) for x in ("arriving", "answers", "stream"))
    # taken once for both halves: where partitions meet in another order it is another, and rows between two of them would be lost or come twice
    middle = own.agg(F.percentile_approx(F.unix_timestamp("ts"), 0.5)).first()[0]
    early = F.unix_timestamp("ts") <= F.lit(middle)
    schema = "event_id long, key string, ts timestamp, stored string"
    with T.rocksdb_state(spark):
        for half in (early, ~early):
            own.filter(half).write.mode("append").parquet(at)
            T.write_table(T.answer_cache_stream(T.read_table(spark, at, schema), 86400), out, check).awaitTermination()
    return spark.read.parquet(out).select("event_id", "outcome", "answer")


@query()
def u01_strategy_and_slots(spark, d):
    """U1 to U5: an encoder slot makes vectors, a strategy ranks them, a scorer slot re-ranks, a text step rewrites."""
    encode = slots.encoder(slots.hashing_encoder())
    held = V.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", encode("text").alias("embedding"))
    shout = slots.text_step(lambda: lambda texts: [t.upper() for t in texts])
    asked = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), shout("text").alias("query")).withColumn("embedding", encode("query"))
    strategy: slots.Strategy = retrieval.dense_topk
    found = strategy(asked, held, 10, 0.1).join(held.select("chunk_id", "text"), "chunk_id").join(asked.select("query_id", "query"), "query_id")
    scorer = slots.pair_scorer(lambda pairs: [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.split()))) for q, t in pairs])
    return retrieval.rerank(found, 3, scorer).select("query_id", "rank", "chunk_id", F.round("rerank_score", 6).alias("score"))


@query("SELECT event_id, lower(event_type) || ' docs' AS expanded, 'docs' AS applied FROM events")
def u02_expander(spark, d):
    """A user's expander, a column of a column, as a step of the chain."""
    docs: slots.Expander = lambda c: F.concat(F.lower(c), F.lit(" docs"))
    out = chain_expanders(V.table(spark, d, "events").select("event_id", "event_type"), [("docs", docs)], "event_type")
    return out.select("event_id", "expanded", F.array_join("applied", ",").alias("applied"))


@query("SELECT doc_id, round(length(source) / (length(text) + 1), 9) AS score FROM documents")
def u03_pair_scorer(spark, d):
    """A user's scorer of pairs, here the ratio of their lengths."""
    scorer = slots.pair_scorer(lambda pairs: [len(a) / (len(b) + 1) for a, b in pairs])
    return V.table(spark, d, "documents").select("doc_id", F.round(scorer(F.col("source"), F.col("text")), 9).alias("score"))


@query("SELECT doc_id, CAST(length(t) AS DOUBLE) AS size, CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS es FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def u04_encoder(spark, d):
    """A user's encoder, here of two counts."""
    encode = slots.encoder(lambda: lambda texts: np.array([[len(t), t.count("e")] for t in texts], np.float32))
    out = V.table(spark, d, "documents").select("doc_id", encode("text").alias("v"))
    return out.select("doc_id", F.col("v")[0].cast("double").alias("size"), F.col("v")[1].cast("double").alias("es"))


@query("SELECT doc_id, md5(replace(coalesce(text, ''), 'a', 'A')) AS stepped FROM documents")
def u05_text_step(spark, d):
    """A user's step from text to text, here one letter in upper case."""
    step = slots.text_step(lambda: lambda texts: [t.replace("a", "A") for t in texts])
    return V.table(spark, d, "documents").select("doc_id", F.md5(step("text")).alias("stepped"))


@query("SELECT source, list_sort(list(n_chars))[CAST(least(floor(count(*) * 0.9::DOUBLE), count(*) - 1) AS BIGINT) + 1]::DOUBLE AS p90 FROM documents GROUP BY source")
def u06_index_percentile(spark, d):
    from corpusloom.functions.percentiles import index_percentiles

    return index_percentiles(V.table(spark, d, "documents"), "n_chars", {"p90": 0.9}, ["source"])


