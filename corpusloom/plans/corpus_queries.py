"""Queries of the source, store, tracking, chunking and dedup operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.storage import checkpoint, new_path, spread
from corpusloom.operators import chunking as K
from corpusloom.operators import dedup as D
from corpusloom.operators import tracking as T
from corpusloom.plans import views as V
from corpusloom.plans.ingest import ingest
from corpusloom.plans.registry import query
from corpusloom.plans.views import AS_OF
from corpusloom.sources import corpus as C
from corpusloom.sources import store as S


def docs(spark, d):
    return V.table(spark, d, "documents")


@query("SELECT source AS folder, count(*) AS lines FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY source")
def s01_read_corpus(spark, d):
    at = new_path(spark, "corpus")
    docs(spark, d).select("source", F.explode(F.split("text", "\n", -1)).alias("value")).hint("rebalance", "source").write.partitionBy("source").text(at)
    files = C.read_corpus(spark, at, "docs")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.groupBy(F.regexp_extract("relative_path", "source=([^/]+)", 1).alias("folder")).agg(F.sum(lines).cast("long").alias("lines"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def s02_file_hash(spark, d):
    return docs(spark, d).select("doc_id", C.file_hash(F.col("text").cast("binary")).alias("content_hash"))


@query("SELECT id, latency_ms FROM requests ORDER BY ts DESC, id LIMIT 100", "requests")
def s03_read_telemetry(spark, d):
    at = new_path(spark, "telemetry")
    V.requests(spark, d).select("id", "ts", "latency_ms").write.json(at)
    return C.read_telemetry(spark, at, "id long, ts timestamp, latency_ms double").select("id", "latency_ms")


@query("SELECT 'q' || item_id AS question, text AS answer FROM benchmark")
def s04_read_eval_set(spark, d):
    at = new_path(spark, "eval")
    row = F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question"), F.col("text").alias("answer"))
    items = V.table(spark, d, "benchmark")
    # files of one JSON array each, of about a thousand rows
    part = F.pmod(F.xxhash64("item_id"), F.lit(items.count() // 1000 + 1)).alias("part")
    items.groupBy(part).agg(F.to_json(F.collect_list(row)).alias("value")).write.partitionBy("part").text(at)
    return C.read_eval_set(spark, at).select("question", "answer")


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM requests GROUP BY 1", "requests")
def s05_write_query_logs(spark, d):
    at = new_path(spark, "logs")
    S.write_query_logs(V.requests(spark, d), at)
    return spark.read.parquet(at).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(CASE WHEN id % 4 = 0 THEN ts - INTERVAL 1 MONTH ELSE ts END, '%Y-%m') AS month, count(*) AS n FROM requests GROUP BY 1", "requests")
def s06_migrate_query_logs(spark, d):
    at = new_path(spark, "logs")
    old = V.requests(spark, d).withColumn("created_at", F.expr("ts - INTERVAL 1 MONTH")).withColumn("ts", F.when(F.col("id") % 4 != 0, F.col("ts")))
    S.migrate_query_logs(old, at)
    return spark.read.parquet(at).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def _monthly(spark, d):
    ts = F.add_months("ts", (F.col("id") % 5).cast("int")).cast("timestamp")
    return V.requests(spark, d).withColumn("ts", ts).withColumn("month", F.when(F.col("id") % 97 == 0, "2024-01").otherwise(S.month_of(F.col("ts")))).filter("month <> '2024-03'")


_MONTHLY = """monthly AS (SELECT * FROM (SELECT id, t AS ts, CASE WHEN id % 97 = 0 THEN '2024-01' ELSE strftime(t, '%Y-%m') END AS month
FROM (SELECT id, date_trunc('day', ts) + to_months(CAST(id % 5 AS INT)) AS t FROM requests)) WHERE month <> '2024-03')"""


@query(f"WITH {_MONTHLY} SELECT month, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last FROM monthly GROUP BY month", "requests")
def s07_list_partitions(spark, d):
    return S.list_partitions(_monthly(spark, d)).select("month", "n", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")])


@query(
    f"""WITH {_MONTHLY} SELECT month, issue, n FROM (VALUES ('2024-03', 'gap', 0), ('2024-06', 'missing current', 0), ('2024-07', 'missing next', 0)) v(month, issue, n)
UNION ALL SELECT month, 'outside range', count(*) FROM monthly WHERE month <> strftime(ts, '%Y-%m') GROUP BY month HAVING count(*) > 0""",
    "requests",
)
def s07_partition_health(spark, d):
    return S.partition_health(_monthly(spark, d), "2024-06-10 00:00:00").select("month", "issue", F.col("n").cast("long").alias("n"))


@query(f"WITH {_MONTHLY} SELECT month, count(*) AS n FROM monthly WHERE month >= '2024-04' GROUP BY month", "requests")
def s08_drop_partitions(spark, d):
    return S.count_by(S.drop_partitions(_monthly(spark, d), "2024-06-10 00:00:00", 2), "month")


@query(f"WITH {_MONTHLY} SELECT month, count(*) AS n FROM monthly WHERE month >= '2024-03' AND ts >= TIMESTAMP '2024-06-10' - INTERVAL 90 DAY GROUP BY month", "requests")
def s08_delete_old_logs(spark, d):
    return S.count_by(S.delete_old_logs(_monthly(spark, d), "2024-06-10 00:00:00"), "month")


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 9 OR doc_id % 3 = 0")
def s09_upsert_chunks(spark, d):
    own = docs(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "lang", "doc_id")
    old = own.filter("doc_id % 10 <> 9").drop("doc_id")
    new = own.filter("doc_id % 3 = 0").select("chunk_id", F.upper("lang").alias("lang"))
    return S.upsert_chunks(S.upsert_chunks(old, new), new)


def _rows_by_id(spark, d):
    """The documents' languages in a table of batches: all, then every third again in upper case, twice over."""
    own = docs(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "lang", "source", "doc_id")
    table = S.Batches(spark, new_path(spark, "rows"), "chunk_id string, lang string, source string", "chunk_id", 16)
    table.write(0, own.filter("doc_id % 10 <> 9"))
    for _ in range(2):
        table.write(1, own.filter("doc_id % 3 = 0").withColumn("lang", F.upper("lang")))
    return own, table


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 9 OR doc_id % 3 = 0")
def s09_upsert_table(spark, d):
    """The same upsert into a stored table that takes batches, merged by a compaction."""
    table = _rows_by_id(spark, d)[1]
    table.compact(2)
    return table.current().select("chunk_id", "lang")


@query("""SELECT source, count(*) AS n, (SELECT count(*) FROM documents WHERE source IN ('src1', 'src2') AND (doc_id % 10 <> 9 OR doc_id % 3 = 0)) AS deleted FROM documents
WHERE (doc_id % 10 <> 9 OR doc_id % 3 = 0) AND source NOT IN ('src1', 'src2') GROUP BY source""")
def s10_delete_from_table(spark, d):
    """Rows of two sources removed from a stored table; what is left by source, with the number removed."""
    own, table = _rows_by_id(spark, d)
    deleted = S.delete_from(table, 2, own.filter("source in ('src1', 'src2')"))
    return S.count_by(table.current().filter("source is not null"), "source").withColumn("deleted", F.lit(deleted).cast("long"))


@query(f"WITH {_MONTHLY} SELECT month, count(*) AS n FROM monthly WHERE month >= '2024-04' GROUP BY month", "requests")
def s08_remove_months(spark, d):
    """Months before the cutoff removed from stored logs; the rows that the table still has."""
    at, logs = new_path(spark, "logs"), _monthly(spark, d)
    logs.write.partitionBy("month").parquet(at)
    S.remove_months(spark, at, "2024-06-10 00:00:00", 2)
    return S.count_by(spark.read.schema(logs.schema).parquet(at), "month")


@query("SELECT count(*) AS deleted FROM documents WHERE source IN ('src1', 'src2')")
def s10_delete_chunks(spark, d):
    keys = docs(spark, d).select("source").filter("source in ('src1', 'src2')")
    return S.delete_chunks(docs(spark, d), keys)[1]


@query("SELECT lang AS source_type, count(*) AS points, count(DISTINCT source) AS sources FROM documents GROUP BY ROLLUP (lang)")
def s11_store_stats(spark, d):
    return S.store_stats(docs(spark, d).withColumnRenamed("lang", "source_type"))


@query("""SELECT '{"source":"' || source || '","n":' || count(*) || '}' AS json FROM documents GROUP BY source""")
def s12_export_report(spark, d):
    at = new_path(spark, "report")
    C.export_report(S.count_by(docs(spark, d), "source"), at)
    return C.as_json(spark.read.schema("source string, n long").json(at))


_CHANGES = """changes AS (SELECT coalesce(c.file_path, r.file_path) AS file_path, CASE WHEN r.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted'
WHEN c.content_hash <> r.content_hash THEN 'changed' ELSE 'unchanged' END AS state FROM current c FULL JOIN registry r ON c.file_path = r.file_path)"""


@query(f"WITH {_CHANGES} SELECT * FROM changes", "registry current")
def i01_detect_changes(spark, d):
    return T.detect_changes(V.current(spark, d), V.registry(spark, d))


@query(
    f"WITH {_CHANGES} SELECT " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ("new", "changed", "deleted", "unchanged")) + ", count(*) FILTER (WHERE state IN ('new', 'changed')) AS to_process FROM changes",
    "registry current",
)
def i02_change_summary(spark, d):
    return T.change_summary(T.detect_changes(V.current(spark, d), V.registry(spark, d)))


@query(
    """SELECT coalesce(c.file_path, r.file_path) AS file_path, coalesce(c.content_hash, r.content_hash) AS content_hash,
CASE WHEN r.file_path IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS ingested, CASE WHEN c.file_path IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS updated
FROM (SELECT * FROM current WHERE hash(file_path) IS NOT NULL) c FULL JOIN registry r ON c.file_path = r.file_path""",
    "registry current",
)
def i03_registry_upsert(spark, d):
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    old = V.registry(spark, d).withColumn("ingested_at", first).withColumn("updated_at", first)
    new = V.current(spark, d).withColumn("chunk_count", F.lit(1).cast("long"))
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return T.registry_upsert(old, new, "2024-02-01 00:00:00").select("file_path", "content_hash", day("ingested_at", "ingested"), day("updated_at", "updated"))


@query("SELECT source_type, count(*) AS files, CAST(sum(chunk_count) AS BIGINT) AS chunks, CAST(sum(file_size) AS BIGINT) AS bytes, grouping(source_type) = 1 AS is_total FROM registry GROUP BY ROLLUP (source_type)", "registry")
def i04_registry_stats(spark, d):
    return T.registry_stats(V.registry(spark, d))


@query("SELECT p_size AS size, substr(md5(p_size || ':200:semantic:' || p_brand || ':64'), 1, 16) AS config_hash, substr(md5(p_size || ':200:semantic:' || p_brand || ':64'), 1, 16) <> 'none' AS changed FROM part")
def i05_config_changed(spark, d):
    part = V.table(spark, d, "part").select(F.col("p_size").alias("size"), F.lit(200).alias("overlap"), F.lit("semantic").alias("mode"), F.col("p_brand").alias("model"), F.lit(64).alias("dims"))
    stored = part.limit(1).select(F.lit("none").alias("config_hash"))
    return T.config_changed(part, stored).select("size", "config_hash", "changed")


@query(
    """WITH n AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS source_index FROM documents),
h AS (SELECT doc_id, source_index, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || ':' || source_index || ':' || substr(md5(text), 1, 16))) AS h FROM n)
SELECT doc_id, source_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h"""
)
def i06_chunk_id(spark, d):
    return T.number_chunks(docs(spark, d), order=("doc_id",)).select("doc_id", F.col("source_index").cast("long").alias("source_index"), "chunk_id")


def _staging(spark, d):
    rows = V.table(spark, d, "events").select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("transaction_id"), F.col("event_id").cast("string").alias("chunk_id"), "event_type", F.col("ts").cast("timestamp").alias("staged_at"))
    status = F.when(F.col("event_type") == "view", "committed").when(F.col("event_type") == "error", "rolled_back").otherwise("staged")
    return rows.withColumn("status", status).withColumn("finished_at", F.when(status != "staged", F.col("staged_at"))).drop("event_type")


_STAGING = """staging AS (SELECT 't' || user_id AS transaction_id, CAST(event_id AS VARCHAR) AS chunk_id, ts AS staged_at,
CASE event_type WHEN 'view' THEN 'committed' WHEN 'error' THEN 'rolled_back' ELSE 'staged' END AS status FROM events)"""


@query(
    f"""WITH {_STAGING}, s AS (SELECT *, CASE WHEN transaction_id = 't7' AND status = 'staged' THEN 'committed' ELSE status END AS now FROM staging)
SELECT count(*) AS entries, count(DISTINCT transaction_id) AS transactions, count(*) FILTER (WHERE now = 'staged') AS staged, count(*) FILTER (WHERE now = 'committed') AS committed,
count(*) FILTER (WHERE now = 'rolled_back') AS rolled_back, strftime(min(staged_at) FILTER (WHERE now = 'staged'), '%Y-%m-%d %H:%M:%S') AS oldest_staged FROM s"""
)
def i07_staging_stats(spark, d):
    done = T.finish(_staging(spark, d), "t7", "committed", AS_OF)
    return T.staging_stats(done).withColumn("oldest_staged", F.date_format("oldest_staged", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {_STAGING} SELECT transaction_id, count(*) AS chunks FROM staging WHERE status = 'staged' AND staged_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1")
def i08_orphans(spark, d):
    return T.orphans(_staging(spark, d), AS_OF).select("transaction_id", "chunks")


@query(f"WITH {_STAGING} SELECT status, count(*) AS n FROM staging WHERE status = 'staged' OR staged_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1")
def i08_purge_finished(spark, d):
    return S.count_by(T.purge_finished(_staging(spark, d), AS_OF), "status")


def _fresh(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("kubernetes", "docker", "helm", "other")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    own = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("source_type"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp")).alias("last_commit"))
    return T.freshness(own, "1998-08-01 00:00:00")


_FRESH = """f AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor((epoch(TIMESTAMP '1998-08-01') - epoch(o_orderdate)) / 86400) AS INT) ELSE -1 END AS days, o_orderkey % 11 = 0 AS u FROM orders),
fresh AS (SELECT id, days, CASE WHEN u THEN 'unknown' WHEN days <= [7, 14, 14, 30][k + 1] THEN 'fresh' WHEN days <= [30, 60, 60, 90][k + 1] THEN 'low' WHEN days <= [90, 180, 180, 365][k + 1] THEN 'medium' ELSE 'high' END AS risk FROM f)"""


@query(f"WITH {_FRESH} SELECT * FROM fresh")
def i09_freshness(spark, d):
    return _fresh(spark, d).select("id", "days", "risk")


@query(f"WITH {_FRESH} SELECT count(*) AS sources, count(*) FILTER (WHERE risk IN ('medium', 'high')) AS stale, count(*) FILTER (WHERE risk = 'fresh') AS fresh FROM fresh")
def i10_freshness_report(spark, d):
    return T.freshness_report(_fresh(spark, d))


@query(f"WITH {_FRESH} SELECT id, risk FROM fresh WHERE risk IN ('medium', 'high')")
def i10_stale_sources(spark, d):
    return T.stale_sources(_fresh(spark, d)).select("id", "risk")


@query()
def i11_ingest(spark, d):
    own = docs(spark, d).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.md5("text").alias("content_hash"), F.col("source").alias("source_type"), F.col("n_chars").alias("file_size"), "text")
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    registry = V.registry(spark, d).withColumn("ingested_at", first).withColumn("updated_at", first)
    store = own.limit(0).select(F.col("file_path").alias("chunk_id"), F.col("file_path").alias("source"), "source_type", F.lit("prose").alias("content_type"), F.lit("").alias("heading_path"), "text")
    done = ingest(own, registry, store, AS_OF)
    return done.store.groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("files"))


# chunking: documents with marks of markdown added by line number


def markdown(spark, d):
    def line(x, i):
        k = i % 7
        return (
            F.when(k == 0, F.concat(F.lit("# "), x)).when(k == 2, F.concat(F.lit("- "), x)).when(k == 3, F.concat(F.lit("```py\n"), x, F.lit("\n```")))
            .when(k == 4, F.concat(F.lit("## "), x)).when(k == 5, F.concat(F.lit("|"), x, F.lit("|"))).otherwise(x)
        )

    return docs(spark, d).select("doc_id", "source", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


_MARKDOWN = """markdown AS (SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: CASE (j - 1) % 7 WHEN 0 THEN '# ' || x WHEN 2 THEN '- ' || x
WHEN 3 THEN '```py' || chr(10) || x || chr(10) || '```' WHEN 4 THEN '## ' || x WHEN 5 THEN '|' || x || '|' ELSE x END), chr(10)) AS text FROM documents)"""


@query()
def k01_split_fixed(spark, d):
    return docs(spark, d).select("doc_id", F.explode(K.split_fixed(F.col("text"))).alias("chunk")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("chunk")).alias("longest"))


_TYPES = f"""WITH {_MARKDOWN}, l AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), chr(10)), 1) AS i FROM markdown),
f AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM l),
c AS (SELECT doc_id, fence OR inside AS code, NOT (fence OR inside) AND regexp_matches(line, '^\\s*[-*+]\\s|^\\s*\\d+\\.\\s') AS listed, NOT (fence OR inside) AND regexp_matches(line, '^\\|.*\\|') AS tabled FROM f),
s AS (SELECT doc_id, count(*) * 0.5 AS half, count(*) FILTER (WHERE code) AS code, count(*) FILTER (WHERE listed) AS list, count(*) FILTER (WHERE tabled AND NOT listed) AS tab FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN code > half THEN 'code' WHEN tab > half THEN 'table' WHEN list > half THEN 'list' WHEN code + tab + list > 0 THEN 'mixed' ELSE 'prose' END AS content_type FROM s"""


@query(_TYPES)
def k02_content_type(spark, d):
    return markdown(spark, d).select("doc_id", K.content_type(F.col("text")).alias("content_type"))


@query(f"WITH {_MARKDOWN}, b AS (SELECT doc_id, unnest(regexp_extract_all(text, '```(\\w*)\\n([^`]*?)```', 2)) AS code FROM markdown) SELECT doc_id, md5(code) AS code, 'py' AS language FROM b")
def k03_code_blocks(spark, d):
    return markdown(spark, d).select("doc_id", F.explode(K.code_blocks(F.col("text"))).alias("b")).select("doc_id", F.md5("b.code").alias("code"), "b.language")


@query(
    f"""WITH {_MARKDOWN}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM markdown),
f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM l),
h AS (SELECT *, sum(CASE WHEN NOT inside AND regexp_matches(line, '^#{{1,4}}(\\s|$)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM f),
t AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY i) AS text FROM h GROUP BY doc_id, section)
SELECT doc_id, md5(text) AS text FROM t WHERE regexp_matches(text, '\\S')"""
)
def k04_sections(spark, d):
    return markdown(spark, d).select("doc_id", F.explode(K.sections(F.col("text"))).alias("s")).select("doc_id", F.md5("s.text").alias("text"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_brand || ' > ' || p_type END AS path FROM part")
def k05_heading_path(spark, d):
    deep = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("## "), F.col("p_type")))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), K.heading_path(F.col("p_brand"), F.lit(None).cast("string"), deep, F.lit("")).alias("path"))


@query()
def k06_chunk_documents(spark, d):
    return K.chunk_documents(markdown(spark, d)).groupBy("content_type").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("characters"), F.count_distinct("heading_path").alias("paths")
    )


@query()
def k07_split_code(spark, d):
    code = docs(spark, d).select("doc_id", F.concat(F.lit("```py\n"), F.col("text"), F.lit("\n```\nend")).alias("text"))
    return code.select("doc_id", F.size(K._udf(K.split_code)(F.col("text"))).alias("chunks"))


@query(f"SELECT content_type, count(*) AS n FROM ({_TYPES}) t GROUP BY content_type")
def k08_chunk_type_counts(spark, d):
    """Documents, each one chunk, by type; k08_chunk_type_counts_chunks cuts them first."""
    return K.chunk_type_counts(markdown(spark, d).select(K.content_type(F.col("text")).alias("content_type")))


@query()
def k08_chunk_type_counts_chunks(spark, d):
    """Chunks by type."""
    return K.chunk_type_counts(K.chunk_documents(markdown(spark, d))).orderBy("content_type")


# dedup

_NORMAL = "normal AS (SELECT doc_id, source, lang, trim(regexp_replace(lower(nfkc), '\\s+', ' ', 'g')) AS t FROM (SELECT *, text AS nfkc FROM documents))"


@query(f"WITH {_NORMAL} SELECT doc_id, md5(t) AS normal FROM normal")
def d01_normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(D.normalize_text(F.col("text"))).alias("normal"))


@query(f"WITH {_NORMAL} SELECT doc_id, sha256(t) AS content_hash FROM normal")
def d02_content_hash(spark, d):
    return docs(spark, d).select("doc_id", D.content_hash(D.normalize_text(F.col("text"))).alias("content_hash"))


@query(f"WITH {_NORMAL} SELECT min(doc_id) AS doc_id FROM normal GROUP BY t")
def d03_dedup_exact_first(spark, d):
    return D.dedup_exact(docs(spark, d), "doc_id").select("doc_id")


@query(f"WITH {_NORMAL} SELECT max(doc_id) AS doc_id FROM normal GROUP BY t")
def d03_dedup_exact_last(spark, d):
    return D.dedup_exact(docs(spark, d), "doc_id", keep="last").select("doc_id")


_SIM = f"""{_NORMAL}, tok AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM normal),
cnt AS (SELECT doc_id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h, count(*) AS c FROM tok GROUP BY doc_id, w),
bits AS (SELECT doc_id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1::UBIGINT = 1 THEN c ELSE -c END) AS s FROM cnt, range(64) r(i) GROUP BY doc_id, i),
sim AS (SELECT d.doc_id, coalesce(CAST(sum(CASE WHEN s > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS UBIGINT), 0) AS v FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY d.doc_id)"""


@query(f"WITH {_SIM} SELECT doc_id, lpad(lower(printf('%x', v)), 16, '0') AS simhash FROM sim")
def d04_simhash(spark, d):
    return docs(spark, d).select("doc_id", F.lower(F.lpad(F.hex(D.simhash64(F.col("text"))), 16, "0")).alias("simhash"))


def _hashes(spark, d):
    return spread(docs(spark, d)).select("doc_id", D.simhash64(F.col("text")).alias("simhash"))


@query(f"WITH {_SIM} SELECT a.doc_id, bit_count(xor(a.v, b.v)) AS distance, round(1 - bit_count(xor(a.v, b.v)) / 64, 6) AS similarity FROM sim a JOIN sim b ON b.doc_id = a.doc_id + 1")
def d05_hamming(spark, d):
    a = checkpoint(_hashes(spark, d))  # hashed once, read twice
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("next"))
    x, y = F.col("simhash"), F.col("next")
    return a.join(b, "doc_id").select("doc_id", D.hamming(x, y).cast("long").alias("distance"), F.round(D.similarity(x, y), 6).alias("similarity"))


@query(f"WITH {_SIM} SELECT a.doc_id AS earlier, b.doc_id AS later FROM sim a JOIN sim b ON a.doc_id < b.doc_id AND bit_count(xor(a.v, b.v)) <= 3")
def d06_near_pairs(spark, d):
    return D.near_pairs(_hashes(spark, d), "doc_id")


# A scan over the exact survivors in order: each is held against the values that stay. Rows without a neighbour stay by themselves.
_GREEDY = f"""WITH RECURSIVE {_SIM}, s AS (SELECT min(n.doc_id) AS doc_id FROM normal n GROUP BY t), v AS MATERIALIZED (SELECT sim.* FROM sim JOIN s USING (doc_id)),
near AS (SELECT a.doc_id, any_value(a.v) AS v FROM v a JOIN v b ON a.doc_id <> b.doc_id AND bit_count(xor(a.v, b.v)) <= 3 GROUP BY a.doc_id),
line AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM near),
scan AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, false AS falls, []::UBIGINT[] AS kept
UNION ALL SELECT i, doc_id, hit, CASE WHEN hit THEN kept ELSE list_append(kept, v) END
FROM (SELECT l.i, l.doc_id, l.v, scan.kept, len(list_filter(scan.kept, lambda k: bit_count(xor(k, l.v)) <= 3)) > 0 AS hit FROM scan JOIN line l ON l.i = scan.i + 1)),
fuzzy AS (SELECT doc_id FROM scan WHERE falls)"""


@query(f"{_GREEDY} SELECT doc_id FROM fuzzy")
def d07_dedup_fuzzy_first(spark, d):
    return D.mark_duplicates(docs(spark, d).select("doc_id", "text"), "doc_id").filter("is_fuzzy_duplicate").select("doc_id")


@query(
    f"""WITH {_SIM}, s AS (SELECT max(n.doc_id) AS doc_id FROM normal n GROUP BY t), v AS (SELECT sim.* FROM sim JOIN s USING (doc_id))
SELECT DISTINCT a.doc_id FROM v a JOIN v b ON a.doc_id < b.doc_id AND bit_count(xor(a.v, b.v)) <= 3"""
)
def d08_dedup_fuzzy_last(spark, d):
    return D.mark_duplicates(docs(spark, d).select("doc_id", "text"), "doc_id", keep="last").filter("is_fuzzy_duplicate").select("doc_id")


@query(
    f"""{_GREEDY}, g AS (SELECT count(*) AS c FROM normal GROUP BY t), n AS (SELECT CAST(sum(c) AS BIGINT) AS input, CAST(sum(c) - count(*) AS BIGINT) AS exact_removed, (SELECT count(*) FROM fuzzy) AS fuzzy_removed FROM g)
SELECT input, input - exact_removed - fuzzy_removed AS output, exact_removed, fuzzy_removed, round((exact_removed + fuzzy_removed) / input * 100, 2) AS rate_percent FROM n"""
)
def d09_dedup_stats(spark, d):
    return D.dedup_stats(D.mark_duplicates(docs(spark, d), "doc_id"))


@query(
    f"""{_GREEDY}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS k FROM normal), x AS (SELECT lang, source, '' AS kind FROM r WHERE k > 1 UNION ALL SELECT lang, source, ' (fuzzy)' FROM normal JOIN fuzzy USING (doc_id))
SELECT coalesce(lang, 'unknown') || ':' || coalesce(source, 'unknown') || kind AS key, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, key LIMIT 20"""
)
def d09_duplicates_by_source(spark, d):
    return D.duplicates_by_source(D.mark_duplicates(docs(spark, d), "doc_id"), "lang", "source")


@query(f"WITH {_NORMAL} SELECT sha256(t) AS content_hash, count(*) AS n, min(doc_id) AS first FROM normal GROUP BY t HAVING count(*) > 1")
def d10_duplicate_groups(spark, d):
    return D.duplicate_groups(docs(spark, d), "doc_id")


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY source, text) SELECT CAST(sum(n) AS BIGINT) AS points, count(*) AS \"unique\", count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n) - count(*) AS BIGINT) AS surplus, round((sum(n) - count(*)) / sum(n) * 100, 2) AS rate_percent FROM g")
def d11_audit_duplicates(spark, d):
    return D.audit_duplicates(docs(spark, d))
