"""Queries of the query-understanding, retrieval, evaluation and validation operators over the given tables."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpusloom.functions.storage import checkpoint
from corpusloom.operators import evaluate as E
from corpusloom.operators import query as Q
from corpusloom.operators import retrieval as R
from corpusloom.operators import validate as O
from corpusloom.plans import views as V
from corpusloom.plans.registry import query

#: Wordings that are combined with the rows of events into a table of questions.
WORDINGS = (
    "How do I debug  it?", "k8s ns and hpa limits", "explain the difference between pv and pvc", "Create a deployment for the service and expose port :8080, then scale",
    "kubectl get pods -n kube-system", "compare helm vs kustomize, which is better if the chart grows and the values change and the team is new",
    "terraform plan failed with exception in module", "what is gitlab ci/cd", "2024-01-02 10:11:12 ERROR timeout on 10.0.0.1:443", "write an ansible playbook role, task, handler, inventory",
    "why does this happen before the previous step", "aws az gh tf iac",
)
_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in WORDINGS) + "]"
_QUESTIONS = f"questions AS (SELECT event_id AS query_id, CAST(user_id AS VARCHAR) AS session_id, event_id % 3 AS turn, {_LIST}[event_id % {len(WORDINGS)} + 1] || ' ' || event_type AS text FROM events)"


def questions(spark, d):
    pick = F.element_at(F.array(*map(F.lit, WORDINGS)), (F.col("event_id") % len(WORDINGS) + 1).cast("int"))
    return V.table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.col("user_id").cast("string").alias("session_id"), F.concat_ws(" ", pick, "event_type").alias("text"))


def messages(spark, d):
    pick = F.element_at(F.array(*map(F.lit, WORDINGS)), ((F.col("conv_id") + F.col("turn")) % len(WORDINGS) + 1).cast("int"))
    return V.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.concat_ws(" ", pick, "text").alias("text"))


_MESSAGES = f"messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, {_LIST}[(conv_id + turn) % {len(WORDINGS)} + 1] || ' ' || text AS text FROM conversations)"


def _re(pattern, column="text"):
    flag = ""
    if pattern.startswith("(?i)"):
        pattern, flag = pattern[4:], ", 'i'"
    elif pattern.startswith("(?im)"):
        pattern, flag = "(?m)" + pattern[5:], ", 'i'"
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}'{flag})"


def _rewrites():
    out = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    for a, b in Q.ABBREVIATIONS:
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'gi')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"WITH {_QUESTIONS} SELECT query_id, {_rewrites()} AS expanded FROM questions")
def q01_expand_abbreviations(spark, d):
    return questions(spark, d).select("query_id", Q.expand_abbreviations(F.col("text")).alias("expanded"))


@query(f"WITH {_QUESTIONS} SELECT query_id, {_re(Q.CODE_QUERY)} AS is_code FROM questions")
def q02_is_code_query(spark, d):
    return questions(spark, d).select("query_id", Q.is_code_query(F.col("text")).alias("is_code"))


@query(f"WITH {_QUESTIONS} SELECT query_id, CASE WHEN {_re(Q.CODE_QUERY)} THEN '{Q.CODE_PREFIX}' ELSE '{Q.GENERAL_PREFIX}' END || text AS prefixed FROM questions")
def q03_embed_prefix(spark, d):
    return questions(spark, d).select("query_id", Q.embed_prefix(F.col("text")).alias("prefixed"))


_SCORE = "CAST(len(regexp_extract_all(text, '\\S+')) > 20 AS INT) + CAST((length(text) - length(replace(text, ' and ', ''))) / 5 >= 2 OR length(text) - length(replace(text, ',', '')) >= 3 AS INT) + " + " + ".join(f"CAST({_re(p)} AS INT)" for _, p in Q.COMPLEXITY)


@query(f"WITH {_QUESTIONS} SELECT query_id, s AS score, s >= 2 AS is_complex, CASE WHEN s >= 3 THEN 'full' WHEN s = 2 THEN 'short' ELSE 'none' END AS scaffold FROM (SELECT query_id, {_SCORE} AS s FROM questions)")
def q04_complexity(spark, d):
    return questions(spark, d).select("query_id", Q.complexity(F.col("text")).alias("c")).select("query_id", "c.*")


@query(f"WITH {_QUESTIONS} SELECT query_id, CASE " + " ".join(f"WHEN {_re(p)} THEN '{n}'" for n, ps in Q.TASKS for p in ps) + " ELSE 'general' END AS task FROM questions")
def q05_task_type(spark, d):
    return questions(spark, d).select("query_id", Q.task_type(F.col("text")).alias("task"))


@query(f"WITH {_QUESTIONS} SELECT query_id, CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{n}'" for n, ks in Q.DOMAINS for k in ks) + " END AS domain FROM questions")
def q06_few_shot_domain(spark, d):
    return questions(spark, d).select("query_id", Q.few_shot_domain(F.col("text")).alias("domain"))


@query(
    f"WITH {_QUESTIONS} SELECT query_id, CASE WHEN length(trim(text)) < 10 THEN 'query_too_short' WHEN length(trim(text)) > 500 THEN 'query_too_long' "
    + " ".join(f"WHEN {_re(p, 'trim(text)')} THEN '{n}'" for n, p in Q.SKIPS)
    + " WHEN len(regexp_extract_all(text, '\\S+')) > 30 THEN 'too_many_words' END AS skip_reason FROM questions"
)
def q07_hyde_gate(spark, d):
    return questions(spark, d).select("query_id", Q.hyde_gate(F.col("text")).alias("skip_reason"))


_MODELS = ("llama3.1:8b", "llama3:8b", "Mistral-7b", "phi3", "other")


@query(
    f"SELECT event_id AS id, CASE " + " ".join(f"WHEN contains(lower(m), '{n}') THEN {v}" for n, v in Q.CONTEXT_LIMITS) + f" ELSE 4096 END AS context_limit FROM (SELECT event_id, {list(_MODELS)}[event_id % 5 + 1] AS m FROM events)"
)
def q08_context_limit(spark, d):
    name = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % 5 + 1).cast("int"))
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), Q.context_limit(name).alias("context_limit"))


@query(f"WITH {_QUESTIONS} SELECT query_id, substr(sha256(text), 1, 12) AS sha12, substr(sha256(text), 1, 16) AS sha16, substr(md5(text), 1, 12) AS md5_12, substr(md5(text), 1, 16) AS md5_16 FROM questions")
def q09_query_hash(spark, d):
    return questions(spark, d).select("query_id", Q.query_hashes(F.col("text")).alias("h")).select("query_id", "h.*")


@query(f"WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM messages) SELECT session_id, md5(string_agg(turn || role || text, '|' ORDER BY turn)) AS history, max(n) AS messages, max(n) > 4 AS is_cut FROM r WHERE k <= 4 GROUP BY session_id")
def q10_history(spark, d, held=messages):
    joined = F.array_join(F.transform("history", lambda m: F.concat(m["turn"].cast("string"), m["role"], m["text"])), "|")
    return Q.history(held(spark, d), 4).select("session_id", F.md5(joined).alias("history"), "messages", "is_cut")


@query(f"WITH {_QUESTIONS} SELECT query_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_re(p)} THEN '{n}' END" for n, p in Q.REFERENCES) + "], lambda x: x IS NOT NULL), ',') AS refs FROM questions")
def q11_references(spark, d):
    return questions(spark, d).select("query_id", F.array_join(Q.references(F.col("text")), ",").alias("refs"))


_TERMS = "flatten([" + ", ".join(f"regexp_extract_all(lower(text), '{p[4:]}')" for p in Q.TERM_FAMILIES) + "])"


@query(f"WITH {_MESSAGES} SELECT session_id, turn, array_to_string(list_sort(list_distinct(list_filter({_TERMS}, lambda t: length(t) > 2 AND t <> 'step'))), ',') AS terms FROM messages")
def q12_domain_terms(spark, d, held=messages):
    return held(spark, d).select("session_id", "turn", F.array_join(F.array_sort(Q.domain_terms(F.col("text"))), ",").alias("terms"))


@query(
    f"""WITH {_MESSAGES}, t AS (SELECT *, list_filter({_TERMS}, lambda t: length(t) > 2 AND t <> 'step') AS own, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i FROM messages),
b AS (SELECT a.session_id, a.turn, list_sort(list_distinct(flatten(list(b.own))))[1:10] AS terms, max_by(b.own, b.turn) FILTER (WHERE b.role = 'user') AS last
FROM t a LEFT JOIN t b ON b.session_id = a.session_id AND b.i BETWEEN a.i - 6 AND a.i - 1 GROUP BY a.session_id, a.turn),
c AS (SELECT *, list_sort(list_distinct(coalesce(last, []))) AS s FROM b)
SELECT session_id, turn, coalesce(array_to_string(terms, ','), '') AS terms, array_to_string((CASE WHEN len(list_filter(s, lambda x: x IN {Q.TOPIC_FIRST})) > 0 THEN list_filter(s, lambda x: x IN {Q.TOPIC_FIRST}) ELSE s END)[1:2], ' ') AS topic FROM c"""
)
def q13_conversation_context(spark, d, held=messages):
    return Q.conversation_context(held(spark, d)).select("session_id", "turn", F.array_join("terms", ",").alias("terms"), "topic")


_ANY_REFERENCE = "(" + " OR ".join(_re(p, "trim(text)") for _, p in Q.REFERENCES) + ")"


@query(
    f"""WITH {_MESSAGES}, b AS (SELECT *, count(*) OVER w AS before, count(*) FILTER (WHERE role = 'user') OVER w AS users, len(list_distinct(list_filter({_TERMS}, lambda t: length(t) > 2 AND t <> 'step'))) AS terms
FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT session_id, turn, CASE WHEN before = 0 THEN 'no_conversation_history' WHEN users = 0 THEN 'no_prior_user_messages' WHEN {_ANY_REFERENCE} AND length(trim(text)) < 50 THEN NULL
WHEN len(regexp_extract_all(text, '\\S+')) <= 5 THEN NULL WHEN terms >= 3 THEN 'query_already_specific' WHEN length(trim(text)) <= 200 THEN NULL ELSE 'query_too_long' END AS skip_reason FROM b"""
)
def q14_should_expand(spark, d):
    return Q.conversation_context(messages(spark, d)).select("session_id", "turn", Q.should_expand(F.col("text"), F.col("history_size"), F.col("has_user")).alias("skip_reason"))


@query()
def q15_expand_followup(spark, d):
    return Q.conversation_context(messages(spark, d)).select("session_id", "turn", Q.expand_followup(F.col("text"), F.col("terms"), F.col("topic")).alias("expanded"))


@query(
    f"""WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM messages)
SELECT session_id, turn, CASE WHEN k > 2 THEN 'summarise' ELSE 'keep' END AS action FROM r WHERE n >= 5 AND n - 2 >= 2"""
)
def q16_compaction_plan(spark, d):
    return Q.compaction_plan(messages(spark, d), 5, 2).select("session_id", "turn", "action")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS user_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def q16_session_stats(spark, d):
    return Q.session_stats(messages(spark, d))


@query("SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' for <who> at ' || CASE WHEN o_custkey % 2 = 0 THEN 'depot' ELSE 'here' END || ' {{raw}}' AS rendered FROM orders")
def q17_render_templates(spark, d):
    prompt = F.lit("Order {key} for {who} at {place} {{raw}}")
    none = F.lit(None).cast("string")
    v = lambda n, kind, default: F.struct(F.lit(n).alias("name"), F.lit(kind).alias("type"), default.alias("default"))
    variables = F.array(v("key", "number", none), v("place", "string", F.lit("here")))
    values = F.map_filter(F.create_map(F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("place"), F.when(F.col("o_custkey") % 2 == 0, "depot")), lambda k, x: x.isNotNull())
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), Q.render_template(prompt, variables, values).alias("rendered"))


@query(f"WITH {_QUESTIONS} SELECT query_id, lower({_rewrites()}) AS expanded, concat_ws(',', CASE WHEN {_rewrites()} <> text THEN 'abbreviations' END, CASE WHEN lower({_rewrites()}) <> {_rewrites()} THEN 'lower' END) AS applied FROM questions")
def q18_chain_expanders(spark, d):
    out = Q.chain_expanders(questions(spark, d), [("abbreviations", Q.expand_abbreviations), ("lower", F.lower)])
    return out.select("query_id", "expanded", F.array_join("applied", ",").alias("applied"))


@query("SELECT doc_id, 'too_long' AS reason FROM documents WHERE length(trim(text)) > 2000 UNION ALL SELECT doc_id, 'empty' FROM documents WHERE length(trim(coalesce(text, ''))) = 0")
def q19_validate_queries(spark, d):
    return Q.validate_queries(V.table(spark, d, "documents").select("doc_id", "text"), 2000)[1].select("doc_id", "reason")


# retrieval


def corpus(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("type"), F.col("label").cast("string")).alias("source_type"))


def vectors(spark, d):
    return V.table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_COS = "list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e))"
_PAIRS = f"{_V}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label, {_COS} AS s FROM v a JOIN v b ON a.vec_id % 20 = 0)"


def _dense_sql(fetch, k, low, where=""):
    return f"""{_PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_id) AS i FROM p {where}),
dense AS (SELECT query_id, chunk_id, label, greatest(0, least(1, s)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0, least(1, s)), 12) DESC, chunk_id) AS rank FROM f WHERE i <= {fetch} AND greatest(0, least(1, s)) >= {low})"""


def _ranked(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_V} SELECT a.vec_id, round({_COS}, 6) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def r01_cosine(spark, d):
    a = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("SELECT event_id AS id, round(greatest(0, least(1, s)), 6) AS cosine, round(greatest(0, least(1, (s + 1) / 2)), 6) AS dot, round(exp(-abs(s)), 6) AS euclid FROM (SELECT event_id, (value - 200) / 150 AS s FROM events)")
def r02_normalize_score(spark, d):
    s = (F.col("value") - 200) / 150
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(R.normalize_score(s), 6).alias("cosine"), F.round(R.normalize_score(s, "dot"), 6).alias("dot"), F.round(R.normalize_score(-F.abs(s), "euclid"), 6).alias("euclid"))


@query(f"WITH {_dense_sql(15, 5, 0.3)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM dense WHERE rank <= 5")
def r03_dense_topk(spark, d):
    return _ranked(R.dense_topk(vectors(spark, d), corpus(spark, d)))


@query(f"WITH {_dense_sql(15, 5, 0.3, 'WHERE label = 3')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM dense WHERE rank <= 5")
def r04_dense_topk_batch(spark, d):
    return _ranked(R.dense_topk_batch(vectors(spark, d), corpus(spark, d), source_type="type3"))


@query()
def r05_quantized_topk(spark, d):
    return _ranked(R.quantized_topk(vectors(spark, d), corpus(spark, d)))


def _texts(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", F.col("lang").alias("source_type"))


def _text_queries(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(name, table, key, text):
    return f"""{name}_t AS (SELECT {key} AS key, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS ts FROM {table}), {name}_a AS (SELECT avg(len(ts)) AS a, count(*) AS n FROM {name}_t),
{name}_f AS (SELECT key, len(ts) AS l, unnest(ts) AS term FROM {name}_t), {name} AS (SELECT key, term, count(*) * 2.2::DOUBLE / (count(*) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / (SELECT a FROM {name}_a))) AS w FROM {name}_f GROUP BY key, l, term)"""


_C = _bm25("c", "documents", "doc_id", "text")
_BQ = "bq AS (SELECT item_id, text FROM benchmark)"
_SPARSE = f"{_C}, {_BQ}, {_bm25('q', 'bq', 'item_id', 'text')}, ss AS (SELECT q.key AS query_id, c.key AS chunk_id, sum(c.w * q.w) AS score FROM q JOIN c USING (term) GROUP BY 1, 2), sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ss)"


@query(f"WITH {_C} SELECT key AS chunk_id, count(*) AS terms, round(sum(w), 6) AS weight FROM c GROUP BY key")
def r06_sparse_encode(spark, d):
    return R.sparse_encode(_texts(spark, d), "chunk_id").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"WITH {_SPARSE} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM sparse WHERE rank <= 20")
def r07_sparse_topk(spark, d, asked=_text_queries):
    return _ranked(_sparse(spark, d, asked))


def _sparse(spark, d, asked):
    wanted = checkpoint(R.sparse_encode(asked(spark, d), "query_id"))
    return R.sparse_topk(wanted, R.sparse_encode(_texts(spark, d), "chunk_id", only=wanted), 20)


def _sides(spark, d):
    own = R.dense_topk(vectors(spark, d), corpus(spark, d), k=20, min_score=0.0, fetch=20)
    text = F.concat(F.lit("t"), F.expr("chunk_id div 2").cast("string")).alias("text")
    dense = own.filter("rank <= 12").select("query_id", "rank", "chunk_id", text)
    sparse = own.filter("rank > 6").select("query_id", (21 - F.col("rank")).alias("rank"), "chunk_id", text)
    return dense, sparse


@query(
    f"""WITH {_dense_sql(20, 20, 0)}, a AS (SELECT query_id, chunk_id // 2 AS k, max(rank) AS r, min(rank) AS f, min_by(chunk_id, rank) AS id FROM dense WHERE rank <= 12 GROUP BY 1, 2),
b AS (SELECT query_id, chunk_id // 2 AS k, max(21 - rank) AS r, min(21 - rank) AS f, min_by(chunk_id, 21 - rank) AS id FROM dense WHERE rank > 6 GROUP BY 1, 2),
m AS (SELECT query_id, coalesce(a.id, b.id) AS chunk_id, a.f AS af, b.f AS bf, coalesce(0.5 / (60 + a.r), 0) + coalesce(0.5 / (60 + b.r), 0) AS score FROM a FULL JOIN b USING (query_id, k))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, af NULLS LAST, bf NULLS LAST) AS rank, chunk_id, round(score, 6) AS score FROM m"""
)
def r08_rrf(spark, d):
    return _ranked(R.rrf(*_sides(spark, d)))


#: Length of a stand-in vector, and the words that are worked on at a time, besides a longer text.
WIDTH, WORDS = 16, 1 << 20


def _shares(words):
    """Of each list of words the shares with each CRC-32 modulo WIDTH; the sums of a word are found once."""
    coded, n = words.flatten().dictionary_encode(), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    kind = np.array([zlib.crc32(w.encode()) % WIDTH for w in coded.dictionary.to_pylist()], np.int64)
    cell = np.repeat(np.arange(len(n)) * WIDTH, n) + kind[coded.indices.to_numpy(zero_copy_only=False)]
    shares = np.bincount(cell, minlength=len(n) * WIDTH).reshape(-1, WIDTH) / np.maximum(n, 1)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * WIDTH, pa.int32()), pa.array(shares.ravel()), mask=words.is_null())


@F.arrow_udf(ArrayType(DoubleType()))
def _hashed(words: pa.Array) -> pa.Array:
    """A vector of 16 shares from the bytes of a text's words: a stand-in for an encoder. Null has none."""
    n = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // WORDS)) + 1).tolist(), len(n)]
    return pa.concat_arrays([_shares(words.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)])


@query()
def r09_hybrid_topk(spark, d):
    texts = _texts(spark, d)
    vectors = checkpoint(texts.select("chunk_id", _hashed(R.tokens(F.col("text"))).alias("embedding")))
    asked = checkpoint(_text_queries(spark, d).withColumn("embedding", _hashed(R.tokens(F.col("text")))))
    held = R.sparse_encode(texts, "chunk_id")
    return _ranked(R.hybrid_topk(asked, vectors, held, texts, 10))


def _candidates(spark, d, asked=_text_queries):
    top = checkpoint(_sparse(spark, d, asked))  # once, however often it is read
    return R.with_texts(top, _texts(spark, d)).join(asked(spark, d).withColumnRenamed("text", "query"), "query_id")


_OVERLAP = "len(list_intersect(list_distinct(qt.ts), ct.ts)) / len(list_distinct(qt.ts))"
_RERANK = f"""{_SPARSE}, k AS (SELECT query_id, chunk_id, rank AS prior, {_OVERLAP} AS raw FROM sparse JOIN q_t qt ON qt.key = query_id JOIN c_t ct ON ct.key = chunk_id WHERE rank <= 20),
ranked AS (SELECT *, 1 / (1 + exp(-(2 * raw - 1))) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-(2 * raw - 1))), 12) DESC, prior) AS rank FROM k)"""


@query(f"WITH {_RERANK} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def r10_rerank(spark, d, asked=_text_queries):
    return _ranked(R.rerank(_candidates(spark, d, asked).drop("score"), 5, calibration=(2.0, -1.0)).withColumnRenamed("rerank_score", "score"))


_LABELS = "ls AS (SELECT doc_id, n_chars / 10000.0 AS score, quality AS label FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_LABELS} SELECT doc_id, round(1 / (1 + exp(-(1.5 * score - 0.5))), 6) AS p FROM ls")
def r11_platt_apply(spark, d):
    own = V.table(spark, d, "labels").join(V.table(spark, d, "documents"), "doc_id")
    return own.select("doc_id", F.round(R.platt_apply(F.col("n_chars") / 10000.0, 1.5, -0.5), 6).alias("p"))


@query()
def r12_platt_fit(spark, d):
    own = V.table(spark, d, "labels").join(V.table(spark, d, "documents"), "doc_id").select("doc_id", (F.col("n_chars") / 10000.0).alias("score"), F.col("quality").alias("label"))
    a, b = R.platt_fit(own)
    return own.select("doc_id", F.round(R.platt_apply(F.col("score"), a, b), 4).alias("p"))


@query(f"WITH {_RERANK} SELECT query_id, chunk_id FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ranked) WHERE score >= 0.45 OR (rank = 1 AND best < 0.45)")
def r13_min_rerank(spark, d, asked=_text_queries):
    ranked = R.rerank(_candidates(spark, d, asked), 20, calibration=(2.0, -1.0))
    return R.min_rerank(ranked, 0.45).select("query_id", "chunk_id")


@query(
    f"""WITH {_RERANK}, t AS (SELECT r.query_id, r.chunk_id, substr(d.text, 1, 100) AS k, s.score AS old, s.rank AS prior_rank FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id JOIN sparse s USING (query_id, chunk_id)),
l AS (SELECT query_id, k, max_by(old, prior_rank) AS similarity FROM t GROUP BY 1, 2) SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM t JOIN l USING (query_id, k)"""
)
def r14_carry_similarity(spark, d, asked=_text_queries):
    before = _candidates(spark, d, asked)
    ranked = R.rerank(before.drop("score"), 20)
    return R.carry_similarity(ranked, before).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {_dense_sql(15, 5, 0.45)}, s AS (SELECT query_id, count(*) AS n, avg(score) AS a, max(score) AS m FROM dense WHERE rank <= 5 GROUP BY 1)
SELECT v.vec_id AS query_id, n IS NULL OR a < 0.6 AS search, CASE WHEN n IS NULL THEN 'no_local_results' WHEN a < 0.6 THEN 'low_avg_score' END AS reason FROM v LEFT JOIN s ON s.query_id = v.vec_id WHERE v.vec_id % 20 = 0"""
)
def r15_fallback_decision(spark, d):
    found = R.dense_topk(vectors(spark, d), corpus(spark, d), min_score=0.45)
    return R.fallback_decision(vectors(spark, d), found, 0.6).select("query_id", "search", F.regexp_replace("reason", r"_[0-9.]+$", "").alias("reason"))


@query(
    f"""WITH {_SPARSE}, a AS (SELECT query_id, trim(text) AS body, coalesce(lang, 'Unknown') AS kind, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS no FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
b AS (SELECT *, '[Source ' || no || ' - ' || kind || ']' || chr(10) AS head, CAST(no > 1 AS INT) AS gap FROM a), h AS (SELECT *, head || body || chr(10) AS whole FROM b), n AS (SELECT *, length(whole) // 4 + gap AS need FROM h),
u AS (SELECT *, sum(need) OVER (PARTITION BY query_id ORDER BY no) AS used FROM n), s AS (SELECT *, min(CASE WHEN used > 1500 THEN no END) OVER (PARTITION BY query_id) AS stop, 1500 - (used - need) - gap AS room FROM u),
p AS (SELECT query_id, no, stop, CASE WHEN stop IS NULL OR no < stop THEN whole WHEN no = stop AND room >= 50 AND room * 4 - length(head) - 20 > 100
THEN head || substr(body, 1, CAST(room * 4 - length(head) - 20 AS BIGINT)) || '...' || chr(10) END AS piece FROM s)
SELECT query_id, md5(coalesce(string_agg(piece, chr(10) || '---' || chr(10) ORDER BY no), '')) AS context, count(piece) AS n_sources, coalesce(bool_or(no = stop AND piece IS NOT NULL), false) AS is_truncated FROM p GROUP BY query_id"""
)
def r16_pack_context(spark, d):
    return R.pack_context(_candidates(spark, d, _text_queries), 1500).select("query_id", F.md5("context").alias("context"), "n_sources", "is_truncated")


@query(f"WITH {_SPARSE} SELECT query_id, chunk_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS content_preview, round(score, 4) AS score FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 20")
def r17_format_sources(spark, d, asked=_text_queries):
    return R.format_sources(_candidates(spark, d, asked)).select("query_id", "chunk_id", "content_preview", "score")


@query()
def r18_compress_extractive(spark, d):
    return R.compress_chunks(_candidates(spark, d, _text_queries), 3, 5).select("query_id", "chunk_id", F.md5("compressed.text").alias("text"), F.round("compressed.ratio", 6).alias("ratio"))


@query(f"WITH {_SPARSE} SELECT query_id, md5(string_agg(source || ':' || substr(text, 1, 200), '|' ORDER BY rank)) AS context_hash FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 20 GROUP BY query_id")
def r19_context_hash(spark, d, asked=_text_queries):
    return R.context_hash(_candidates(spark, d, asked))


def _cache_tables(spark, d):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    own = V.table(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("context_hash"), (base + F.make_interval(secs=F.col("vec_id") * 10)).alias("at"))
    asked = own.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "context_hash", F.col("at").alias("ts"))
    cache = own.filter("vec_id % 4 <> 0").select(F.col("vec_id").alias("entry_id"), "embedding", "context_hash", F.col("at").alias("stored_at"))
    return asked, cache


_LOOKUP = f"""{_V}, m AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, {_COS} AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0 AND b.vec_id <= a.vec_id AND (a.vec_id - b.vec_id) * 10 <= 3600),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, entry_id) AS k FROM m WHERE s >= 0.6), looked AS (SELECT v.vec_id AS query_id, w.entry_id, round(w.s, 6) AS similarity FROM v LEFT JOIN w ON w.query_id = v.vec_id AND k = 1 WHERE v.vec_id % 4 = 0)"""


@query(f"WITH {_LOOKUP} SELECT query_id, coalesce(entry_id, -1) AS entry_id, coalesce(similarity, 0) AS similarity FROM looked")
def r20_semantic_lookup(spark, d):
    return R.semantic_lookup(*_cache_tables(spark, d), 0.6).select(
        "query_id", F.coalesce("entry_id", F.lit(-1)).alias("entry_id"), F.coalesce(F.round("similarity", 6), F.lit(0.0)).alias("similarity")
    )


@query(f"WITH {_LOOKUP} SELECT count(entry_id) AS hits, count(*) - count(entry_id) AS misses, round(count(entry_id) / count(*), 4) AS hit_rate, (SELECT count(*) FROM embeddings WHERE vec_id % 4 <> 0) AS stores FROM looked")
def r21_semantic_cache_stats(spark, d):
    asked, cache = _cache_tables(spark, d)
    return R.semantic_cache_stats(R.semantic_lookup(asked, cache, 0.6), cache, "2024-01-01 01:00:00").select("hits", "misses", "hit_rate", "stores")


def _attached(spark, d):
    texts = V.table(spark, d, "documents").select("doc_id", "text", F.lit("m1").alias("model"))
    stored = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("doc_id") % 100)
    store = texts.filter("doc_id % 3 = 0").select(R.cache_key(F.col("model"), F.col("text")).alias("key"), F.array(F.col("doc_id").cast("double")).alias("embedding"), stored.alias("stored_at"))
    return R.attach_embeddings(texts, store, "2024-01-01 01:30:00")


_HIT = "EXISTS (SELECT 1 FROM documents s WHERE s.text = t.text AND s.doc_id % 3 = 0 AND s.doc_id % 100 BETWEEN 30 AND 90)"


@query(f"SELECT doc_id, {_HIT} AS is_hit FROM documents t")
def r22_attach_embeddings(spark, d):
    return _attached(spark, d).select("doc_id", "is_hit")


@query(f"SELECT md5('m1') || ':' || md5(text) AS key, count(*) AS wanted FROM documents t WHERE NOT {_HIT} GROUP BY text")
def r22_embedding_misses(spark, d):
    return R.embedding_misses(_attached(spark, d)).select("key", "wanted")


def _graded(spark, d):
    grade = F.when(F.col("event_id") % 9 != 0, (F.col("value") % 100) / 100)
    return V.table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), grade.alias("grade"), (F.col("user_id") % 3).alias("retries"))


_GRADED = "g AS (SELECT user_id AS query_id, event_id AS chunk_id, coalesce(CASE WHEN event_id % 9 <> 0 THEN (value % 100) / 100 END, 0) AS grade, user_id % 3 AS retries FROM events)"


@query(f"WITH {_GRADED} SELECT query_id, count(*) FILTER (WHERE grade >= 0.97) AS kept, count(*) FILTER (WHERE grade < 0.97) AS dropped, CASE WHEN count(*) FILTER (WHERE grade >= 0.97) < 2 AND max(retries) < 2 THEN 'retry' ELSE 'proceed' END AS action FROM g GROUP BY query_id")
def r23_grade_decision(spark, d):
    return R.grade_filter(_graded(spark, d), 0.97)[1]


@query(f"WITH {_GRADED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS rank FROM g WHERE grade >= 0.5")
def r23_grade_filter(spark, d):
    return R.grade_filter(_graded(spark, d))[0].select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id AS query_id, count(*) AS steps, CAST(sum(event_id % 4) AS BIGINT) AS kept, CAST(sum(event_id % 3) AS BIGINT) AS dropped, count(*) FILTER (WHERE event_type = 'error') AS retries, bool_or(event_type = 'purchase') AS verified FROM events GROUP BY user_id")
def r24_agent_trace_summary(spark, d):
    step = F.struct(
        F.col("event_type").alias("step"), (F.col("event_id") % 4).alias("kept"), (F.col("event_id") % 3).alias("dropped"),
        F.when(F.col("event_type") == "error", "retry").otherwise("proceed").alias("action"), F.lit(1).alias("n_queries"), (F.col("event_type") == "purchase").alias("verified"),
    )
    steps = V.table(spark, d, "events").select(F.col("user_id").alias("query_id"), step.alias("t"))
    return R.agent_steps_summary(steps).select("query_id", "steps", "kept", "dropped", "retries", "verified")


# evaluation


def _examples(spark, d):
    q = V.table(spark, d, "embeddings").filter("vec_id % 20 = 0")
    ids = F.array(F.concat(F.lit("TYPE"), F.col("label").cast("string"), F.lit("!")), F.lit("nowhere"))
    return q.select(
        F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 100 == 60, F.array().cast("array<string>")).otherwise(ids).alias("relevant_ids"),
        F.array(F.lit("label"), F.lit("missing")).alias("keywords"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("category"),
        F.when(F.col("vec_id") % 2 == 0, "easy").otherwise("medium").alias("difficulty"),
    )


def _retrieved(spark, d):
    own = R.dense_topk(vectors(spark, d), corpus(spark, d), k=5, min_score=0.3)
    named = corpus(spark, d).select("chunk_id", "source_type", F.concat_ws(" ", F.lit("label"), F.concat(F.col("source_type"), F.lit("!"))).alias("text"), F.lit("s").alias("source"))
    return own.join(named, "chunk_id")


_EVAL = f"""{_dense_sql(15, 5, 0.3)}, x AS (SELECT vec_id AS query_id, label AS own, vec_id % 100 = 60 AS none, 'c' || (label % 3) AS category, CASE WHEN vec_id % 2 = 0 THEN 'easy' ELSE 'medium' END AS difficulty FROM embeddings WHERE vec_id % 20 = 0),
e AS (SELECT x.query_id, any_value(category) AS category, any_value(difficulty) AS difficulty, count(rank) AS n, coalesce(1 / min(rank) FILTER (WHERE label = own AND NOT none), 0) AS mrr,
CASE WHEN any_value(none) THEN 1.0 ELSE CAST(coalesce(bool_or(label = own), false) AS INT) / 2 END AS recall, CASE WHEN count(rank) > 0 THEN count(rank) FILTER (WHERE label = own AND NOT none) / least(5, count(rank)) ELSE 0 END AS precision,
CASE WHEN count(rank) > 0 THEN 0.5 ELSE 0.0 END AS keyword_hit, coalesce(avg(score), 0) AS avg_similarity FROM x LEFT JOIN dense ON dense.query_id = x.query_id AND rank <= 5 GROUP BY x.query_id)"""


def _evaluated(spark, d):
    return E.evaluate_retrieval(_examples(spark, d), _retrieved(spark, d))


@query(f"WITH {_dense_sql(15, 5, 0.3)} SELECT query_id, rank, 'TYPE' || o.label || '!' AS relevant_id FROM dense JOIN embeddings o ON o.vec_id = query_id WHERE rank <= 5 AND dense.label = o.label AND query_id % 100 <> 60")
def e01_relevance_match(spark, d):
    return E.relevance_match(_examples(spark, d), _retrieved(spark, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "relevant_id")


def _measure(name):
    def run(spark, d):
        return _evaluated(spark, d).select("query_id", F.round(name, 6).alias(name))

    return run


for _no, _name in (("e02", "mrr"), ("e03", "recall"), ("e04", "precision"), ("e05", "keyword_hit"), ("e06", "avg_similarity")):
    _f = _measure(_name)
    _f.__name__ = f"{_no}_{_name}"
    query(f"WITH {_EVAL} SELECT query_id, round({_name}, 6) AS {_name} FROM e")(_f)


@query(f"WITH {_EVAL} SELECT query_id, n, round(mrr, 6) AS mrr, round(recall, 6) AS recall, round(precision, 6) AS precision, round(keyword_hit, 6) AS keyword_hit, round(avg_similarity, 6) AS avg_similarity FROM e")
def e07_evaluate_retrieval(spark, d):
    return _evaluated(spark, d).select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "precision", "keyword_hit", "avg_similarity")])


@query(
    f"WITH {_EVAL} SELECT CASE grouping(category, difficulty) WHEN 3 THEN 'all' WHEN 1 THEN 'category' ELSE 'difficulty' END AS level, category, difficulty, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(avg_similarity), 6) AS avg_similarity FROM e GROUP BY GROUPING SETS ((), (category), (difficulty))"
)
def e08_eval_suite(spark, d):
    rows = _evaluated(spark, d).withColumn("error", F.lit(None).cast("string")).withColumn("time_ms", F.lit(1.0))
    return E.eval_suite(rows).select("level", "category", "difficulty", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "avg_similarity")])


def _scored(spark, d):
    score = (F.col("value") % 130) / 100 - 0.2
    return V.table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("rank"), score.alias("score"), F.when(F.col("user_id") % 2 == 0, score * 4 - 1).alias("rerank_score"))


_SCORED = """sc AS (SELECT user_id AS query_id, event_id AS rank, (value % 130) / 100 - 0.2::DOUBLE AS score, CASE WHEN user_id % 2 = 0 THEN ((value % 130) / 100 - 0.2::DOUBLE) * 4 - 1 ELSE (value % 130) / 100 - 0.2::DOUBLE END AS best FROM events),
gr AS (SELECT *, CASE WHEN best < 0 THEN greatest(0, (best + 5) / 10) ELSE least(best, 1) END AS g, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, row_number() OVER (PARTITION BY query_id ORDER BY best DESC) AS j FROM sc),
nd AS (SELECT query_id, sum(g / log2(i + 1)) FILTER (WHERE i <= 5) / sum(g / log2(j + 1)) FILTER (WHERE j <= 5) AS ndcg, coalesce(1 / min(i) FILTER (WHERE best >= 0.5), 0) AS mrr, count(*) FILTER (WHERE best > 0 AND i <= 5) / 5 AS positive_share,
count(*) FILTER (WHERE best > 0.3 AND i <= 5) / 5 AS precision, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std, median(score) AS median, count(*) FILTER (WHERE score >= 0.8) AS excellent, count(*) FILTER (WHERE score < 0.4) AS poor FROM gr GROUP BY query_id)"""


@query(f"WITH {_SCORED} SELECT query_id, round(ndcg, 6) AS ndcg FROM nd")
def e09_ndcg(spark, d):
    return E.retrieval_metrics(_scored(spark, d)).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {_SCORED} SELECT query_id, round(mrr, 6) AS mrr, round(positive_share, 6) AS positive_share, round(precision, 6) AS precision FROM nd")
def e10_score_measures(spark, d):
    return E.retrieval_metrics(_scored(spark, d)).select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "positive_share", "precision")])


@query(f"WITH {_SCORED} SELECT query_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, excellent, poor FROM nd")
def e11_retrieval_metrics(spark, d):
    return E.retrieval_metrics(_scored(spark, d)).select("query_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")], "excellent", "poor")


def _metrics_log(spark, d):
    own = V.requests(spark, d)
    return own.select("id", "ts", "latency_ms", F.array("avg_similarity_score", F.col("avg_similarity_score") / 2).alias("scores"), F.col("avg_similarity_score").alias("ndcg"), F.lit(0.5).alias("mrr"))


@query(
    """WITH n AS (SELECT *, CAST(avg_similarity_score AS DOUBLE) AS s FROM requests ORDER BY ts DESC, id LIMIT 100), p AS (SELECT s AS x FROM n UNION ALL SELECT s / 2 FROM n)
SELECT count(*) AS queries, round(avg(latency_ms), 6) AS latency_mean, round(median(latency_ms), 6) AS latency_median, list_sort(list(latency_ms))[96] AS latency_p95, round(avg(s), 6) AS ndcg_mean, (SELECT round(avg(x), 6) FROM p) AS score_mean, (SELECT round(median(x), 6) FROM p) AS score_median FROM n""",
    "requests",
)
def e12_metrics_summary(spark, d):
    out = E.metrics_summary(_metrics_log(spark, d))
    return out.select("queries", "latency_p95", *[F.round(c, 6).alias(c) for c in ("latency_mean", "latency_median", "ndcg_mean", "score_mean", "score_median")])


_TOK = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: length(w) > 2))"
_JAC = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def _answers(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("question"), "answer", F.concat_ws(" ", "text", "answer").alias("context"), F.when(F.col("turn") > 0, F.col("text")).alias("ground_truth"))


@query(
    f"""WITH a AS (SELECT x.conv_id, x.turn, {_TOK.format('x.text')} AS q, {_TOK.format('y.text')} AS a, {_TOK.format("x.text || ' ' || y.text")} AS c FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)
SELECT conv_id, turn, round({_JAC.format(a='a', b='c')}, 4) AS faithfulness, round({_JAC.format(a='a', b='q')}, 4) AS answer_relevancy, round({_JAC.format(a='c', b='q')}, 4) AS context_precision, CASE WHEN turn > 0 THEN round({_JAC.format(a='q', b='c')}, 4) END AS context_recall FROM a"""
)
def e13_heuristic_answer_scores(spark, d):
    return E.heuristic_answer_scores(_answers(spark, d)).select("conv_id", "turn", "faithfulness", "answer_relevancy", "context_precision", "context_recall")


@query(f"WITH {_dense_sql(15, 5, 0.3)} SELECT round(avg(CAST(dense.label = o.label OR dense.label = 1 AS INT)), 6) AS match_rate, count(DISTINCT query_id) AS with_results FROM dense JOIN embeddings o ON o.vec_id = query_id WHERE rank <= 5")
def e14_source_match_rate(spark, d):
    want = V.table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.array(F.concat(F.lit("type"), F.col("label").cast("string")), F.lit("type1")).alias("expected_sources"))
    return E.source_match_rate(want, _retrieved(spark, d)).select(F.round("match_rate", 6).alias("match_rate"), "with_results")


@query(
    """SELECT CASE grouping(session_id, query) WHEN 3 THEN 'all' WHEN 1 THEN 'category' ELSE 'complexity' END AS level, model AS config, session_id AS category, query AS complexity, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 4) AS p50,
round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(avg(latency_ms), 4) AS mean, round(stddev_pop(latency_ms), 4) AS std FROM (SELECT model, CAST(id % 4 AS VARCHAR) AS session_id, CAST(id % 3 AS VARCHAR) AS query, latency_ms FROM requests) GROUP BY GROUPING SETS ((model), (model, session_id), (model, query))""",
    "requests",
)
def e15_benchmark_summary(spark, d):
    own = V.requests(spark, d).select(F.col("model").alias("config"), (F.col("id") % 4).cast("string").alias("category"), (F.col("id") % 3).cast("string").alias("complexity"), "latency_ms", F.col("avg_similarity_score").alias("score"))
    return E.benchmark_summary(own).select("level", "config", "category", "complexity", "n", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "mean", "std")])


@query(
    """WITH b AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0.3::DOUBLE), (0.3, 0.5), (0.5, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0)) t(low, high)), s AS (SELECT k / 100.0::DOUBLE AS s FROM (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))
SELECT low, high, count(s.s) AS n, round(count(s.s) / (SELECT count(*) FROM s) * 100, 2) AS percent FROM b LEFT JOIN s ON s.s >= low AND s.s < high GROUP BY low, high"""
)
def e16_score_distribution(spark, d):
    return E.score_distribution(V.requests(spark, d).withColumnRenamed("avg_similarity_score", "score"))


# answer validation

_ANSWERS = (
    "I think this might work. You must restart it.", "According to the documentation you should scale [Source 2].", "As of my knowledge the version 1.2.3.4 was released on march 3, 2021.", "By default, the pods are restarted; see https://a.b/c and call 555-123-4567.",
    "I'm not sure. I'm not sure.", "[Source 9] says the best way is to always use roughly 50% of the memory.", "",
)
_ANSWER_LIST = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in _ANSWERS) + "]"
_RESP = f"""resp AS (SELECT a.doc_id, CASE WHEN a.doc_id % 7 = 6 AND a.doc_id % 2 = 0 THEN '' ELSE {_ANSWER_LIST}[a.doc_id % 7 + 1] || ' ' || a.text END AS response, coalesce(b.text, '') AS context
FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)"""


def _responses(spark, d):
    """Whole texts as responses, each with the whole text of the document of the next id as its context."""
    pick = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("doc_id") % 7 + 1).cast("int"))
    text = F.when((F.col("doc_id") % 7 == 6) & (F.col("doc_id") % 2 == 0), "").otherwise(F.concat(pick, F.lit(" "), "text"))
    own = V.table(spark, d, "documents")
    after = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("context"))
    return own.select("doc_id", text.alias("response")).join(after, "doc_id", "left").select("doc_id", "response", F.coalesce("context", F.lit("")).alias("context"), F.lit(3).alias("n_sources"))


@query(f"WITH {_RESP} SELECT doc_id, length(coalesce(response, '')) < {O.SHORT} AS is_short, length(coalesce(response, '')) > {O.LONG} AS is_long FROM resp")
def e18_length_issues(spark, d, held=_responses):
    codes = O.length_issues(F.coalesce("response", F.lit("")))["code"]  # a null response is empty, as in validate_answers
    return held(spark, d).select("doc_id", F.array_contains(codes, "RESPONSE_TOO_SHORT").alias("is_short"), F.array_contains(codes, "RESPONSE_TOO_LONG").alias("is_long"))


def _all_matches(patterns):
    return "flatten([" + ", ".join("regexp_extract_all(lower(response), '" + p.replace("'", "''") + "')" for p in patterns) + "])"


@query(f"WITH {_RESP} SELECT doc_id, len(list_distinct({_all_matches(O.UNCERTAIN)})) AS markers FROM resp")
def e19_markers(spark, d, held=_responses):
    return held(spark, d).select("doc_id", F.size(O.markers(F.lower("response"))).cast("long").alias("markers"))


@query(f"WITH {_RESP} SELECT doc_id, len({_all_matches(O.FABRICATED)}) AS fabricated FROM resp")
def e20_fabrication_issues(spark, d, held=_responses):
    return held(spark, d).select("doc_id", F.size(O.fabrication_issues(F.col("response"))).cast("long").alias("fabricated"))


@query(f"WITH {_RESP} SELECT doc_id, len({_all_matches(O.CITATIONS)}) AS citations FROM resp")
def e21_citation_count(spark, d, held=_responses):
    return held(spark, d).select("doc_id", O.citation_count(F.col("response")).cast("long").alias("citations"))


def _claims_sql():
    """Claims of lower-cased responses: a match starts after the pieces and matches before it."""
    cited = "|".join(O.CITATIONS).replace("'", "''")
    parts = []
    for p in O.CLAIMS:
        q = p.replace("'", "''")
        hits, pieces = f"regexp_extract_all(low, '{q}')", f"regexp_split_to_array(low, '{q}')"
        at = "1 + list_sum(list_transform(x.p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(x.h[1:i - 1], lambda z: length(z))), 0)"
        parts.append(
            f"(SELECT len(list_filter(range(1, len(x.h) + 1), lambda i: NOT regexp_matches(substr(low, CAST({at} AS BIGINT), 200), '{cited}'))) FROM (SELECT {hits} AS h, {pieces} AS p) x)"
        )
    return " + ".join(parts)


_CLAIMED = f"{_RESP}, claimed AS (SELECT *, {_claims_sql()} AS claims FROM (SELECT *, lower(response) AS low FROM resp))"


@query(f"WITH {_CLAIMED} SELECT doc_id, claims FROM claimed")
def e22_claims(spark, d):
    return _responses(spark, d).select("doc_id", F.size(O.claims(F.col("response"))).alias("claims"))


_KEY = "list_filter(list_distinct(list_transform(list_filter(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}')), lambda w: lower(w))), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in O.COMMON_WORDS) + "], w))"


@query(f"WITH {_RESP}, k AS (SELECT doc_id, {_KEY.format('response')} AS a, {_KEY.format('context')} AS b FROM resp) SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE -1 END AS grounding FROM k")
def e23_grounding(spark, d, held=_responses):
    return held(spark, d).select("doc_id", F.coalesce(F.round(O.grounding(F.col("response"), F.col("context")), 6), F.lit(-1.0)).alias("grounding"))


_VALIDATED = f"""{_CLAIMED},
found AS (SELECT doc_id, regexp_full_match(response, '\\s*') AS blank, length(response) AS size, context <> '' AS given, CASE WHEN context <> '' THEN claims ELSE 0 END AS cl,
len(list_distinct({_all_matches(O.UNCERTAIN)})) AS m, len({_all_matches(O.FABRICATED)}) AS f, len({_all_matches(O.CITATIONS)}) AS c,
len(list_filter(list_transform(regexp_extract_all(low, '\\[source\\s*(\\d+)\\]', 1), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NULL OR x < 1 OR x > 3)) AS wrong,
{_KEY.format('response')} AS a, {_KEY.format('context')} AS b FROM claimed),
counts AS (SELECT *, CAST(size < {O.SHORT} AS INT) + CAST(size > {O.LONG} AS INT) + m + CAST(len(a) > 20 AND len(b) > 0 AND len(list_intersect(a, b)) / len(a) < 0.1 AS INT) AS warnings,
f + CAST(given AND c = 0 AND size > 200 AS INT) + cl AS infos FROM found),
validated AS (SELECT doc_id, CASE WHEN blank THEN 1 ELSE warnings + infos + wrong END AS issues, m AS n_markers, c AS n_citations, cl AS n_claims, NOT blank AND wrong = 0 AS is_valid,
CASE WHEN blank THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, 1::DOUBLE - wrong * 0.25::DOUBLE - warnings * 0.1::DOUBLE - infos * 0.02::DOUBLE + CASE WHEN c > 0 THEN least(0.1::DOUBLE, c * 0.02::DOUBLE) ELSE 0 END
- m * 0.15::DOUBLE - least(cl, 5) * 0.05::DOUBLE)) END AS confidence FROM counts)"""


@query(f"WITH {_VALIDATED} SELECT doc_id, issues, n_markers, n_citations, n_claims, round(confidence, 6) AS confidence, is_valid FROM validated")
def e17_validate_answers(spark, d):
    return O.validate_answers(_responses(spark, d)).select("doc_id", F.size("issues").alias("issues"), "n_markers", "n_citations", "n_claims", F.round("confidence", 6).alias("confidence"), "is_valid")


@query(f"WITH {_VALIDATED} SELECT round(confidence, 2) AS confidence, count(*) AS n, count(*) FILTER (WHERE is_valid) AS valid FROM validated GROUP BY 1")
def e24_confidence(spark, d):
    out = O.validate_answers(_responses(spark, d))
    return out.groupBy(F.round("confidence", 2).alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("valid"))

