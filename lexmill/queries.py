"""The library's own queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sql as S
from .functions import text as X
from .operators import analytics, bm25, chunking, evaluation, hybrid, integrity, memory, router, sampling, tree, vector
from .operators.spread import spread
from .plans import retrieval
from .streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = 1_706_659_200.0  # 2024-01-31, after the last event


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as questions, each with the vector of its number."""
    vectors = _table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(vectors, "query_id")


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents, the questions, and the vectors of the documents whose number has one."""
    return _table(spark, d, "documents"), _asked(spark, d), _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


# words

_BM25 = f"""
w AS (SELECT doc_id, {S.words("coalesce(text, '')")} AS w FROM {{docs}}),
posted AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY doc_id, term),
n AS (SELECT count(*) AS n, sum(len(w)) * 1.0::DOUBLE / count(*) AS avgdl FROM w),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posted, n GROUP BY term),
low AS (SELECT 0.25 * avg(raw) AS low FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN low ELSE raw END AS idf FROM raw, low)"""


def _bm25(docs: str) -> str:
    return _BM25.replace("{docs}", docs)


_BM25_HITS = f"""
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.words("query")}) AS term FROM questions) GROUP BY query_id, term),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (term) JOIN posted USING (term), n GROUP BY query_id, doc_id),
word_hits AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0) WHERE place <= 10)"""


@query(f"WITH questions AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_bm25('documents')}, {_BM25_HITS} SELECT * FROM word_hits")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.search(_table(spark, d, "documents"), asked).select("query_id", "doc_id", "score", "place")


@query(f"WITH {_bm25('documents')} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf_table(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return bm25.term_statistics(spread(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


# vectors

_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _cos(a: str, b: str) -> str:
    return f"round({_DOT.format(a=a, b=b)} / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)})), 9)"


def _knn(collection: str, queries: str, k: int, least: float, where: str = "true") -> str:
    return f"""SELECT query_id, id, score, place FROM (SELECT query_id, id, round_even((1 + cos) / 2, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS place
      FROM (SELECT query_id, id, {_cos("query_vector", "v")} AS cos FROM {queries}, {collection} WHERE {where})) WHERE place <= {k} AND score >= {least}"""


_ASKED = "(SELECT item_id AS query_id, text AS query, embedding AS query_vector FROM benchmark JOIN embeddings ON item_id = vec_id)"


@query(f"SELECT query_id, id AS vec_id, score, place FROM ({_knn('(SELECT vec_id AS id, embedding AS v FROM embeddings)', _ASKED, 10, 0.25)})")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.search(_table(spark, d, "embeddings"), _asked(spark, d))


@query(f"SELECT query_id, id AS vec_id, score, place FROM ({_knn('(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE label = 3)', _ASKED, 10, 0.25)})")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vector.search(_table(spark, d, "embeddings").where("label = 3"), _asked(spark, d))


_PAIRS = f"SELECT x.vec_id AS a, y.vec_id AS b, {_cos('x.embedding', 'y.embedding')} AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id"


@query(f"SELECT a, b, round(cosine, 6) AS cosine FROM ({_PAIRS}) WHERE cosine >= 0.4")
def near_duplicate_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector.similar_pairs(_table(spark, d, "embeddings"), 0.4).withColumn("cosine", F.round("cosine", 6))


# hybrid

def _hybrid(where: str = "true") -> str:
    near = _knn("(SELECT doc_id AS id, lang, embedding AS v FROM chunks WHERE embedding IS NOT NULL)", "questions", 10, 0.25, where)
    return f"""WITH questions AS {_ASKED}, chunks AS (SELECT d.*, embedding FROM documents d LEFT JOIN embeddings ON doc_id = vec_id), {_bm25("chunks")}, {_BM25_HITS},
vector_hits AS (SELECT query_id, id AS doc_id, score, place FROM ({near})),
both_ AS (SELECT query_id, doc_id, 0 AS list, 'vector' AS kind, place, 0.7::DOUBLE / (60 + place) AS part FROM vector_hits UNION ALL SELECT query_id, doc_id, 1, 'bm25', place, 0.3::DOUBLE / (60 + place) FROM word_hits),
merged AS (SELECT query_id, left(coalesce(text, ''), 100) AS k, round(sum(part), 9) AS rrf_score, array_to_string(list_sort(list_distinct(list(kind))), '+') AS search_type, min(list * 1000 + place) AS first, arg_min(doc_id, list * 1000 + place) AS doc_id FROM both_ JOIN chunks USING (doc_id) GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT query_id, doc_id, rrf_score, search_type, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first) AS place FROM merged) WHERE place <= 10)"""


@query(_hybrid() + " SELECT * FROM fused")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    docs, asked, vectors = _searched(spark, d)
    return retrieval.hybrid_search(docs, asked, vectors=vectors)


@query(_hybrid("lang = 'en'") + " SELECT * FROM fused")
def hybrid_language_vector_only(spark: SparkSession, d: str) -> DataFrame:
    docs, asked, vectors = _searched(spark, d)
    return retrieval.hybrid_search(docs, asked, language="en", vectors=vectors)


_RERANKED = f"""{_hybrid()}, judged AS (SELECT f.query_id, f.doc_id, f.place AS was, CASE WHEN count(*) OVER (PARTITION BY f.query_id) > 5 THEN round(len(list_intersect(list_distinct({S.words("q.query")}), {S.words("c.text")})) * 1.0::DOUBLE / greatest(len(list_distinct({S.words("q.query")})), 1), 6) END AS rerank_score FROM fused f JOIN questions q USING (query_id) JOIN chunks c USING (doc_id)),
kept AS (SELECT * FROM (SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, was, doc_id) AS place FROM judged) WHERE place <= 5)"""


@query(_RERANKED + " SELECT * FROM kept")
def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    docs, asked, vectors = _searched(spark, d)
    return retrieval.retrieve(docs, asked, vectors=vectors).select("query_id", "doc_id", "rerank_score", "place")


@query(_RERANKED + " SELECT query_id, string_agg('[' || place || '] ' || source || chr(10) || CASE WHEN length(text) > 1200 THEN left(text, 1200) || chr(10) || '[...truncated]' ELSE text END, chr(10) || chr(10) ORDER BY place) AS context FROM kept JOIN chunks USING (doc_id) GROUP BY query_id")
def prompt_contexts(spark: SparkSession, d: str) -> DataFrame:
    docs, asked, vectors = _searched(spark, d)
    return retrieval.contexts(docs, asked, vectors=vectors)


@query("SELECT source AS file, doc_id || '-' || doc_id + 1 AS lines, lang AS language, round_even(n_chars::DOUBLE / 7, 4) AS score, 'vector' AS search_type, left(text, 200) AS preview FROM documents")
def source_cards(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("document_path"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + 1).alias("end_line"), F.col("lang").alias("language"),
        (F.col("n_chars").cast("double") / 7).alias("score"), F.lit(None).cast("double").alias("rerank_score"), F.lit("vector").alias("search_type"), F.col("text").alias("content"))
    return hybrid.source_cards(docs)


@query("SELECT query_id, source AS document_path, min(place) AS place FROM (SELECT item_id AS query_id, 'see src1, src12 and src3.' AS answer FROM benchmark) a, (SELECT source, doc_id AS place FROM documents) h WHERE contains(answer, source) GROUP BY query_id, source")
def citations(spark: SparkSession, d: str) -> DataFrame:
    answers = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("see src1, src12 and src3.").alias("answer"))
    sources = _table(spark, d, "documents").groupBy(F.col("source").alias("document_path")).agg(F.min("doc_id").alias("place"))
    return hybrid.citations(answers, answers.select("query_id").crossJoin(sources))


# routing and analytics

@query(f"SELECT conv_id, turn, {router.sql('text')} AS category FROM conversations WHERE role = 'user'")
def route_batch(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", router.route(F.col("text")).getField("category").alias("category"))


@query("SELECT source AS document_path, arg_min(coalesce(lang, ''), doc_id) AS language, count(*) AS chunk_count FROM documents WHERE source <> '' GROUP BY source")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return analytics.file_inventory(_table(spark, d, "documents"))


_LOG = "log AS (SELECT event_id AS query_id, user_id, event_type AS category, CASE WHEN event_id % 2 = 0 THEN 'hybrid' ELSE 'vector' END AS search_type, value AS latency_ms, event_id % 100 AS input_tokens, event_id % 37 AS output_tokens, floor(epoch(ts))::DOUBLE AS created_at FROM events)"
_WEEK = f"{_LOG}, week AS (SELECT * FROM log WHERE created_at > {NOW} - 7 * 86400)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return analytics.query_log_of_events(_table(spark, d, "events"))


@query(f"WITH {_WEEK} SELECT count(*) AS total_queries, round_even(avg(latency_ms), 1) AS avg_latency_ms, sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM week")
def query_log_summary(spark: SparkSession, d: str) -> DataFrame:
    return analytics.summary(analytics.since(_log(spark, d), NOW, 7))


@query(f"WITH {_WEEK} SELECT coalesce(category, 'unknown') AS category, count(*) AS count FROM week GROUP BY 1")
def query_log_by_category(spark: SparkSession, d: str) -> DataFrame:
    return analytics.by(analytics.since(_log(spark, d), NOW, 7), "category")


@query(f"WITH {_WEEK} SELECT coalesce(search_type, 'unknown') AS search_type, count(*) AS count FROM week GROUP BY 1")
def query_log_by_search_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.by(analytics.since(_log(spark, d), NOW, 7), "search_type")


@query(f"WITH {_LOG} SELECT strftime(make_timestamp((created_at * 1000000)::BIGINT), '%Y-%m-%d') AS day, count(*) AS count, round_even(avg(latency_ms), 4) AS avg_latency_ms FROM log GROUP BY 1")
def query_log_daily(spark: SparkSession, d: str) -> DataFrame:
    return analytics.daily(_log(spark, d))


@query(f"WITH {_LOG} SELECT query_id, user_id, category, created_at FROM log ORDER BY created_at DESC, query_id DESC LIMIT 20")
def query_log_recent(spark: SparkSession, d: str) -> DataFrame:
    return analytics.recent(_log(spark, d)).select("query_id", "user_id", "category", "created_at")


@query("SELECT conv_id, CASE WHEN length(arg_min(text, turn)) > 50 THEN left(arg_min(text, turn), 50) || '...' ELSE arg_min(text, turn) END AS title, count(*) AS messages, max(turn) AS updated_at FROM conversations GROUP BY conv_id")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    return analytics.sessions(_table(spark, d, "conversations"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("source").where("source is not null").distinct()


_HOST_PATH = "regexp_replace(url, '^https?://[^/]+/|[?#].*$', '', 'g')"


@query(f"SELECT folder, count(*) AS count FROM (SELECT CASE WHEN regexp_extract({_HOST_PATH}, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract({_HOST_PATH}, '^(.*)/[^/]*$', 1) END AS folder FROM pages) GROUP BY folder")
def files_by_folder(spark: SparkSession, d: str) -> DataFrame:
    paths = _table(spark, d, "pages").select(F.regexp_replace("url", r"^https?://[^/]+/|[?#].*$", "").alias("path"))
    return analytics.by_parent_dir(paths)


@query(f"SELECT lower(regexp_extract(regexp_extract({_HOST_PATH}, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) AS extension, count(*) AS count FROM pages GROUP BY 1 ORDER BY count DESC, extension LIMIT 8")
def extension_histogram(spark: SparkSession, d: str) -> DataFrame:
    paths = _table(spark, d, "pages").select(F.regexp_replace("url", r"^https?://[^/]+/|[?#].*$", "").alias("path"))
    return analytics.extension_histogram(paths)


@query("SELECT label, count(*) AS count FROM embeddings GROUP BY label")
def memory_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("count"))


# audits

_PAIR = "SELECT doc_id, unnest(regexp_extract_all(text, '{r}', 1)) AS k, unnest(regexp_extract_all(text, '{r}', 2)) AS v FROM documents"
_CLAIMS = f"""claims AS (SELECT DISTINCT * FROM (SELECT doc_id, {S.norm_key('k')} AS claim_key, {S.norm_value('trim(v)')} AS claim_value FROM ({_PAIR.replace('{r}', X.KEYVAL)})
UNION ALL SELECT doc_id, {S.norm_key('k')}, replace(lower(v), ' ', '_') FROM ({_PAIR.replace('{r}', X.BOOL)})) WHERE claim_key <> '')"""
_SEVERE = "(regexp_matches(claim_value, '(ms|sec|seconds|min|mins|hours|days|s|%)$') OR (regexp_matches(claim_value, '^[0-9]*\\.?[0-9]*$') AND regexp_matches(claim_value, '[0-9]')) OR claim_value IN ('must', 'must_not', 'should', 'should_not'))"
_CONTRADICTIONS = f"""{_CLAIMS}, per_value AS (SELECT claim_key, claim_value, min(doc_id) AS first_at FROM claims GROUP BY 1, 2),
contradictions AS (SELECT claim_key, count(*) AS distinct_values, array_to_string(list(claim_value ORDER BY first_at, claim_value)[1:4], ', ') AS first_values, CASE WHEN bool_or({_SEVERE}) THEN 'high' ELSE 'medium' END AS severity, min(first_at) AS first_doc FROM per_value GROUP BY claim_key HAVING count(*) >= 2)"""


@query(f"WITH {_CLAIMS} SELECT * FROM claims")
def claims(spark: SparkSession, d: str) -> DataFrame:
    return integrity.claims(_table(spark, d, "documents"))


@query(f"WITH {_CONTRADICTIONS} SELECT * FROM contradictions")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return integrity.contradictions(integrity.claims(_table(spark, d, "documents"), distinct=False))


def _any(text: str, needles: str) -> str:
    return "coalesce(bool_or(" + " OR ".join(f"contains(lower({text}), '{n}')" for n in needles.split("|")) + "), false)"


_SPOTS = " UNION ALL ".join(f"SELECT '{t}' AS topic, '{s}' AS severity, {_any('text', n)} AS covered FROM documents" for t, s, n in integrity.TOPICS)
_GAPS = " UNION ALL ".join(f"SELECT '{t}' AS dependency, '{s}' AS severity, {_any('text', n)} AS mentioned, {_any('text', integrity.MITIGATIONS)} AS mitigated FROM documents" for t, s, n in integrity.DEPENDENCIES)


@query(_SPOTS)
def blind_spots(spark: SparkSession, d: str) -> DataFrame:
    return integrity.blind_spots(_table(spark, d, "documents"))


@query(f"SELECT *, mentioned AND NOT mitigated AS gap FROM ({_GAPS})")
def resilience_gaps(spark: SparkSession, d: str) -> DataFrame:
    return integrity.resilience_gaps(_table(spark, d, "documents"))


def _stratified(most: int) -> str:
    return f"""WITH f AS (SELECT doc_id, coalesce(nullif(source, ''), 'unknown') AS file, row_number() OVER (PARTITION BY coalesce(nullif(source, ''), 'unknown') ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY coalesce(nullif(source, ''), 'unknown')) AS size FROM documents),
t AS (SELECT count(*) AS total, count(DISTINCT file) AS files FROM f), p AS (SELECT f.*, total, greatest(1, {most} // files) AS per, greatest(1, size // greatest(1, {most} // files)) AS step FROM f, t)
SELECT doc_id, file AS source FROM p WHERE total <= {most} OR (n % step = 0 AND n // step < per) ORDER BY file, n LIMIT {most}"""


@query(_stratified(300))
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(_table(spark, d, "documents"), 300).select("doc_id", "source")


@query(_stratified(30))
def compliance_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(_table(spark, d, "documents"), 30, empty_is_unknown=False).select("doc_id", "source")


_PRINT = "SELECT file, sha256(file || '|' || count(*) || '|' || string_agg(left(coalesce(t, ''), 400), chr(10) ORDER BY doc_id) FILTER (n <= 10)) AS fingerprint FROM (SELECT doc_id, coalesce(nullif(source, ''), 'unknown') AS file, {t} AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY file"


@query(_PRINT.format(t="text"))
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return integrity.fingerprints(_table(spark, d, "documents"))


_BEFORE = "CASE WHEN source IN ('src3', 'src7') THEN 'Before: ' || text ELSE text END"


def _previous(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of the documents as they might have been before two files changed."""
    return integrity.fingerprints(_table(spark, d, "documents").withColumn("text", F.when(F.col("source").isin("src3", "src7"), F.concat(F.lit("Before: "), "text")).otherwise(F.col("text"))))


@query(f"SELECT c.file, c.fingerprint, p.fingerprint AS previous FROM ({_PRINT.format(t='text')}) c JOIN ({_PRINT.format(t=_BEFORE)}) p USING (file) WHERE p.fingerprint <> c.fingerprint")
def drift(spark: SparkSession, d: str) -> DataFrame:
    return integrity.drift(integrity.fingerprints(_table(spark, d, "documents")), _previous(spark, d))


_ISSUES = f"""WITH {_CONTRADICTIONS}, issues AS (SELECT 'contradiction' AS type, severity, 'Conflicting statements: ' || claim_key AS title, 'Settle this topic in one place and point the others to it.' AS recommendation FROM (SELECT * FROM contradictions ORDER BY first_doc, claim_key LIMIT 50)
UNION ALL SELECT 'blind_spot', severity, 'Not documented: ' || topic, 'Write down who does what about ' || topic FROM ({_SPOTS}) WHERE NOT covered
UNION ALL SELECT 'resilience_gap', severity, 'No mitigation: ' || dependency, 'Describe what happens when this fails: ' || dependency FROM ({_GAPS}) WHERE mentioned AND NOT mitigated
UNION ALL SELECT 'drift', 'medium', 'Changed: ' || file, 'Check what refers to the changed documents.' FROM (SELECT c.file FROM ({_PRINT.format(t='text')}) c JOIN ({_PRINT.format(t=_BEFORE)}) p USING (file) WHERE p.fingerprint <> c.fingerprint ORDER BY file LIMIT 50)),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END, type, title) AS ord FROM issues)"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return integrity.issues(_table(spark, d, "documents"), _previous(spark, d))


@query(_ISSUES + " SELECT * FROM ranked WHERE ord <= 50")
def integrity_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d).where("ord <= 50")


@query(f"""{_ISSUES}, s AS (SELECT coalesce(sum(CASE severity WHEN 'critical' THEN 18 WHEN 'high' THEN 12 WHEN 'low' THEN 3 ELSE 7 END), 0)::BIGINT AS penalty, {', '.join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in integrity.ISSUE_TYPES)} FROM ranked)
SELECT *, greatest(0, least(100, 100 - penalty))::BIGINT AS score, CASE WHEN 100 - penalty >= 90 THEN 'excellent' WHEN 100 - penalty >= 75 THEN 'good' WHEN 100 - penalty >= 55 THEN 'fair' ELSE 'poor' END AS band FROM s""")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return integrity.health(_issues(spark, d))


@query(f"{_ISSUES} SELECT row_number() OVER (ORDER BY ord) AS place, recommendation FROM (SELECT recommendation, min(ord) AS ord FROM ranked GROUP BY 1 ORDER BY 2 LIMIT 6)")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return integrity.recommendations(_issues(spark, d))


# memory

_USERS = "SELECT vec_id, label, embedding FROM embeddings"


@query(f"SELECT query_id, id AS vec_id, score, place FROM ({_knn('(SELECT vec_id AS id, embedding AS v FROM embeddings)', _ASKED, 5, 0.2)}) JOIN embeddings ON id = vec_id WHERE label / 10.0 >= 0.3")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    memories = _table(spark, d, "embeddings").withColumn("importance", F.col("label") / 10)
    return memory.search(memories, _asked(spark, d), least_importance=0.3)


_TURNS = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number FROM conversations WHERE role = 'user'"


@query(f"SELECT * FROM ({_TURNS}) WHERE turn_number % 3 = 0")
def turn_interval(spark: SparkSession, d: str) -> DataFrame:
    turns = _table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn")
    return memory.every_nth_turn(turns, "conv_id", ["turn"])


_QA = "SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'"


@query(f"SELECT conv_id, turn FROM ({_QA}) WHERE length(trim(lower(question))) >= 8 AND trim(lower(question)) NOT IN ({', '.join(repr(g) for g in memory.GREETINGS)}) AND length(answer) >= 100 AND NOT ({' OR '.join(f'contains(lower(question), {n!r})' for n in memory.META.split('|'))})")
def turns_worth_extracting(spark: SparkSession, d: str) -> DataFrame:
    return memory.turn_pairs(_table(spark, d, "conversations")).where(memory.worth_extracting(F.col("question"), F.col("answer"))).select("conv_id", "turn")


@query(f"SELECT conv_id, turn, CASE WHEN length(question) > 400 THEN left(question, 200) || chr(10) || '...' || chr(10) || right(question, 200) ELSE question END AS question, CASE WHEN length(answer) > 800 THEN left(answer, 400) || chr(10) || '...' || chr(10) || right(answer, 400) ELSE answer END AS answer FROM ({_QA})")
def extraction_inputs(spark: SparkSession, d: str) -> DataFrame:
    pairs = memory.turn_pairs(_table(spark, d, "conversations"))
    return pairs.select("conv_id", "turn", X.head_and_tail(F.col("question"), 400).alias("question"), X.head_and_tail(F.col("answer"), 800).alias("answer"))


@query("SELECT conv_id, turn, role, CASE WHEN length(text) > 600 THEN left(text, 600) || '...' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def history_tail(spark: SparkSession, d: str) -> DataFrame:
    return memory.history_tail(_table(spark, d, "conversations"), 4)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
words AS (SELECT conv_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 4 AND regexp_matches(w, '^\\p{L}+$'))) AS w FROM r WHERE n > 4 AND role = 'user'),
old AS (SELECT DISTINCT conv_id FROM r WHERE n > 4), topics AS (SELECT old.conv_id, coalesce(array_to_string(list_sort(list(DISTINCT w) FILTER (w IS NOT NULL))[1:15], ', '), '') AS t FROM old LEFT JOIN words USING (conv_id) GROUP BY old.conv_id)
SELECT conv_id, 6 - n AS ord, role, left(text, 600) AS content FROM r WHERE n <= 4
UNION ALL SELECT conv_id, 0, 'user', '[Discussed before: ' || t || ']' FROM topics UNION ALL SELECT conv_id, 1, 'assistant', 'Noted; I know what came before.' FROM topics""")
def compact_history(spark: SparkSession, d: str) -> DataFrame:
    return memory.compact_history(_table(spark, d, "conversations"), turns=2)


@query()
def near_duplicate_inserts(spark: SparkSession, d: str) -> DataFrame:
    return memory.insert_new(_table(spark, d, "embeddings"), "label", "vec_id")


@query()
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    return memory.leader_clusters(_table(spark, d, "embeddings"), "label", "vec_id", 0.35)


# evaluation

_EVAL = f"""WITH questions AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_bm25('documents')}, {_BM25_HITS},
results AS (SELECT q.query_id, min(place) IS NOT NULL AS retrieval_hit, coalesce(1.0::DOUBLE / min(place), 0) AS mrr FROM questions q LEFT JOIN (SELECT h.query_id, place FROM word_hits h JOIN documents USING (doc_id) WHERE source IN ('src' || h.query_id % 20, 'src' || (h.query_id + 7) % 20)) h USING (query_id) GROUP BY q.query_id)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(spark, d).join(_table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    expected = F.array(F.concat(F.lit("src"), F.col("item_id") % 20), F.concat(F.lit("src"), (F.col("item_id") + 7) % 20))
    return evaluation.evaluate(_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), expected.alias("expected")), hits)


@query(_EVAL + " SELECT * FROM results")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)


@query(_EVAL + " SELECT count(*) AS total_cases, avg(retrieval_hit::INT) AS hit_rate, round(avg(mrr), 9) AS avg_mrr, -1.0::DOUBLE AS avg_faithfulness, -1.0::DOUBLE AS avg_relevance FROM results")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summarise(_evaluated(spark, d)).withColumn("avg_mrr", F.round("avg_mrr", 9))


# texts and chunks

@query(f"SELECT doc_id, substring(sha256(source || ':' || doc_id || ':' || n_chars), 1, 16) AS chunk_id, sha256(text) AS text_hash, {S.snippet('text')} AS snippet, {S.norm_key('text')} AS norm_key, ceil(length(text) / 4.0)::INT AS tokens, len({S.words('text')}) AS words FROM documents")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", X.chunk_id(F.col("source"), F.col("doc_id"), F.col("n_chars")).alias("chunk_id"), X.text_hash(t).alias("text_hash"), X.snippet(t).alias("snippet"), X.norm_key(t).alias("norm_key"), X.approximate_tokens(t).alias("tokens"), F.size(X.tokens(t)).alias("words"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query(f"SELECT doc_id, list_filter(({_LINES})[1:5], lambda s: length(s) >= 5 AND length(s) <= 80 AND length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) * 1.0::DOUBLE / greatest(length(s), 1) > 0.5)[1] AS title FROM documents")
def section_titles(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", X.first_title(F.col("text")).alias("title"))


@query(f"""SELECT doc_id, CASE WHEN length(s) > 200 THEN left(s, 197) || '...' ELSE s END AS summary FROM (SELECT doc_id,
array_to_string(list_filter(list_transform(string_split(regexp_replace({S.squeeze('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) > 20)[1:2], ' ') AS s FROM documents)""")
def local_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", X.local_summary(F.col("text")).alias("summary"))


@query()
def prose_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("text").alias("content"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("filepath"), F.col("lang").alias("language"))
    return chunking.chunk(docs)


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT *, i = 0 OR starts_with(trim(line), '#') OR (trim(lag(line) OVER (PARTITION BY doc_id ORDER BY i)) <> '' AND regexp_matches(trim(line), '^[=-]{3,}$')) AS s FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (s) AS sections FROM f GROUP BY doc_id""")
def prose_sections(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    trimmed = lines.select("doc_id", F.transform("l", lambda x: F.trim(x)).alias("l"))
    starts = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (i == 0) | F.startswith(F.get("l", i), F.lit("#")) | ((F.coalesce(F.get("l", i - 1), F.lit("")) != "") & F.get("l", i).rlike("^[=-]{3,}$")))
    return trimmed.select("doc_id", F.size("l").cast("long").alias("lines"), F.size(starts).cast("long").alias("sections"))


# trees

_PAGES = "p AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS page, text FROM documents WHERE source IS NOT NULL)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Each source as a paged document, a page per row."""
    docs = _table(spark, d, "documents").where("source is not null")
    return docs.select(F.col("source").alias("doc_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("page"), "text")


_EVEN = f"""{_PAGES}, sized AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS total FROM p), placed AS (SELECT *, (page - 1) // CASE WHEN total <= 5 THEN 1 WHEN total <= 20 THEN 5 WHEN total <= 100 THEN 10 ELSE greatest(10, total // 10) END + 1 AS ord FROM sized),
nodes AS (SELECT doc_id, ord::INT AS ord, min(page) AS start_page, lpad(ord::VARCHAR, 4, '0') AS node_id, any_value(total) AS total FROM placed GROUP BY doc_id, ord),
ended AS (SELECT doc_id, ord, node_id, start_page, CASE WHEN lead(start_page) OVER w IS NULL THEN total ELSE greatest(start_page, lead(start_page) OVER w - 1) END::INT AS end_page FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY ord))"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    return tree.build(tree.even_entries(pages), pages.groupBy("doc_id").agg(F.max("page").alias("total_pages")))


@query(f"WITH {_EVEN} SELECT * FROM ended")
def even_split_tree(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("doc_id", "ord", "node_id", "start_page", "end_page")


@query(f"WITH {_EVEN} SELECT e.doc_id, node_id, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM ended e JOIN p ON p.doc_id = e.doc_id AND page BETWEEN start_page AND end_page GROUP BY 1, 2")
def node_pages(spark: SparkSession, d: str) -> DataFrame:
    return tree.node_pages(_nodes(spark, d), _pages(spark, d)).groupBy("doc_id", "node_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {_EVEN}, chosen AS (SELECT *, CASE node_id WHEN '0002' THEN 1 WHEN '0001' THEN 2 END AS sel_ord FROM ended WHERE node_id IN ('0001', '0002')) SELECT doc_id, node_id, sel_ord, list(page ORDER BY page) AS pages FROM chosen JOIN p USING (doc_id) WHERE page BETWEEN start_page AND end_page AND trim(text) <> '' GROUP BY 1, 2, 3")
def extracted_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    chosen = nodes.select("doc_id", "node_id", F.when(F.col("node_id") == "0002", 1).when(F.col("node_id") == "0001", 2).alias("sel_ord")).where("sel_ord is not null")
    return tree.extract(nodes, _pages(spark, d), chosen).select("doc_id", "node_id", "sel_ord", "pages")


_MARKDOWN = [("m1", "# A\ntext\n## B\n### C\n## D\n# E"), ("m2", "intro\n## One\n# Two\n### Deep\n## Mid")]
_MARKDOWN_ROWS = "m1 0001 - 1|m1 0001.0001 0001 3|m1 0001.0001.0001 0001.0001 4|m1 0001.0002 0001 5|m1 0002 - 6|m2 0001 - 2|m2 0002 - 3|m2 0002.0001 0002 4|m2 0002.0002 0002 5"


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}', {}, {})".format(r.split()[0], r.split()[1], "NULL" if r.split()[2] == "-" else repr(r.split()[2]), r.split()[3]) for r in _MARKDOWN_ROWS.split("|")) + ") t(doc_id, node_id, parent_id, start_page)")
def markdown_tree(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame(_MARKDOWN, "doc_id string, text string")
    totals = files.select("doc_id", F.size(F.split("text", "\n")).alias("total_pages"))
    return tree.build(tree.markdown_entries(files), totals).select("doc_id", "node_id", "parent_id", "start_page")


@query("SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1) AS title, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<h1[^>]*>([^<]*)", 1).alias("title"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"))


# tables and windows

@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT doc_id + 100000000, 'new' FROM documents WHERE doc_id % 10 = 3")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    from .sources.store import upsert

    docs = _table(spark, d, "documents").select("doc_id", "source")
    changed = docs.where("doc_id % 10 = 3").select("doc_id", F.lit("new").alias("source"))
    return upsert(docs, changed.unionByName(changed.withColumn("doc_id", F.col("doc_id") + 100_000_000)), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src5'")
def without_file(spark: SparkSession, d: str) -> DataFrame:
    from .sources.store import delete_where

    return delete_where(_table(spark, d, "documents").select("doc_id", "source"), F.col("source") == "src5")


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS count, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return streaming.windowed_counts(_table(spark, d, "events"), "1 hour", None, "1 hour", "ts", "event_type")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS session_start, count(*) AS count FROM r GROUP BY user_id, n")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return streaming.session_counts(_table(spark, d, "events"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
