"""Ranking, search, grep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.catalog.basic import SQL_APP, SQL_INDEX, SQL_LANG, SQL_LAYER, SQL_TEST, SQL_TOKENS, TOKENS_SQL
from weftline.catalog.standins import FILES_SQL, files, table
from weftline.functions import paths as P
from weftline.operators import grep as G
from weftline.operators import retrieval as R
from weftline.plans import search as S
from weftline.providers import LexicalReranker

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


TF = f"(SELECT doc_id, {SQL_INDEX} AS idx, count(*)::DOUBLE AS tf FROM {TOKENS_SQL} GROUP BY ALL)"
IDF = "(SELECT idx, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY idx)"
#: The query is document 1 and vector 1.
SPARSE = "(SELECT t.doc_id, round(sum(q.tf * t.tf * i.idf), 6) AS score FROM tf t JOIN (SELECT idx, tf FROM tf WHERE doc_id = 1) q USING (idx) JOIN idf i USING (idx) GROUP BY t.doc_id)"
DENSE = "(SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings)"
WITH = f"WITH tf AS {TF}, idf AS {IDF}, sp AS {SPARSE}, de AS {DENSE}"
TOP = "(SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {0} QUALIFY rank <= {1})"
FUSED = f"(SELECT doc_id, round(sum(1::DOUBLE / (2 + rank - 1)), 6) AS score FROM (SELECT doc_id, rank FROM {TOP.format('sp', 30)} UNION ALL SELECT doc_id, rank FROM {TOP.format('de', 30)}) GROUP BY doc_id)"


def _postings(spark, d):
    return R.term_frequencies(table(spark, d, "documents"), "doc_id", F.col("text"))


def _weights(spark, d, postings):
    n = table(spark, d, "documents").count()
    return R.idf(postings, n)


def _sparse(spark, d):
    postings = _postings(spark, d)
    one = R.term_frequencies(table(spark, d, "documents").where("doc_id = 1"), "doc_id", F.col("text")).select("idx", F.col("tf").alias("q_tf"))
    # Only the query's terms need weights.
    own = postings.join(F.broadcast(one.select("idx")), "idx")
    return R.sparse_scores(own, one, _weights(spark, d, own), "doc_id")


def _dense(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("_q"))
    return e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), F.round(R.cosine(F.col("embedding"), F.col("_q")), R.DIGITS).alias("score"))


@query(f"WITH tf AS {TF} SELECT idx, df, round(idf, 6) AS idf FROM {IDF}")
def idf(spark, d):
    return _weights(spark, d, _postings(spark, d)).select("idx", "df", F.round("idf", 6).alias("idf"))


@query(f"{WITH} SELECT doc_id, score FROM sp")
def sparse_search(spark, d):
    return _sparse(spark, d)


@query(f"{WITH} SELECT doc_id, score, rank FROM {TOP.format('de', 30)}")
def dense_knn(spark, d):
    return R.top(_dense(spark, d), 30, "doc_id")


@query("SELECT event_type, event_id, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 20")
def topk_per_list(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", F.col("value").alias("score"))
    return R.top(e, 20, "event_id", ("event_type",))


@query("SELECT event_id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 10")
def topk_limit(spark, d):
    return table(spark, d, "events").select("event_id", F.col("value").alias("score")).orderBy(F.desc("score"), "event_id").limit(10)


@query(f"WITH de AS {DENSE} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM de JOIN documents USING (doc_id) WHERE source = 'src1' QUALIFY rank <= 15")
def module_prefetch(spark, d):
    own = table(spark, d, "documents").where("source = 'src1'").select("doc_id")
    return R.top(_dense(spark, d).join(own, "doc_id", "left_semi"), 15, "doc_id")


@query(f"{WITH} SELECT doc_id, score FROM {FUSED}")
def hybrid_rrf(spark, d):
    return R.fused([R.top(_sparse(spark, d), 30, "doc_id"), R.top(_dense(spark, d), 30, "doc_id")], "doc_id")


@query(f"{WITH}, fu AS {FUSED} SELECT doc_id, max(score) AS score FROM (SELECT doc_id, score FROM fu UNION ALL SELECT doc_id, round(1::DOUBLE / (2 + rank - 1), 6) FROM {TOP.format('de', 20)} WHERE (SELECT max(score) FROM fu) < 0.65) GROUP BY doc_id")
def fallback_merge(spark, d):
    first = hybrid_rrf(spark, d)
    return S.expanded(first, R.fused([R.top(_dense(spark, d), 20, "doc_id")], "doc_id"), "doc_id")


@query(f"{WITH} SELECT doc_id, rank, 1::DOUBLE - (rank - 1)::DOUBLE / 30 AS score FROM {TOP.format('de', 30)}")
def rerank_noop(spark, d):
    return R.top(_dense(spark, d), 30, "doc_id").select("doc_id", "rank", R.noop_rerank(F.col("rank"), 30).alias("score"))


@query("SELECT event_type, (count(*) <= 10 OR max(value) > 0.92 OR contains(event_type, '/') OR regexp_matches(event_type, '\\.(py|ts|js)')) AS skip FROM events GROUP BY event_type")
def rerank_skip(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"))
    return g.select("event_type", R.skips_rerank(F.col("n"), F.col("best"), F.col("event_type")).alias("skip"))


SCORED = f"(SELECT doc_id, file_path, n_chars / 1000.0::DOUBLE AS s, CAST(doc_id % 5 AS DOUBLE) / 4 AS imp, {SQL_TEST} AS is_test FROM {FILES_SQL} f JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"


def _scored(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.expr("n_chars / 1000.0D").alias("s"))
    return files(spark, d).join(n, "doc_id").select("doc_id", "file_path", "s", ((F.col("doc_id") % 5).cast("double") / 4).alias("imp"), P.is_test(F.col("file_path")).alias("is_test"))


@query(f"SELECT doc_id, CASE WHEN imp > 0 THEN s * (1 + 0.25::DOUBLE * imp) ELSE s END AS score FROM {SCORED}")
def importance_boost(spark, d):
    return _scored(spark, d).select("doc_id", R.boosted(F.col("s"), F.col("imp")).alias("score"))


@query(f"SELECT doc_id, round(CASE WHEN is_test THEN s * 0.80::DOUBLE ELSE s END, 6) AS score, round(CASE WHEN is_test THEN s * 0.95::DOUBLE ELSE s END, 6) AS debug_score FROM {SCORED}")
def test_demotion(spark, d):
    s, t = F.col("s"), F.col("is_test")
    return _scored(spark, d).select("doc_id", F.round(R.demoted(s, t, "code"), 6).alias("score"), F.round(R.demoted(s, t, "debug"), 6).alias("debug_score"))


@query(f"SELECT file_path, doc_id, s AS score FROM {SCORED} QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY s DESC, doc_id) = 1")
def dedup_max(spark, d):
    return R.deduplicated(_scored(spark, d).select("file_path", "doc_id", F.col("s").alias("score")), ("file_path",), "doc_id")


@query("SELECT event_type, rank, round(score - lead(score) OVER (PARTITION BY event_type ORDER BY rank), 6) AS gap FROM (SELECT event_type, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 10)")
def score_gaps(spark, d):
    top = topk_per_list(spark, d).where("rank <= 10")
    return top.select("event_type", "rank", F.round(F.col("score") - F.lead("score").over(Window.partitionBy("event_type").orderBy("rank")), 6).alias("gap"))


@query(
    "WITH r AS (SELECT event_type, value AS s, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS i FROM events QUALIFY i < 10), "
    "g AS (SELECT event_type, i, s, s - lead(s) OVER (PARTITION BY event_type ORDER BY i) AS gap FROM r), "
    "a AS (SELECT event_type, count(*) AS n, max(s) FILTER (WHERE i = 0) AS top, avg(gap) AS m, stddev_pop(gap) AS sd, least(4, count(*) - 1) AS k FROM g GROUP BY event_type), "
    "z AS (SELECT a.*, a.top - r.s AS lead_, CASE WHEN n < 3 OR top <= 0 OR (m = 0 AND sd = 0) THEN NULL WHEN sd > 1e-9 THEN ((top - r.s) - m * k) / (sd * sqrt(k)) WHEN top - r.s <= m * k + 1e-9 THEN -1 ELSE 2 END AS z FROM a JOIN r ON r.event_type = a.event_type AND r.i = a.k) "
    "SELECT event_type, round(coalesce(z, 0), 6) AS z, CASE WHEN z IS NULL THEN 'low' WHEN z >= 1 THEN 'high' WHEN z >= 0 THEN 'medium' ELSE 'low' END AS label, CASE WHEN z IS NULL THEN 'try_exhaustive' WHEN z >= 1 THEN 'none' WHEN z >= 0 THEN 'try_keyword' ELSE 'try_exhaustive' END AS suggestion FROM z"
)
def confidence_z(spark, d):
    top = topk_per_list(spark, d).where("rank <= 10").groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("rank", "score")))["score"].alias("s"))
    return top.select("event_type", R.confidence(F.col("s")).alias("c")).select("event_type", F.round("c.z", 6).alias("z"), "c.label", "c.suggestion")


@query(f"{WITH} SELECT doc_id, score FROM {TOP.format('de', 30)} JOIN documents USING (doc_id) WHERE lang = 'en' OR score >= 0.6 ORDER BY score DESC, doc_id LIMIT 5")
def lang_or_score(spark, d):
    x = R.top(_dense(spark, d), 30, "doc_id").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return x.where((F.col("lang") == "en") | (F.col("score") >= 0.6)).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(5)


GREP = f"(SELECT doc_id, file_path, i AS line_number, line AS line_content, regexp_extract(line, '(licen[cs]ed)|(\\bidiot\\b)', 0) AS pattern_matched FROM (SELECT doc_id, file_path, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS i FROM (SELECT doc_id, file_path, string_split(content, chr(10)) AS ls FROM {FILES_SQL})) WHERE regexp_matches(line, '(licen[cs]ed)|(\\bidiot\\b)'))"


def _grepped(spark, d):
    f = files(spark, d).withColumn("_key", F.concat_ws("#", "file_path", F.col("doc_id").cast("string")))
    hits = G.grep(f, ["licen[cs]ed", r"\bidiot\b"], path="_key")
    return hits.select(F.substring_index("_key", "#", -1).cast("long").alias("doc_id"), F.substring_index("_key", "#", 1).alias("file_path"), "line_number", "line_content", "pattern_matched")


@query(f"SELECT * FROM {GREP} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_number) <= 500")
def grep_lines(spark, d):
    return _grepped(spark, d)


RESULT_SQL = f"(SELECT doc_id, 1 AS line_start, 3 AS line_end FROM documents WHERE lang = 'en')"


@query(f"SELECT doc_id, file_path, line_number FROM {GREP} g WHERE NOT EXISTS (SELECT 1 FROM {RESULT_SQL} r WHERE r.doc_id = g.doc_id AND g.line_number BETWEEN r.line_start AND r.line_end)")
def grep_range_anti(spark, d):
    r = files(spark, d).where("lang = 'en'").select("doc_id", F.lit(1).alias("line_start"), F.lit(3).alias("line_end"))
    return G.uncovered(_grepped(spark, d), r, "doc_id").select("doc_id", "file_path", "line_number")


@query(f"{WITH} SELECT 'semantic' AS source, doc_id, score FROM {TOP.format('de', 30)} UNION ALL SELECT 'grep', doc_id, 0::DOUBLE FROM {GREP}")
def union_sources(spark, d):
    a = R.top(_dense(spark, d), 30, "doc_id").select(F.lit("semantic").alias("source"), "doc_id", "score")
    return a.unionByName(_grepped(spark, d).select(F.lit("grep").alias("source"), "doc_id", F.lit(0.0).alias("score")))


@query(
    f"{WITH}, best AS {TOP.format('de', 30)} SELECT 'semantic' AS source, doc_id, 1 AS line_number, score FROM best UNION ALL "
    f"(SELECT 'grep', doc_id, line_number, 0::DOUBLE FROM {GREP} g WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = g.doc_id AND g.line_number BETWEEN 1 AND 3) ORDER BY doc_id, line_number LIMIT 100)"
)
def exhaustive(spark, d):
    best = R.top(_dense(spark, d), 30, "doc_id")
    covered = best.select("doc_id", F.lit(1).alias("line_start"), F.lit(3).alias("line_end"))
    more = G.uncovered(_grepped(spark, d), covered, "doc_id").orderBy("doc_id", "line_number").limit(100)
    a = best.select(F.lit("semantic").alias("source"), "doc_id", F.lit(1).alias("line_number"), "score")
    return a.unionByName(more.select(F.lit("grep").alias("source"), "doc_id", "line_number", F.lit(0.0).alias("score")))


#: Chunks of a corpus: several documents share a file, and some of these a range of lines.
CPATH = "concat(source, '/', lang, '/', CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'test_' WHEN 1 THEN 'tests/m' ELSE 'm' END, CAST(doc_id % 40 AS STRING), CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.ts' END)"
FIRST = "CAST(doc_id % 3 * 100 + 1 AS INT)"
CHUNKS = f"(SELECT *, {SQL_LANG} AS language, {SQL_LAYER} AS layer, {SQL_TEST} AS is_test, {SQL_APP} AS app_name, concat(file_path, '::function::f', CAST(doc_id AS STRING)) AS chunk_id FROM (SELECT doc_id, {CPATH} AS file_path, text AS content, {FIRST} AS line_start, {FIRST} + 9 AS line_end, doc_id % 5 / 4::DOUBLE AS importance FROM documents))"


def _chunks(spark, d):
    p = F.col("file_path")
    rows = table(spark, d, "documents").select("doc_id", F.expr(CPATH).alias("file_path"), F.col("text").alias("content"), F.expr(FIRST).alias("line_start"), F.expr(f"{FIRST} + 9").alias("line_end"), ((F.col("doc_id") % 5).cast("double") / 4).alias("importance"))
    return rows.withColumns({"language": P.language(p), "layer": P.layer(p), "is_test": P.is_test(p), "app_name": P.app_name(p), "chunk_id": F.concat(p, F.lit("::function::f"), F.col("doc_id").cast("string")), "function_name": F.concat(F.lit("f"), F.col("doc_id").cast("string"))})


#: The vectors 1, 2 and 3 stand in for a query's; the text of document 1 for its words.
VECTOR_OF = {"semantic": 1, "signature": 2, "body": 3}


def _lists(spark, d):
    def lists(query, keep):
        some = _chunks(spark, d).where(keep).select("doc_id", "app_name")

        def ranked(p):
            own = some if p.module is None else some.where(F.col("app_name") == p.module)
            if p.using == "bm25":
                return _sparse(spark, d).join(own, "doc_id", "left_semi")
            e = table(spark, d, "embeddings")
            q = e.where(F.col("vec_id") == VECTOR_OF[p.using]).select(F.col("embedding").alias("_q"))
            scored = e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), F.round(R.cosine(F.col("embedding"), F.col("_q")), R.DIGITS).alias("score"))
            return scored.join(own, "doc_id", "left_semi")

        return ranked

    return lists


def _list_sql(p: S.Prefetch, keep: str) -> str:
    scores = "sp" if p.using == "bm25" else DENSE.replace("vec_id = 1)", f"vec_id = {VECTOR_OF[p.using]})")
    module = f" AND app_name = '{p.module}'" if p.module else ""
    return f"(SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {scores} JOIN ch USING (doc_id) WHERE {keep}{module} QUALIFY rank <= {p.limit})"


def _fused_sql(plan, keep: str, limit: int) -> str:
    lists = " UNION ALL ".join(f"SELECT doc_id, rank FROM {_list_sql(p, keep)}" for p in plan)
    return f"(SELECT doc_id, round(sum(1::DOUBLE / (2 + rank - 1)), 6) AS score FROM ({lists}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {limit})"


def _results_sql(intent: str, keep: str = "true", module: str = "", limit: int = 10, rerank: str | None = None) -> str:
    """WITH clause that ends in `res`: the results of a search."""
    most = max(S.CANDIDATES, limit) if intent == "enumeration" else S.CANDIDATES
    factor = 0.95 if intent == "debug" else 0.8
    found = f"co AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 WHERE (SELECT max(score) FROM f1) < {S.ENOUGH}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {most})"
    if rerank is None:
        scored = "sc AS (SELECT doc_id, score FROM co)"
    else:
        wanted = f"(SELECT list_distinct({SQL_TOKENS}) FROM (SELECT '{rerank}' AS text))"
        skip = f"((SELECT count(*) FROM co) <= 10 OR (SELECT max(score) FROM co) > 0.92 OR contains('{rerank}', '/') OR regexp_matches('{rerank}', '\\.(py|ts|js)'))"
        new = f"(SELECT doc_id, round(len(list_intersect({wanted}, {SQL_TOKENS})) / greatest(len({wanted}), 1), 6) AS score FROM co JOIN documents USING (doc_id))"
        scored = f"sc AS (SELECT doc_id, score FROM co WHERE {skip} UNION ALL (SELECT doc_id, score FROM {new} WHERE NOT {skip} ORDER BY score DESC, doc_id LIMIT {S.RERANKED}))"
    return (
        f"WITH tf AS {TF}, idf AS {IDF}, sp AS {SPARSE}, ch AS {CHUNKS}, f1 AS {_fused_sql(S.prefetches(intent, module), keep, most)}, f2 AS {_fused_sql(S.WIDE, keep, most)}, {found}, {scored}, "
        f"bo AS (SELECT * REPLACE (CASE WHEN is_test THEN score * {factor}::DOUBLE ELSE score END AS score) FROM (SELECT ch.*, CASE WHEN importance > 0 THEN sc.score * (1 + 0.25::DOUBLE * importance) ELSE sc.score END AS score FROM sc JOIN ch USING (doc_id))), "
        f"de AS (SELECT * FROM bo QUALIFY row_number() OVER (PARTITION BY file_path, line_start, line_end ORDER BY score DESC, doc_id) = 1), "
        f"res AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM de QUALIFY rank <= {limit})"
    )


SHOWN = ("rank", "doc_id", "file_path", "line_start", "line_end", "score", "is_test")
SHOW = f"SELECT {', '.join(SHOWN)} FROM res"


def _respond(spark, d, request, **more):
    return S.respond(request, _chunks(spark, d), _lists(spark, d), "doc_id", **more)


@query(f"{_results_sql('code')} {SHOW}")
def flagship(spark, d):
    """The whole search for code: fused lists, widened where unsure, boosted, demoted, one of each range, the first ten."""
    return _respond(spark, d, S.SearchRequest("parse the tree")).results.select(*SHOWN)


@query(f"{_results_sql('location', keep=chr(39).join(('language = ', 'python', '')), module='en')} {SHOW}")
def search_filtered(spark, d):
    """Filters act before each list is cut; the module of the file at hand has a list of its own."""
    return _respond(spark, d, S.SearchRequest("where is the tree", filters={"language": "python"}, active_file="src1/en/m1.py")).results.select(*SHOWN)


@query(f"{_results_sql('debug')} {SHOW}")
def search_debug(spark, d):
    return _respond(spark, d, S.SearchRequest("fix the bug")).results.select(*SHOWN)


@query(f"{_results_sql('enumeration', limit=S.ENUMERATION)} {SHOW}")
def search_keyword(spark, d):
    """Keyword mode enumerates: up to 200 results from a large list of words and a smaller one of vectors."""
    return _respond(spark, d, S.SearchRequest("parse the tree", mode="keyword")).results.select(*SHOWN)


RERANK_QUERY = "the and of to in anouea thwh"


@query(f"{_results_sql('code', rerank=RERANK_QUERY)} {SHOW}")
def search_reranked(spark, d):
    return _respond(spark, d, S.SearchRequest(RERANK_QUERY), reranker=LexicalReranker()).results.select(*SHOWN)


@query(
    f"{_results_sql('code')}, r AS (SELECT score AS s, rank - 1 AS i FROM res WHERE rank <= 10), g AS (SELECT i, s, s - lead(s) OVER (ORDER BY i) AS gap FROM r), "
    "a AS (SELECT count(*) AS n, max(s) FILTER (WHERE i = 0) AS top, avg(gap) AS m, stddev_pop(gap) AS sd, least(4, count(*) - 1) AS k FROM g), "
    "z AS (SELECT CASE WHEN n < 3 OR top <= 0 OR (m = 0 AND sd = 0) THEN NULL WHEN sd > 1e-9 THEN ((top - r.s) - m * k) / (sd * sqrt(k)) WHEN top - r.s <= m * k + 1e-9 THEN -1 ELSE 2 END AS z, n, top FROM a JOIN r ON r.i = a.k) "
    "SELECT round(coalesce(z, 0), 6) AS z, CASE WHEN z IS NULL THEN 'low' WHEN z >= 1 THEN 'high' WHEN z >= 0 THEN 'medium' ELSE 'low' END AS label, CASE WHEN z IS NULL THEN 'try_exhaustive' WHEN z >= 1 THEN 'none' WHEN z >= 0 THEN 'try_keyword' ELSE 'try_exhaustive' END AS suggestion, n::INT AS result_count, top AS top_score FROM z"
)
def search_confidence(spark, d):
    r = _respond(spark, d, S.SearchRequest("parse the tree"))
    return spark.createDataFrame([(round(r.confidence, 6), r.confidence_label, r.suggestion, r.result_count, r.top_score)], "z double, label string, suggestion string, result_count int, top_score double")


HITS = "(SELECT file_path, unnest(ls) AS content, generate_subscripts(ls, 1)::INT AS line_number FROM (SELECT file_path, string_split(content, chr(10)) AS ls FROM ch WHERE regexp_matches(content, '(licensed)|(idiot)')))"


@query(
    f"{_results_sql('location')}, hits AS (SELECT * FROM {HITS} WHERE regexp_matches(content, '(licensed)|(idiot)')) SELECT file_path, line_start, line_end, score, 'semantic' AS source FROM res UNION ALL "
    "(SELECT file_path, line_number, line_number, 0::DOUBLE, 'grep' FROM hits h WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.file_path = h.file_path AND h.line_number BETWEEN res.line_start AND res.line_end) ORDER BY file_path, line_number, content LIMIT 100)"
)
def search_exhaustive(spark, d):
    """Behind the results the grepped lines that lie in none of their ranges."""
    files = _chunks(spark, d).select("file_path", "content")
    return _respond(spark, d, S.SearchRequest("where is licensed idiot", mode="exhaustive"), files=files).results.select("file_path", "line_start", "line_end", "score", "source")


#: Edges between the chunks' functions, of several kinds, some in tests.
LINKS = f"(SELECT concat({CPATH}, '::f', CAST(doc_id AS STRING)) AS source_entity, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'tests' ELSE 'contains' END AS relationship, concat('src1/en/', 'm', CAST(doc_id * 7 % 40 AS STRING), '.py::f', CAST(doc_id * 7 % 200 AS STRING)) AS target_entity FROM documents)"
LINKS = f"(SELECT * FROM {LINKS} UNION ALL SELECT concat('core/a', CAST(doc_id % 9 AS STRING), '.py::run', CAST(doc_id % 50 AS STRING)), CASE WHEN doc_id % 2 = 0 THEN 'calls' ELSE 'renders' END, concat({CPATH}, '::f', CAST(doc_id AS STRING)) FROM documents)"
CONTEXT = (
    "own AS (SELECT doc_id, file_path, unnest([chunk_id, concat(file_path, '::f', CAST(doc_id AS STRING))]) AS entity FROM res WHERE rank <= 5), bel AS (SELECT DISTINCT r.doc_id, o.entity FROM res r JOIN own o USING (file_path) WHERE r.rank <= 5), "
    f"ed AS {LINKS}, en AS (SELECT source_entity AS entity, target_entity AS other, relationship FROM ed UNION ALL SELECT target_entity, source_entity, relationship FROM ed), "
    "nr AS (SELECT DISTINCT doc_id, CASE WHEN relationship = 'tests' OR contains(lower(other), 'test') THEN 'tests' WHEN relationship IN ('calls', 'imports', 'inherits', 'renders') THEN 'callers' END AS side, regexp_extract(other, '[^:]*$') AS name FROM en JOIN bel USING (entity)), "
    "li AS (SELECT doc_id, list_sort(list(name) FILTER (WHERE side = 'callers')) AS callers, list_sort(list(name) FILTER (WHERE side = 'tests')) AS tests FROM nr WHERE side IS NOT NULL GROUP BY doc_id) "
)


@query(f"{_results_sql('code')}, {CONTEXT} SELECT rank, doc_id, CASE WHEN li.doc_id IS NOT NULL THEN concat_ws(' | ', CASE WHEN len(callers) > 0 THEN concat('Called by: ', array_to_string(callers[1:3], ', ')) END, CASE WHEN len(tests) > 0 THEN concat('Tests: ', array_to_string(tests[1:1], ', ')) END) END AS context FROM res LEFT JOIN li USING (doc_id)")
def enrich_context(spark, d):
    """The first five results with who uses them and what tests them, by the edges at either end of their files' entities."""
    doc, path = F.col("doc_id"), F.expr(CPATH)
    t = table(spark, d, "documents")
    num = lambda c: c.cast("string")
    kind = F.when(doc % 4 == 0, "calls").when(doc % 4 == 1, "imports").when(doc % 4 == 2, "tests").otherwise("contains")
    out = t.select(F.concat(path, F.lit("::f"), num(doc)).alias("source_entity"), kind.alias("relationship"), F.concat(F.lit("src1/en/m"), num(doc * 7 % 40), F.lit(".py::f"), num(doc * 7 % 200)).alias("target_entity"))
    back = t.select(F.concat(F.lit("core/a"), num(doc % 9), F.lit(".py::run"), num(doc % 50)).alias("source_entity"), F.when(doc % 2 == 0, "calls").otherwise("renders").alias("relationship"), F.concat(path, F.lit("::f"), num(doc)).alias("target_entity"))
    return _respond(spark, d, S.SearchRequest("parse the tree"), edges=out.unionByName(back)).results.select("rank", "doc_id", "context")
