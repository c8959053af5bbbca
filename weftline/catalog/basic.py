"""Scans, projections, filters, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog.standins import FILES_SQL, files, table
from weftline.functions import paths as P
from weftline.functions import text as T
from weftline.operators import grep as G
from weftline.operators import retrieval as R

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def sql_in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


SQL_LANG = "CASE WHEN position('.' IN file_path) > 0 THEN CASE lower(regexp_extract(file_path, '[^.]*$')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " ELSE 'unknown' END ELSE 'unknown' END"
SQL_TEST = f"regexp_matches(file_path, '{P.TEST_FILE}')"
SQL_LAYER = f"CASE WHEN {SQL_TEST} THEN 'test' WHEN " + " WHEN ".join(f"regexp_extract(file_path, '[^/]*$') = '{k}' THEN '{v}'" for k, v in P.LAYERS.items()) + " WHEN regexp_matches(file_path, '[^/]\\.(tsx|jsx)$') THEN 'component' ELSE 'other' END"
SQL_APP = "coalesce(CASE WHEN len(string_split(file_path, '/')) < 2 THEN '' ELSE string_split(file_path, '/')[-2] END, '')"


@query(f"SELECT file_path, doc_id FROM {FILES_SQL} WHERE {sql_in(SQL_LANG, ['python', 'tsx', 'typescript'])} AND size_bytes <= 1048576 AND NOT regexp_matches(file_path, '(^|/)generated/') ORDER BY file_path, doc_id")
def scan_filter_sort(spark, d):
    f = files(spark, d)
    return f.where(P.language(F.col("file_path")).isin("python", "tsx", "typescript") & (F.col("size_bytes") <= 1 << 20) & ~F.col("file_path").rlike("(^|/)generated/")).select("file_path", "doc_id").orderBy("file_path", "doc_id")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE trim(text) <> ''")
def scan_nonblank(spark, d):
    return table(spark, d, "documents").where(F.trim("text") != "").select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id FROM labels WHERE quality = 1")
def proj_filter_scan(spark, d):
    return table(spark, d, "labels").where("quality = 1").select("doc_id")


@query("SELECT count(*) AS n, count(lang) AS n_lang FROM documents")
def row_count(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"))


@query(f"SELECT doc_id, {SQL_LANG} AS language FROM {FILES_SQL}")
def language_map(spark, d):
    return files(spark, d).select("doc_id", P.language(F.col("file_path")).alias("language"))


@query(f"SELECT doc_id, {SQL_TEST} AS is_test FROM {FILES_SQL}")
def is_test(spark, d):
    return files(spark, d).select("doc_id", P.is_test(F.col("file_path")).alias("is_test"))


@query(f"SELECT doc_id, {SQL_LAYER} AS layer FROM {FILES_SQL}")
def layer_case(spark, d):
    return files(spark, d).select("doc_id", P.layer(F.col("file_path")).alias("layer"))


@query(f"SELECT doc_id, {SQL_APP} AS app_name FROM {FILES_SQL}")
def parent_dir(spark, d):
    return files(spark, d).select("doc_id", P.app_name(F.col("file_path")).alias("app_name"))


SQL_DEF = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('def f', CAST(doc_id AS STRING), '(x):\n', text) WHEN 1 THEN concat('  class C', CAST(doc_id AS STRING), '::\n', text) ELSE text END"
SQL_KIND = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'section' WHEN 1 THEN 'toplevel' ELSE 'function' END"


@query(
    f"SELECT doc_id, CASE WHEN kind IN ('section', 'toplevel') OR body = '' THEN '' WHEN regexp_matches(first, '^(def |class |async def )') THEN rtrim(first, ':') ELSE '' END AS signature FROM "
    f"(SELECT *, trim(string_split(regexp_replace(regexp_replace(body, '^\\s+', ''), '\\s+$', ''), chr(10))[1]) AS first FROM (SELECT doc_id, {SQL_KIND} AS kind, {SQL_DEF} AS body FROM documents))"
)
def signature_line(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.expr(SQL_KIND).alias("kind"), F.expr(SQL_DEF.replace("\n", "\\n")).alias("body"))
    return x.select("doc_id", P.signature(F.col("kind"), F.col("body")).alias("signature"))


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND {SQL_KIND} = 'function' THEN concat_ws('::', file_path, 'function', concat('f', CAST(doc_id AS STRING))) ELSE concat_ws('::', file_path, 'toplevel', left(sha256(content), 12)) END AS chunk_id FROM {FILES_SQL}"
)
def chunk_id(spark, d):
    name = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).otherwise("")
    return files(spark, d).select("doc_id", P.chunk_id(F.col("file_path"), F.expr(SQL_KIND), name, F.col("content")).alias("chunk_id"))


@query("SELECT doc_id, concat_ws(chr(10), nullif(source, ''), CASE WHEN doc_id % 2 = 0 THEN lang END, nullif(text, '')) AS joined FROM documents")
def concat_optional(spark, d):
    return table(spark, d, "documents").select("doc_id", P.joined(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text")).alias("joined"))


@query(f"SELECT doc_id, file_path, coalesce(NULL, 0) AS line_start, len(string_split(content, chr(10)))::INT AS line_end, {SQL_LANG} AS language, {SQL_TEST} AS is_test, array_to_string(string_split(content, chr(10))[1:5], chr(10)) AS snippet FROM {FILES_SQL}")
def compact_projection(spark, d):
    f = files(spark, d)
    c, none = F.col("content"), F.lit(None).cast("string")
    return f.select("doc_id", "file_path", F.lit(0).alias("line_start"), F.size(F.split(c, "\n")).alias("line_end"), P.language(F.col("file_path")).alias("language"), P.is_test(F.col("file_path")).alias("is_test"), P.snippet(none, none, c).alias("snippet"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('def g()', chr(10), array_to_string(string_split(text, chr(10))[1:4], chr(10))) WHEN doc_id % 3 = 1 THEN 'def g()' ELSE array_to_string(string_split(text, chr(10))[1:5], chr(10)) END AS snippet FROM documents")
def snippet(spark, d):
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").select("doc_id", P.snippet(F.when(k < 2, "def g()"), F.when(k == 0, F.col("text")), F.col("text")).alias("snippet"))


@query("SELECT o_orderkey, concat('f.py::', o_orderstatus, '::', o_orderpriority) AS entity, o_orderpriority AS short, concat(o_orderstatus, '::', o_orderpriority) AS bare FROM orders")
def short_name(spark, d):
    e = F.concat(F.lit("f.py::"), "o_orderstatus", F.lit("::"), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", e.alias("entity"), P.short_name(e).alias("short"), P.bare_symbol(e).alias("bare"))


@query("SELECT p_partkey, CASE WHEN position('::' IN e) > 0 THEN substr(e, position('::' IN e) + 2) END AS bare FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '::', p_type) ELSE p_name END AS e FROM part)")
def bare_symbol(spark, d):
    e = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("::"), "p_type")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", P.bare_symbol(e).alias("bare"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {SQL_LANG} AS language, {SQL_LAYER} AS layer, {SQL_TEST} AS is_test FROM {FILES_SQL}) WHERE language = 'python' AND layer = 'model' AND NOT is_test")
def payload_filter(spark, d):
    p = F.col("file_path")
    chunks = files(spark, d).select("doc_id", P.language(p).alias("language"), P.layer(p).alias("layer"), P.is_test(p).alias("is_test"))
    return chunks.where(R.payload_filter({"language": "python", "layer": "model", "is_test": "false"})).select("doc_id")


@query(f"SELECT doc_id, size_bytes FROM {FILES_SQL} WHERE size_bytes <= 2000")
def size_filter(spark, d):
    return files(spark, d).where("size_bytes <= 2000").select("doc_id", F.col("size_bytes").cast("long").alias("size_bytes"))


SQL["size_filter"] = f"SELECT doc_id, size_bytes::BIGINT AS size_bytes FROM {FILES_SQL} WHERE size_bytes <= 2000"


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS context FROM documents")
def line_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", G.line_range(F.col("text"), 2, 4).alias("context"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN concat(left(text, 300), '...') ELSE text END AS short FROM documents")
def truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.shortened(F.col("text"), 300).alias("short"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT page_id, rtrim(url, '/') AS url FROM pages")
def url_norm(spark, d):
    return table(spark, d, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))


@query(f"SELECT doc_id, CASE WHEN contains(lower(file_path), 'test') THEN 'tests' WHEN contains(lower(file_path), 'admin') THEN 'admin' WHEN contains(lower(file_path), 'constants') OR contains(lower(file_path), 'config') THEN 'config' WHEN contains(lower(file_path), 'script') THEN 'scripts' ELSE 'imports' END AS category FROM {FILES_SQL}")
def categorize(spark, d):
    return files(spark, d).select("doc_id", T.category(F.lit("imports"), F.col("file_path")).alias("category"))


@query("SELECT event_id, sha256(event_type) AS query_hash, round(value, 4) AS top_score FROM events")
def hash_round(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2("event_type", 256).alias("query_hash"), F.round("value", 4).alias("top_score"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT wanted, arg_min(n_name, (tier, n_name)) AS found FROM (SELECT r_name AS wanted, n_name, CASE WHEN n_name = r_name THEN 0 WHEN n_regionkey = r_regionkey THEN 1 ELSE 2 END AS tier FROM region, nation) GROUP BY wanted")
def tiered_lookup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    # Both sides are fixed lists of a few rows.
    tier = F.when(F.col("n_name") == F.col("r_name"), 0).when(F.col("n_regionkey") == F.col("r_regionkey"), 1).otherwise(2)
    return r.crossJoin(F.broadcast(n)).groupBy(F.col("r_name").alias("wanted")).agg(F.min(F.struct(tier.alias("tier"), "n_name"))["n_name"].alias("found"))


SQL_WORDS = "list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: w <> '')"


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_any(words) -> str:
    return "(" + " OR ".join("contains(lower(q), '" + w.replace("'", "''") + "')" for w in words) + ")"


SQL_QUESTION = f"(rtrim(q) LIKE '%?' OR coalesce({SQL_WORDS}[1], '') IN ({', '.join(repr(w) for w in T.QUESTION_WORDS)}))"
SQL_INTENT = (
    f"CASE WHEN list_has_any({SQL_WORDS}, {_sql_list(T.HARD_DEBUG)}) OR {_sql_any(T.DEBUG_PHRASES)} OR len(list_intersect({SQL_WORDS}, {_sql_list(T.SOFT_DEBUG)})) >= 2 "
    f"OR (len(list_intersect({SQL_WORDS}, {_sql_list(T.SOFT_DEBUG)})) > 0 AND (list_has_any({SQL_WORDS}, {_sql_list(T.ERROR_WORDS)}) OR {SQL_QUESTION})) THEN 'debug' "
    f"WHEN {_sql_any(T.LOCATION_PHRASES)} THEN 'location' WHEN {_sql_any(T.DOCS_PHRASES)} THEN 'docs' WHEN coalesce({SQL_WORDS}[1], '') IN ('how', 'what') AND rtrim(q) LIKE '%?' THEN 'docs' "
    f"WHEN regexp_matches(trim(q), '{T.BARE}') THEN 'location' ELSE 'code' END"
)
#: Questions made from items: a prefix by number, then the text, or its first word alone.
SQL_Q = "concat(CASE CAST(item_id % 10 AS INT) WHEN 0 THEN 'where is ' WHEN 1 THEN 'why fail ' WHEN 2 THEN 'how does ' WHEN 3 THEN 'fix the bug ' WHEN 4 THEN 'what ' WHEN 5 THEN 'investigate issue ' WHEN 6 THEN '' WHEN 7 THEN 'find ' WHEN 8 THEN 'why ' ELSE 'get_' END, CASE WHEN item_id % 10 = 6 OR item_id % 10 = 9 THEN lower(regexp_extract(text, '[A-Za-z]+')) ELSE text END, CASE WHEN item_id % 10 IN (2, 4, 8) THEN '?' ELSE '' END)"


def _questions(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.expr(SQL_Q.replace("'[A-Za-z]+')", "'[A-Za-z]+', 0)")).alias("q"))


@query(f"SELECT item_id, {SQL_INTENT} AS intent FROM (SELECT item_id, {SQL_Q} AS q FROM benchmark)")
def intent(spark, d):
    return _questions(spark, d).select("item_id", T.intent(F.col("q")).alias("intent"))


@query(f"SELECT item_id, CASE WHEN {SQL_INTENT} = 'docs' THEN 'docs' ELSE 'code' END AS collection FROM (SELECT item_id, {SQL_Q} AS q FROM benchmark)")
def intent_collection(spark, d):
    return _questions(spark, d).select("item_id", T.collection_for(T.intent(F.col("q"))).alias("collection"))


@query(f"SELECT item_id, len(list_intersect({SQL_WORDS}, {_sql_list(T.STOP_WORDS)}))::INT AS n FROM (SELECT item_id, text AS q FROM benchmark)")
def intersect_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(F.array_intersect(T.words(F.col("text")), F.array(*[F.lit(w) for w in T.STOP_WORDS]))).alias("n"))


SQL_SKIP = "((q LIKE '\"%' AND q LIKE '%\"') OR regexp_matches(q, '^[A-Z][a-zA-Z0-9]+$') OR (regexp_matches(q, '^[a-z][a-z0-9_]*$') AND contains(q, '_')) OR contains(q, '/') OR regexp_matches(q, '\\.(py|ts|js|tsx|jsx)$'))"


@query(f"SELECT item_id, {SQL_SKIP} AS skip FROM (SELECT item_id, {SQL_Q} AS q FROM benchmark)")
def skip_enhance(spark, d):
    return _questions(spark, d).select("item_id", T.skips_enhancement(F.col("q")).alias("skip"))


@query(f"SELECT item_id, CASE WHEN {SQL_SKIP} THEN q ELSE regexp_replace(regexp_replace(q, '(?i)\\bof\\b', 'of (belonging to)', 'g'), '(?i)\\bthe\\b', 'the (this, that)', 'g') END AS enhanced FROM (SELECT item_id, {SQL_Q} AS q FROM benchmark)")
def enhance_query(spark, d):
    return _questions(spark, d).select("item_id", T.enhanced(F.col("q"), {"of": "belonging to"}, {"the": ["this", "that"]}).alias("enhanced"))


# RE2 has no lookahead: capitals before a capitalised part are cut off first, then the simple pattern finds the same parts.
SQL_SEGMENT = "regexp_extract_all(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+')"
SQL_PARTS = f"flatten(list_transform(list_filter(string_split(i, '_'), lambda s: s <> ''), lambda s: CASE WHEN len({SQL_SEGMENT}) > 0 THEN list_transform({SQL_SEGMENT}, lambda p: lower(p)) ELSE [lower(s)] END))"
SQL_PARTS = f"(CASE WHEN len({SQL_PARTS}) > 0 THEN {SQL_PARTS} ELSE [lower(i)] END)"
SQL_TOKENS = f"list_filter(flatten(list_transform(regexp_extract_all(text, '{T.IDENTIFIER}'), lambda i: list_concat([lower(i)], {SQL_PARTS}))), lambda t: length(t) > 1)"
# Unnested by identifier: fast where texts are long.
TOKENS_SQL = f"(SELECT doc_id, t FROM (SELECT doc_id, unnest(list_concat([lower(i)], {SQL_PARTS})) AS t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{T.IDENTIFIER}')) AS i FROM documents)) WHERE length(t) > 1)"
SQL_INDEX = "((8 * ('0x' || substr(md5(t), 1, 8))::BIGINT + 4 * ('0x' || substr(md5(t), 9, 8))::BIGINT + 2 * ('0x' || substr(md5(t), 17, 8))::BIGINT + ('0x' || substr(md5(t), 25, 8))::BIGINT) % 2147483647)::INT"


@query(f"SELECT item_id, i AS identifier, {SQL_PARTS} AS parts FROM (SELECT item_id, unnest(regexp_extract_all(text, '{T.IDENTIFIER}')) AS i FROM benchmark)")
def split_ident(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.identifiers(F.col("text"))).alias("identifier")).withColumn("parts", T.parts_of(F.col("identifier")))


SQL_TERM = "concat(replace(lang, 'n', 'N'), 'HTTPServer_', source, 'ToXMLFile', CAST(doc_id % 7 AS STRING), '__', upper(lang), 'x')"


@query(f"SELECT doc_id, list_transform(list_filter(flatten(list_transform(list_filter(string_split({SQL_TERM}, '_'), lambda x: x <> ''), lambda x: string_split(regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_'))), lambda x: x <> ''), lambda x: lower(x)) AS parts FROM documents")
def split_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_parts(F.expr(SQL_TERM)).alias("parts"))


@query(f"SELECT doc_id, count(DISTINCT t) AS n_tokens FROM {TOKENS_SQL} GROUP BY doc_id")
def tokenize(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    return x.where("n_tokens > 0")


@query(f"SELECT doc_id, {SQL_INDEX} AS idx, count(*)::DOUBLE AS tf FROM {TOKENS_SQL} GROUP BY ALL")
def term_freq(spark, d):
    return R.term_frequencies(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"SELECT DISTINCT t AS token, {SQL_INDEX} AS idx FROM {TOKENS_SQL}")
def token_hash(spark, d):
    t = table(spark, d, "documents").select(F.explode(T.all_tokens(F.col("text"))).alias("token")).distinct()
    return t.withColumn("idx", T.token_index(F.col("token")))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_words FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_words"))


@query(f"SELECT item_id, CASE WHEN len(kept) >= len(words) * 0.2 THEN kept END AS kept FROM (SELECT item_id, {SQL_WORDS} AS words, list_filter({SQL_WORDS}, lambda w: NOT list_contains({_sql_list(T.STOP_WORDS)}, w)) AS kept FROM (SELECT item_id, text AS q FROM benchmark))")
def stopword_safeguard(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.without_stop_words(T.words(F.col("text"))).alias("kept"))


@query(f"SELECT item_id, list(w ORDER BY i) AS words FROM (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, {SQL_WORDS} AS ws FROM (SELECT item_id, text AS q FROM benchmark))) GROUP BY ALL) GROUP BY item_id")
def ordered_distinct(spark, d):
    """Words in order of first occurrence."""
    return table(spark, d, "benchmark").select("item_id", F.array_distinct(T.words(F.col("text"))).alias("words"))


SQL_RESPONSE = "CASE WHEN doc_id % 3 = 0 THEN concat('Description: ', text, chr(10), 'Keywords: ', lang) WHEN doc_id % 3 = 1 THEN concat('keywords:', source) ELSE text END"


@query(
    f"SELECT doc_id, CASE WHEN d = '' AND k = '' THEN trim(r) ELSE d END AS description, k AS keywords FROM (SELECT doc_id, r, coalesce(trim(substr(list_filter(ls, lambda x: starts_with(lower(x), 'description:'))[-1], 13)), '') AS d, coalesce(trim(substr(list_filter(ls, lambda x: starts_with(lower(x), 'keywords:'))[-1], 10)), '') AS k "
    f"FROM (SELECT doc_id, r, list_transform(string_split(trim(r), chr(10)), lambda x: trim(x)) AS ls FROM (SELECT doc_id, {SQL_RESPONSE} AS r FROM documents)))"
)
def parse_response(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.expr(SQL_RESPONSE).alias("r"))
    return r.select("doc_id", T.enrichment(F.col("r")).alias("e")).select("doc_id", "e.description", "e.keywords")


def _passes(sql: str, passes) -> str:
    for pattern, by in passes:
        sql = "regexp_replace({}, '{}', '{}', 'g')".format(sql, pattern.replace("'", "''"), by.replace("'", "''"))
    return sql


#: A raw transcript around each message: prompt, headers of calls, fields, paths, code, prose.
RAW = (
    "concat('## Task Prompt\n\nTASK:\nFind it ', CAST(turn AS STRING), '\n\nINSTRUCTIONS: x\n### Assistant\n\nTool calls: 3\n\n', text, '\n**[Tool Call 1] Grep:** pattern=`a b` path=`/home/me/work/x` mode=content\n**[Tool Call 2] Glob:** z\n"
    "{\n  \"score\": 0.5,\n  \"file\": \"/home/me/work/a.py\",\n  \"is_test\": true\n}\nSee /home/me/work (score: 0.31) and I''ll grep with ripgrep by seeker Grep: no Grep yes.\n```bash\ngrep -rn \"def f\" src | head\nrg ''x y'' --stats\nfind . -name \"*.py\" -print\n```\nsemantic results of exhaustive mode, low confidence (0.2)\n')"
)
RAW_SQL = RAW.replace("\n", "' || chr(10) || '")
SQL_TASK = "concat('## Task', chr(10), chr(10), 'Find it ', CAST(turn AS STRING), chr(10), chr(10), '---', chr(10), chr(10))"
SQL_CLEAN = _passes(_passes("concat(" + SQL_TASK + ", substr(r, position('### Assistant' IN r)))", T.HEADERS), T.FIELDS)
SQL_CODE = _passes("regexp_replace(x, '^bash\\n', chr(10))", T.COMMANDS)


@query(
    f"SELECT conv_id, turn, regexp_replace({_passes('c', T.PROSE)}, '(?i)\\bseeker\\b', 'the tool', 'g') AS text FROM (SELECT conv_id, turn, array_to_string(list_transform(string_split(replace(replace({SQL_CLEAN}, '/home/me/work/', ''), '/home/me/work', '.'), '```'), lambda x, i: CASE WHEN i % 2 = 0 THEN {SQL_CODE} ELSE x END), '```') AS c FROM (SELECT conv_id, turn, {RAW_SQL} AS r FROM conversations))"
)
def sanitize(spark, d):
    """Raw transcripts without what tells which tool made them."""
    raw = F.expr(RAW.replace("''", "\\'").replace("\n", "\\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.sanitized(raw, ["/home/me/work"], {"seeker": "the tool"}).alias("text"))


#: Replies of a judge: JSON alone, in a code block with words around, out of range, incomplete, none.
REPLY = "concat(CASE WHEN doc_id % 5 = 1 THEN 'Scores follow\n```json\n' ELSE '' END, CASE WHEN doc_id % 5 < 4 THEN concat('{\"alpha\": {\"discovery\": ', CAST(1 + doc_id % 5 AS STRING), ', \"precision\": 2.5}, \"beta\": {\"discovery\": ', CAST(doc_id % 7 AS STRING), CASE WHEN doc_id % 5 = 3 THEN '' ELSE ', \"precision\": 4' END, '}}') ELSE 'no scores' END, CASE WHEN doc_id % 5 = 1 THEN '\n```' ELSE '' END)"
SQL_TRIES = "[r, regexp_extract(r, '\\{[^{}]*\"alpha\"[^{}]*\"beta\"[^{}]*\\}'), regexp_extract(r, '(\\{[\\s\\S]*?\"alpha\"[\\s\\S]*?\"beta\"[\\s\\S]*?\\})(\\s*$|\\s*```)', 1)]"
SQL_SCORES = "[" + ", ".join(f"TRY_CAST(json_extract_string(j, '$.{k}.{x}') AS DOUBLE)" for k in ("alpha", "beta") for x in ("discovery", "precision")) + "]"


@query(f"SELECT doc_id, v[1] AS alpha_discovery, v[3] AS beta_discovery FROM (SELECT doc_id, CASE WHEN len(list_filter(s, lambda x: x BETWEEN 1 AND 5)) = 4 THEN s END AS v FROM (SELECT doc_id, {SQL_SCORES} AS s FROM (SELECT doc_id, list_filter({SQL_TRIES}, lambda x: regexp_matches(x, '^\\s*\\{{') AND json_valid(x))[1] AS j FROM (SELECT doc_id, {REPLY.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))} AS r FROM documents))))")
def json_extract(spark, d):
    """Scores out of a judge's reply, by three tries; null unless all are there, from 1 to 5."""
    r = table(spark, d, "documents").select("doc_id", F.expr(REPLY.replace("\n", "\\n")).alias("r"))
    scores = T.valid_scores(T.extracted_json(F.col("r")), ("discovery", "precision"))
    return r.select("doc_id", scores.alias("v")).select("doc_id", "v.alpha_discovery", "v.beta_discovery")


EVENTS = "concat('{\"intent\": \"', CASE WHEN turn % 3 = 0 THEN 'LOCATION' ELSE 'CODE' END, '\", \"confidence_label\": \"', CASE WHEN turn % 2 = 0 THEN 'HIGH' ELSE 'LOW' END, '\", \"auto_escalated\": ', CASE WHEN length(text) % 2 = 0 THEN 'true' ELSE 'false' END, '} ', text)"


@query("SELECT conv_id, " + ", ".join(f"sum(len(regexp_extract_all(t, '{p}')))::BIGINT AS {n}" for n, p in T.BEHAVIOUR.items()) + f" FROM (SELECT conv_id, {EVENTS} AS t FROM conversations) GROUP BY conv_id")
def regex_counts(spark, d):
    """What a search's responses in raw transcripts tell: escalations, labels, escalated locations."""
    t = table(spark, d, "conversations").select("conv_id", F.expr(EVENTS).alias("t"))
    return t.groupBy("conv_id").agg(*[F.sum(F.regexp_count("t", F.lit(p))).alias(n) for n, p in T.BEHAVIOUR.items()])


@query(f"SELECT doc_id, {SQL_LANG} AS language, CASE lower(regexp_extract(file_path, '[^.]*$')) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'script' WHEN 'tsx' THEN 'script' WHEN 'js' THEN 'script' WHEN 'jsx' THEN 'script' ELSE 'text' END AS parser FROM {FILES_SQL}")
def parser_choice(spark, d):
    from weftline.operators.chunking import parser

    return files(spark, d).select("doc_id", P.language(F.col("file_path")).alias("language"), parser(F.col("file_path")).alias("parser"))


@query("SELECT o_orderkey, map_keys(m) AS k, map_values(m) AS v FROM (SELECT o_orderkey, map_concat(MAP {'a': o_orderstatus, 'b': o_orderpriority}, MAP {'b': o_orderdate::DATE::VARCHAR, 'c': o_orderstatus}) AS m FROM orders)")
def merge_maps(spark, d):
    """Two structures as one; of both the later one's values."""
    m = T.right_wins(F.create_map(F.lit("a"), "o_orderstatus", F.lit("b"), "o_orderpriority"), F.create_map(F.lit("b"), F.col("o_orderdate").cast("date").cast("string"), F.lit("c"), "o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.map_keys("m").alias("k"), F.map_values("m").alias("v"))


@query(f"SELECT doc_id, concat_ws(chr(10), concat('[File]: ', file_path), concat('[Layer]: ', {SQL_LAYER}), concat('[App]: ', {SQL_APP}), concat('[Description]: ', content), concat('[Keywords]: ', lang), CASE WHEN doc_id % 2 = 0 THEN '[Callers]: a, b' END, CASE WHEN doc_id % 3 = 0 THEN '[Imports]: c' END) AS t FROM (SELECT * FROM {FILES_SQL} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))")
def enriched_text(spark, d):
    """The labelled text of a described chunk."""
    p, none = F.col("file_path"), F.array().cast("array<string>")
    some = lambda k, *names: F.when(F.col("doc_id") % k == 0, F.array(*[F.lit(n) for n in names])).otherwise(none)
    return files(spark, d).select("doc_id", P.enriched_text(p, P.layer(p), P.app_name(p), F.col("content"), F.col("lang"), some(2, "a", "b"), none, some(3, "c")).alias("t"))


@query(f"SELECT doc_id, file_path FROM {FILES_SQL} WHERE NOT regexp_matches(file_path, '(^|/)generated/|\\.toml$|(^|/)Makefile$') OR starts_with(file_path, 'src1/')")
def path_ignore(spark, d):
    from weftline.sources.files import IgnoreRules

    rules = IgnoreRules(["# build products", "generated/", "*.toml", "/Makefile", "Makefile", "!src1/**"])
    return files(spark, d).where(~rules.matches(F.col("file_path"))).select("doc_id", "file_path")
