"""The relationship graph, snapshots and merges, telemetry and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.catalog.basic import SQL_LANG
from weftline.catalog.standins import EDGES_SQL, FILES_SQL, PATH, edges, files, table
from weftline.api import file_summaries
from weftline.functions import paths as P
from weftline.operators import analytics as A
from weftline.operators import graph as H
from weftline.operators import incremental as I

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


E = f"WITH e AS {EDGES_SQL}"
KEYS = "source_entity, relationship, target_entity"
NATION = "geo/nations.py::NATION_3"


def _file(c: str) -> str:
    return f"string_split({c}, '::')[1]"


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("SELECT o_custkey::VARCHAR AS source_entity, o_orderstatus AS relationship, o_orderpriority AS target_entity, max(o_orderkey) AS seq FROM orders GROUP BY ALL")
def edge_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("source_entity"), F.col("o_orderstatus").alias("relationship"), F.col("o_orderpriority").alias("target_entity"), F.col("o_orderkey").alias("seq"))
    return H.upserted(o, "seq")


@query(f"{E} SELECT {KEYS}, 'outbound' AS direction FROM e WHERE source_entity = '{NATION}' UNION ALL SELECT {KEYS}, 'inbound' FROM e WHERE target_entity = '{NATION}'")
def edge_lookup(spark, d):
    return H.lookup(edges(spark, d), NATION).select("source_entity", "relationship", "target_entity", "direction")


@query(f"{E} SELECT {KEYS} FROM e WHERE relationship IN ('imports', 'inherits')")
def edge_type_in(spark, d):
    return edges(spark, d).where(F.col("relationship").isin("imports", "inherits"))


@query(f"{E} SELECT {KEYS}, 'outbound' AS direction FROM e WHERE source_entity LIKE 'geo/%' UNION ALL SELECT {KEYS}, 'inbound' FROM e WHERE target_entity LIKE 'geo/%'")
def union_directions(spark, d):
    e = edges(spark, d)
    out = e.where(F.col("source_entity").startswith("geo/")).withColumn("direction", F.lit("outbound"))
    return out.unionByName(e.where(F.col("target_entity").startswith("geo/")).withColumn("direction", F.lit("inbound")))


NATIONS = "(SELECT concat('geo/nations.py::', n_name) AS entity FROM nation WHERE n_regionkey = 1)"


def _nations(spark, d):
    return table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("geo/nations.py::"), "n_name").alias("entity"))


@query(f"{E} SELECT {KEYS}, 'outbound' AS direction FROM e WHERE source_entity IN (FROM {NATIONS}) UNION ALL SELECT {KEYS}, 'inbound' FROM e WHERE target_entity IN (FROM {NATIONS})")
def batch_hop(spark, d):
    return H.batch_hop(edges(spark, d), _nations(spark, d)).select("source_entity", "relationship", "target_entity", "direction")


@query(
    f"{E}, s AS (SELECT source_entity AS a, target_entity AS b, {KEYS} FROM e UNION ALL SELECT target_entity, source_entity, {KEYS} FROM e), "
    f"l0 AS (SELECT '{NATION}' AS n, 0 AS lv), l1 AS (SELECT n, min(lv) AS lv FROM (FROM l0 UNION ALL SELECT b, 1 FROM s JOIN l0 ON a = n) GROUP BY n), l2 AS (SELECT n, min(lv) AS lv FROM (FROM l1 UNION ALL SELECT b, 2 FROM s JOIN l1 ON a = n) GROUP BY n), "
    f"x AS (SELECT DISTINCT a, b, {KEYS}, lv + 1 AS d FROM s JOIN l2 ON a = n WHERE lv < 3), y AS (SELECT * FROM x QUALIFY d = min(d) OVER (PARTITION BY {KEYS})), "
    f"z AS (SELECT y.*, coalesce(f.lv < d, false) OR dense_rank() OVER (PARTITION BY b, d ORDER BY {KEYS}) > 1 AS again FROM y LEFT JOIN l2 f ON f.n = y.b) "
    f"SELECT {KEYS}, min(d)::INT AS depth, bool_and(again) AS cycle_detected FROM z GROUP BY {KEYS}"
)
def bfs_trace(spark, d):
    """Edges within three steps, each with its first depth and whether it led to what had been reached before."""
    start = spark.createDataFrame([(NATION,)], "entity string")
    return H.trace(edges(spark, d), start, "both", 3).select("source_entity", "relationship", "target_entity", "depth", "cycle_detected")


@query(f"{E} SELECT DISTINCT x AS entity FROM (SELECT source_entity AS x FROM e UNION ALL SELECT target_entity FROM e) WHERE lower(x) LIKE '%nation\\_2' ESCAPE '\\'")
def suffix_match(spark, d):
    e = edges(spark, d).select(F.explode(F.array("source_entity", "target_entity")).alias("entity")).distinct()
    return e.where(F.lower("entity").endswith("nation_2"))


LANGUAGE_OF = SQL_LANG.replace("file_path", _file("x"))
DEGREE = "(SELECT x AS entity, count(*) AS n FROM (SELECT source_entity AS x FROM e UNION ALL SELECT target_entity FROM e WHERE target_entity <> source_entity) GROUP BY x)"
RANKED = (
    f"{E}, ent AS (SELECT DISTINCT x FROM (SELECT source_entity AS x FROM e UNION ALL SELECT target_entity FROM e)), deg AS {DEGREE}, "
    "c AS (SELECT name, x FROM names JOIN ent ON ends_with(lower(x), lower(name))), "
    "r AS (SELECT name, arg_min(x, (x <> name, contains(x, 'generated/') OR contains(x, 'node_modules/') OR contains(x, '.d.ts'), -n, x)) AS entity FROM c JOIN deg ON entity = x GROUP BY name) "
)
NAMES = "(SELECT n_name AS name FROM nation UNION SELECT concat('Supplier', CAST(s_suppkey AS STRING)) FROM supplier UNION SELECT 'nowhere' UNION SELECT lower(r_name) FROM region UNION SELECT right(n_name, 1) FROM nation UNION SELECT right(n_name, 2) FROM nation)"


def _names(spark, d):
    n, s, r = (table(spark, d, t) for t in ("nation", "supplier", "region"))
    some = n.select(F.col("n_name").alias("name")).union(s.select(F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string")))).union(r.select(F.lower("r_name")))
    some = some.union(n.select(F.right("n_name", F.lit(1)))).union(n.select(F.right("n_name", F.lit(2))))
    return some.union(spark.createDataFrame([("nowhere",)], "name string")).distinct()


@query(RANKED.replace("names JOIN", f"{NAMES} JOIN") + f"SELECT name, coalesce(r.entity, name) AS entity FROM {NAMES} LEFT JOIN r USING (name)")
def resolve_entity(spark, d):
    return H.resolved(_names(spark, d), edges(spark, d))


CANDIDATES = "(SELECT r_name AS q, concat('geo/nations.py::', n_name) AS x FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'sales/customers.py::Customer9' FROM region WHERE r_regionkey = 1)"


def _candidates(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    own = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("q"), F.concat(F.lit("geo/nations.py::"), "n_name").alias("entity"))
    return own.union(r.where("r_regionkey = 1").select("r_name", F.lit("sales/customers.py::Customer9")))


@query(f"{E}, deg AS {DEGREE} SELECT q, arg_min(x, ({LANGUAGE_OF} <> 'python', -coalesce(n, 0), x)) AS entity FROM {CANDIDATES} LEFT JOIN deg ON deg.entity = x GROUP BY q")
def resolve_rank(spark, d):
    return H.ranked(_candidates(spark, d), edges(spark, d), "q", F.lit("python"))


@query(
    f"{E}, im AS (SELECT DISTINCT target_entity AS x, 1 AS linked FROM e WHERE source_entity = 'sales/customers.py::Customer1') "
    f"SELECT q, arg_min(x, (CASE WHEN regexp_extract({_file('x')}, '^(.*)/[^/]*$', 1) = 'sales' THEN 0 WHEN linked = 1 THEN 1 ELSE 2 END, x)) AS entity FROM {CANDIDATES} LEFT JOIN im USING (x) GROUP BY q"
)
def resolve_context(spark, d):
    """A candidate of the directory of the file at hand, else one that it imports, else the first by name."""
    return H.in_context(_candidates(spark, d), edges(spark, d), "q", "sales/customers.py::Customer1")


@query(f"{E} SELECT DISTINCT target_entity FROM e WHERE NOT contains(target_entity, '::') AND NOT contains(target_entity, '/')")
def bare_targets(spark, d):
    return H.bare_targets(edges(spark, d))


@query(f"{E} SELECT DISTINCT target_entity FROM e")
def distinct_targets(spark, d):
    return edges(spark, d).select("target_entity").distinct()


@query(
    f"{E}, sy AS (SELECT regexp_extract(source_entity, '[^:]*$') AS sym, count(DISTINCT source_entity) AS n, min(source_entity) AS f FROM e WHERE contains(source_entity, '::') GROUP BY ALL) "
    "SELECT DISTINCT source_entity, relationship, CASE WHEN NOT contains(target_entity, '::') AND NOT contains(target_entity, '/') THEN coalesce(f, target_entity) ELSE target_entity END AS target_entity FROM e LEFT JOIN sy ON sym = target_entity AND n = 1"
)
def target_rewrite(spark, d):
    return H.rewritten(edges(spark, d))


TARGETS = "(SELECT concat('geo.nations::', n_name) AS t FROM nation UNION SELECT concat('sales.customers::', n_name) FROM nation)"


@query(
    f"{E}, en AS (SELECT DISTINCT source_entity AS x FROM e), h AS (SELECT t, count(*) AS n, min(x) AS f FROM {TARGETS} JOIN en ON string_split(t, '::')[2] = string_split(x, '::')[2] AND contains(string_split(x, '::')[1], replace(string_split(t, '::')[1], '.', '/')) GROUP BY t) "
    f"SELECT t AS target, CASE WHEN n = 1 THEN f ELSE t END AS entity FROM {TARGETS} LEFT JOIN h USING (t)"
)
def module_resolve(spark, d):
    n = table(spark, d, "nation")
    t = n.select(F.concat(F.lit("geo.nations::"), "n_name").alias("target")).union(n.select(F.concat(F.lit("sales.customers::"), "n_name"))).distinct()
    return H.module_resolved(t, edges(spark, d).select(F.col("source_entity").alias("entity")))


@query(f"{E} SELECT entity, n FROM {DEGREE}")
def edge_degree(spark, d):
    return H.degrees(edges(spark, d))


IMPORTANCE = f"(SELECT f AS file_path, n / max(n) OVER () AS importance FROM (SELECT {_file('target_entity')} AS f, count(*)::DOUBLE AS n FROM e GROUP BY f))"


@query(f"{E} SELECT file_path, importance FROM {IMPORTANCE}")
def importance(spark, d):
    return H.importance(edges(spark, d))


@query(f"{E} SELECT DISTINCT {_file('source_entity')} AS file_path, coalesce(importance, 0) AS importance FROM e LEFT JOIN {IMPORTANCE} i ON i.file_path = {_file('source_entity')}")
def importance_join(spark, d):
    e = edges(spark, d)
    own = e.select(P.entity_file(F.col("source_entity")).alias("file_path")).distinct()
    return own.join(H.importance(e), "file_path", "left").select("file_path", F.coalesce("importance", F.lit(0.0)).alias("importance"))


SIDES = "(SELECT source_entity AS entity, CASE WHEN relationship = 'imports' THEN 'imports' ELSE 'calls' END AS side, regexp_extract(target_entity, '[^:]*$') AS other FROM e UNION ALL SELECT target_entity, 'callers', regexp_extract(source_entity, '[^:]*$') FROM e WHERE relationship <> 'imports')"
LISTS = ", ".join(f"coalesce(list_sort(list(DISTINCT other) FILTER (WHERE side = '{s}')), []) AS {s}" for s in ("callers", "calls", "imports"))


@query(f"{E} SELECT entity, {LISTS} FROM {SIDES} WHERE entity IN (FROM {NATIONS}) GROUP BY entity")
def entity_neighbors(spark, d):
    return H.neighbours(_nations(spark, d), edges(spark, d))


@query(f"{E} SELECT entity, callers[1:5] AS callers, calls[1:5] AS calls, imports[1:5] AS imports FROM (SELECT entity, {LISTS} FROM {SIDES} WHERE entity IN (FROM {NATIONS}) GROUP BY entity)")
def grouped_lists(spark, d):
    return H.neighbours(_nations(spark, d), edges(spark, d), 5)


@query(f"{E} SELECT entity, concat_ws(chr(10), entity, CASE WHEN len(callers) > 0 THEN concat('Called by: ', array_to_string(callers[1:5], ', ')) END, CASE WHEN len(calls) > 0 THEN concat('Calls: ', array_to_string(calls[1:5], ', ')) END) AS stub FROM (SELECT entity, {LISTS} FROM {SIDES} WHERE entity IN (FROM {NATIONS}) GROUP BY entity)")
def semantic_stub(spark, d):
    n = grouped_lists(spark, d)
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    return n.select("entity", P.joined(F.col("entity"), part("Called by: ", "callers"), part("Calls: ", "calls")).alias("stub"))


@query(f"SELECT doc_id, unnest(list_filter([concat(file_path, '::toplevel::', left(sha256(content), 12)), CASE WHEN doc_id % 2 = 0 THEN concat(file_path, '::f', CAST(doc_id AS STRING)) END], lambda x: x IS NOT NULL)) AS entity FROM {FILES_SQL}")
def entity_ids(spark, d):
    f = files(spark, d)
    name = F.when(F.col("doc_id") % 2 == 0, F.concat("file_path", F.lit("::f"), F.col("doc_id").cast("string")))
    chunk = P.chunk_id(F.col("file_path"), F.lit("toplevel"), F.lit(""), F.col("content"))
    return f.select("doc_id", F.explode(F.array_compact(F.array(chunk, name))).alias("entity"))


@query(
    f"{E}, h AS (SELECT relationship, unnest([target_entity, source_entity]) AS x FROM e WHERE source_entity IN (FROM {NATIONS}) OR target_entity IN (FROM {NATIONS})), "
    f"f AS (SELECT {_file('x')} AS file_path, arg_min(relationship, (x, relationship)) AS relationship, min(x) AS entity FROM h WHERE {_file('x')} <> 'geo/nations.py' GROUP BY ALL) SELECT file_path, relationship, entity FROM f ORDER BY file_path LIMIT 5"
)
def surface_related(spark, d):
    results = spark.createDataFrame([("geo/nations.py",)], "file_path string")
    return H.surfaced(results, _nations(spark, d), edges(spark, d))


PATTERNS = (("/api/orders/<int:pk>/"), ("/api/orders/"), ("/api/users/<str:name>/posts"), ("/api/"), ("/static"))
CALLS = "(SELECT DISTINCT CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN concat('/api/orders/', CAST(c_custkey AS STRING)) WHEN 1 THEN '/api/orders/' WHEN 2 THEN concat('/api/users/', c_mktsegment, '/posts/') WHEN 3 THEN concat('/api/x/', c_mktsegment) ELSE concat('/other/', c_mktsegment) END AS url FROM customer)"
PATTERN_SQL = "(VALUES " + ", ".join(f"({i}, '{p}', '^{p.rstrip('/')}$', '{p.split('<')[0].rstrip('/')}')" for i, p in enumerate(PATTERNS)).replace("<int:pk>$", "[^/]+$").replace("^/api/users/<str:name>/posts", "^/api/users/[^/]+/posts") + ") AS p(place, pattern, rx, st)"


@query(
    f"SELECT url, arg_min(pattern, (tier, place)) AS pattern, min(tier)::INT AS tier FROM (SELECT url, place, pattern, CASE WHEN rtrim(url, '/') = rtrim(pattern, '/') THEN 0 WHEN regexp_matches(rtrim(url, '/'), rx) THEN 1 WHEN st <> '' AND starts_with(rtrim(url, '/'), st) AND length(rtrim(url, '/')) > length(st) THEN 2 END AS tier FROM {CALLS}, {PATTERN_SQL}) WHERE tier IS NOT NULL GROUP BY url"
)
def url_match_tiered(spark, d):
    k, seg = F.col("c_custkey") % 5, F.col("c_mktsegment")
    url = F.when(k == 0, F.concat(F.lit("/api/orders/"), F.col("c_custkey").cast("string"))).when(k == 1, "/api/orders/").when(k == 2, F.concat(F.lit("/api/users/"), seg, F.lit("/posts/"))).when(k == 3, F.concat(F.lit("/api/x/"), seg)).otherwise(F.concat(F.lit("/other/"), seg))
    calls = table(spark, d, "customer").select(url.alias("url"))
    return H.urls_matched(calls, spark.createDataFrame(list(enumerate(PATTERNS)), "place int, pattern string"))


HEAD = "concat(CASE WHEN doc_id % 2 = 0 THEN '# c\n\n' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '\"\"\"Module text.\"\"\"\n' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN 'import os\n  from a import b\n' ELSE '' END, text)"
EITHER, QUOTES = '"' + "''", '"' * 3 + "|" + "'" * 6
HEAD_SQL = HEAD.replace("\n", "' || chr(10) || '")
PARTS = "(SELECT concat('f', CAST(doc_id AS STRING)) AS file_path, i, CASE i % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'section' END AS kind, concat(CASE i % 3 WHEN 0 THEN 'def g' WHEN 1 THEN 'class K' ELSE 'def s' END, CAST(i AS STRING), ':') AS content FROM documents, {0} WHERE doc_id % 4 = 0)"
PARTS_SQL = PARTS.format("(SELECT unnest(range(doc_id % 60)) AS i, doc_id AS own FROM documents) x").replace("WHERE doc_id % 4 = 0", "WHERE own = doc_id AND doc_id % 4 = 0")


@query(
    f"WITH f AS (SELECT concat('f', CAST(doc_id AS STRING)) AS file_path, list_transform(string_split({HEAD_SQL}, chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(13)))) AS ls FROM documents), "
    f"h AS (SELECT file_path, coalesce(list_filter(ls, lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '') AS first, list_filter(ls, lambda x: starts_with(x, 'import ') OR starts_with(x, 'from '))[1:20] AS im FROM f), "
    f"s AS (SELECT file_path, list(concat('#   ', rtrim(content, ':')) ORDER BY i) AS sg FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY i) AS n FROM {PARTS_SQL} WHERE kind <> 'section') WHERE n <= 30 GROUP BY file_path) "
    f"SELECT file_path, concat_ws(chr(10), concat('# File: ', file_path), CASE WHEN regexp_matches(first, '^({QUOTES})') AND trim(first, '{EITHER}') <> '' THEN concat('# ', trim(first, '{EITHER}')) END, CASE WHEN len(im) > 0 THEN concat('# Imports: ', array_to_string(im, ', ')) END, CASE WHEN len(sg) > 0 THEN concat('# Entities:', chr(10), array_to_string(sg, chr(10))) END) AS content "
    "FROM h LEFT JOIN s USING (file_path) WHERE len(im) > 0 OR len(sg) > 0"
)
def file_summary(spark, d):
    """Path, module docstring, imports and signatures of each file that has one of the last two."""
    t = table(spark, d, "documents")
    whole = t.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), F.expr(HEAD.replace("\n", "\\n")).alias("content"))
    i = F.col("line_start")
    kind = F.when(i % 3 == 0, "function").when(i % 3 == 1, "class").otherwise("section")
    parts = t.where("doc_id % 4 = 0 and doc_id % 60 > 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 60).cast("int") - 1)).alias("line_start"))
    chunks = parts.select("file_path", "line_start", F.lit(0).alias("part"), kind.alias("kind"), F.concat(F.when(i % 3 == 0, "def g").when(i % 3 == 1, "class K").otherwise("def s"), i.cast("string"), F.lit(":")).alias("content"))
    return file_summaries(whole, chunks)


OLD = "(SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'de')"
NEW = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(concat(text, '+')) ELSE sha256(text) END AS h FROM documents WHERE source <> 'src3')"


@query(f"SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change FROM {OLD} a FULL JOIN {NEW} b USING (doc_id)")
def change_hash(spark, d):
    t = table(spark, d, "documents")
    old = t.where("lang <> 'de'").select("doc_id", F.sha2("text", 256).alias("h"))
    new = t.where("source <> 'src3'").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")), 256).alias("h"))
    return I.changes(old, new, "doc_id", "h")


@query("SELECT doc_id, CASE left(s, 1) WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' WHEN 'D' THEN 'deleted' WHEN 'R' THEN 'added' END AS change, string_split(s, chr(9))[-1] AS path FROM (SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('A', chr(9), source) WHEN 1 THEN concat('M', chr(9), source) WHEN 2 THEN concat('D', chr(9), source) ELSE concat('R100', chr(9), source, chr(9), lang) END AS s FROM documents)")
def change_git(spark, d):
    k, tab = F.col("doc_id") % 4, F.lit("\t")
    line = F.when(k == 0, F.concat(F.lit("A"), tab, "source")).when(k == 1, F.concat(F.lit("M"), tab, "source")).when(k == 2, F.concat(F.lit("D"), tab, "source")).otherwise(F.concat(F.lit("R100"), tab, "source", tab, "lang"))
    return table(spark, d, "documents").select("doc_id", I.git_status(line).alias("g")).select("doc_id", "g.change", "g.path")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT doc_id, 9 FROM documents WHERE lang = 'fr'")
def upsert_merge(spark, d):
    new = table(spark, d, "documents").where("lang = 'fr'").select("doc_id", F.lit(9).alias("quality"))
    return I.upserted(table(spark, d, "labels").select("doc_id", "quality"), new, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_anti(spark, d):
    return I.deleted(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id, coalesce(quality, 0) + CASE WHEN f.doc_id IS NULL THEN 0 ELSE 1 END AS retry_count FROM labels FULL JOIN (SELECT doc_id FROM documents WHERE lang = 'de') f USING (doc_id)")
def merge_counter(spark, d):
    old = table(spark, d, "labels").select("doc_id", F.col("quality").alias("retry_count"))
    return I.counted(old, table(spark, d, "documents").where("lang = 'de'"), "doc_id")


@query("SELECT doc_id, coalesce(l.quality::VARCHAR, lang) AS value FROM documents LEFT JOIN labels l USING (doc_id)")
def cache_coalesce(spark, d):
    cache = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return I.cached_or(table(spark, d, "documents").select("doc_id", "lang"), cache, "doc_id", "value", F.col("lang")).select("doc_id", "value")


@query("SELECT coalesce(max(turn) FILTER (WHERE role = 'nobody'), -1) AS last_batch, coalesce(max(turn), -1) AS last_turn FROM conversations")
def max_or_default(spark, d):
    return table(spark, d, "conversations").agg(F.coalesce(F.max(F.when(F.col("role") == "nobody", F.col("turn"))), F.lit(-1)).alias("last_batch"), F.coalesce(F.max("turn"), F.lit(-1)).alias("last_turn"))


@query(f"SELECT file_path, unnest([concat(file_path, '::', CAST(doc_id AS STRING)), concat(file_path, '::', left(sha256(content), 12))]) AS chunk_id FROM {FILES_SQL}")
def explode_ids(spark, d):
    """The ids that each file's row holds, one to a row."""
    ids = F.array(F.concat_ws("::", "file_path", F.col("doc_id").cast("string")), F.concat_ws("::", "file_path", F.left(F.sha2("content", 256), F.lit(12))))
    return files(spark, d).select("file_path", F.explode(ids).alias("chunk_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"SELECT doc_id FROM {FILES_SQL} WHERE NOT regexp_matches(file_path, 'md$') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def enrich_todo(spark, d):
    done = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return files(spark, d).where(~F.col("file_path").endswith("md")).select("doc_id").join(done, "doc_id", "left_anti")


@query("SELECT collection, n, allowed, n > allowed AS refused FROM (SELECT coalesce(lang, '') AS collection, count(*) AS n, CASE coalesce(lang, '') WHEN 'en' THEN 300 WHEN 'de' THEN 100000 END AS allowed FROM documents GROUP BY ALL UNION ALL SELECT 'all', count(*), 900 FROM documents) WHERE allowed IS NOT NULL")
def limit_guard(spark, d):
    """Collections and the whole against their limits; what has none isn't refused."""
    limits = spark.createDataFrame([("en", 300), ("de", 100000), ("all", 900)], "collection string, allowed int")
    return I.guarded(table(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("collection")), limits)


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 25 + 1)::INT AS batch FROM conversations")
def batch_number(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.ceil(n / 25).cast("int").alias("batch"))


@query(f"SELECT lang, count(DISTINCT file_path) AS n FROM (SELECT lang, {PATH} AS file_path FROM documents) GROUP BY lang")
def distinct_files(spark, d):
    return files(spark, d).groupBy("lang").agg(F.count_distinct("file_path").alias("n"))


@query("SELECT event_type AS value, count(*) AS n, round(count(*) * 100::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM events GROUP BY event_type")
def distribution(spark, d):
    return A.distribution(table(spark, d, "events"), "event_type")


@query("SELECT round(avg(value), 6) AS mean, round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS mean_error FROM events")
def filtered_avg(spark, d):
    return table(spark, d, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(F.col("event_type") == "error", F.col("value"))), 6).alias("mean_error"))


@query("SELECT round(count(*) FILTER (WHERE role = 'assistant') / count(*), 6) AS share FROM conversations")
def share_if(spark, d):
    return table(spark, d, "conversations").agg(F.round(F.count_if(F.col("role") == "assistant") / F.count("*"), 6).alias("share"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 50) AS high, count(*) FILTER (WHERE value >= 10 AND value < 50) AS medium, count(*) FILTER (WHERE value < 10) AS low, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def category_pivot(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(v >= 50).alias("high"), F.count_if((v >= 10) & (v < 50)).alias("medium"), F.count_if(v < 10).alias("low"), F.round(F.avg("value"), 6).alias("mean"))


#: Ratings from labels: two scorers, or three for every third document.
RATINGS = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [quality * 2 + 1, toxic + 2, 5] WHEN doc_id % 3 = 1 THEN [quality * 3 + 1, toxic + 1] ELSE [quality + 1] END AS r FROM labels)"


def _ratings(spark, d):
    q, t, k = F.col("quality"), F.col("toxic"), F.col("doc_id") % 3
    return table(spark, d, "labels").select("doc_id", F.when(k == 0, F.array(q * 2 + 1, t + 2, F.lit(5))).when(k == 1, F.array(q * 3 + 1, t + 1)).otherwise(F.array(q + 1)).alias("r"))


@query(f"SELECT doc_id, CASE WHEN len(r) = 3 THEN list_sort(r)[2]::DOUBLE ELSE list_avg(r) END AS rating, len(r) >= 2 AND abs(r[1] - r[2]) > 1 AS disagree FROM {RATINGS}")
def scorer_avg(spark, d):
    r = F.col("r")
    apart = (F.size(r) >= 2) & (F.abs(F.get(r, F.lit(0)) - F.coalesce(F.get(r, F.lit(1)), F.lit(0))) > 1)
    return _ratings(spark, d).select("doc_id", A.scorer_average(r).alias("rating"), apart.alias("disagree"))


SIDE_A, SIDE_B = "(0.3::DOUBLE * quality + 0.25::DOUBLE * toxic + 0.2::DOUBLE * (doc_id % 5) + 0.15::DOUBLE * quality + 0.1::DOUBLE)", "(0.3::DOUBLE * toxic + 0.25::DOUBLE * quality + 0.2::DOUBLE * (doc_id % 3) + 0.15::DOUBLE * toxic + 0.1::DOUBLE)"
PAIRED = f"(SELECT doc_id, round({SIDE_A}, 6) AS a, round({SIDE_B}, 6) AS b, doc_id % 5 AS ca, doc_id % 3 AS cb FROM labels)"


def _paired(spark, d):
    q, t, one = F.col("quality"), F.col("toxic"), F.lit(1)
    a = A.weighted({"discovery": q, "precision": t, "completeness": F.col("doc_id") % 5, "relational": q, "confidence": one})
    b = A.weighted({"discovery": t, "precision": q, "completeness": F.col("doc_id") % 3, "relational": t, "confidence": one})
    return table(spark, d, "labels").select("doc_id", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), (F.col("doc_id") % 5).alias("ca"), (F.col("doc_id") % 3).alias("cb"))


WINNER = "CASE WHEN a > b THEN 'a' WHEN b > a THEN 'b' WHEN ca > cb THEN 'a' WHEN cb > ca THEN 'b' ELSE 'tie' END"


def _winner():
    return A.winner(F.col("a"), F.col("b"), F.col("ca"), F.col("cb"))


@query(f"SELECT doc_id, a, b FROM {PAIRED}")
def weighted_score(spark, d):
    return _paired(spark, d).select("doc_id", "a", "b")


@query(f"SELECT doc_id, {WINNER} AS winner FROM {PAIRED}")
def winner_case(spark, d):
    return _paired(spark, d).select("doc_id", _winner().alias("winner"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS label, CASE WHEN doc_id % 2 = 0 THEN a ELSE b END AS score FROM {PAIRED}")
def eval_unblind(spark, d):
    p = _paired(spark, d)
    labels = p.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("side"), F.when(F.col("doc_id") % 2 == 0, "alpha").otherwise("beta").alias("label"))
    scores = p.select("doc_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("score")), F.struct(F.lit("b").alias("side"), F.col("b").alias("score")))).alias("s")).select("doc_id", "s.side", "s.score")
    return labels.join(scores, ["doc_id", "side"]).select("doc_id", "label", "score")


RESULTS = f"(SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS track, a * 2.5::DOUBLE + 1.5::DOUBLE AS score, {WINNER} AS winner FROM {PAIRED})"
SIGNED = f"x AS (SELECT round(a - b, 9) AS d, a - b AS raw FROM {PAIRED}), r AS (SELECT d, avg(rn) OVER (PARTITION BY abs(d)) AS r FROM (SELECT d, row_number() OVER (ORDER BY abs(d)) AS rn FROM x WHERE d <> 0)), w AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS wm FROM r), ti AS (SELECT coalesce(sum(c * c * c - c), 0) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY abs(d))), mg AS (SELECT avg(raw) AS margin FROM x)"
TAIL = "(0.5 * (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-xx * xx))"
TESTED = f"{SIGNED}, z AS (SELECT n, wp, wm, margin, abs(least(wp, wm) - n * (n + 1) / 4::DOUBLE) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) / sqrt(2::DOUBLE) AS xx FROM w, ti, mg), zz AS (SELECT *, 1 / (1 + 0.3275911 * xx) AS t FROM z), pv AS (SELECT n, wp, wm, margin, CASE WHEN n >= 6 THEN CASE WHEN margin > 0 THEN {TAIL} ELSE 1 - {TAIL} END END AS p FROM zz)"
PASSES = "(coalesce(p, 1) < 0.10 OR margin > 0.20)"


@query(f"WITH {TESTED} SELECT n AS n_nonzero, wp AS w_plus, wm AS w_minus, round(margin, 6) AS margin, round(p, 5) AS p_value, {PASSES} AS passes FROM pv")
def wilcoxon_rank(spark, d):
    w = A.wilcoxon(_paired(spark, d), "a", "b")
    return w.select("n_nonzero", "w_plus", "w_minus", F.round("margin", 6).alias("margin"), F.round("p_value", 5).alias("p_value"), "passes")


def _verdict_sql(rate: str) -> str:
    first = "CASE WHEN o >= 3.66 AND wa + wb >= 7 AND ta >= 3.66 THEN 'Ship' WHEN o >= 3.30 AND wa + wb >= 6 THEN 'Iterate' ELSE 'Kill' END"
    return (
        f"(SELECT {rate}::DOUBLE AS rate, round(o, 6) AS overall, wa AS wins_a, wb AS wins_b, CASE WHEN {rate} NOT BETWEEN 0.05 AND 0.55 THEN 'Kill' WHEN {first} = 'Ship' AND NOT {PASSES} THEN 'Iterate' ELSE {first} END AS verdict "
        f"FROM (SELECT avg(score) AS o, avg(score) FILTER (WHERE track = 'A') AS ta, count(*) FILTER (WHERE track = 'A' AND winner = 'a') AS wa, count(*) FILTER (WHERE track = 'B' AND winner = 'a') AS wb FROM {RESULTS}), pv)"
    )


@query(f"WITH {TESTED} SELECT * FROM {_verdict_sql('0.2')} UNION ALL SELECT * FROM {_verdict_sql('0.6')} UNION ALL SELECT * FROM {_verdict_sql('0.04')}")
def verdict(spark, d):
    """By averages and wins, held back by the gate of the escalation rate and the paired test."""
    p = _paired(spark, d)
    results = p.select(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("track"), (F.col("a") * 2.5 + 1.5).alias("score"), _winner().alias("winner"))
    tested, out = A.wilcoxon(p, "a", "b"), None
    for rate in (0.2, 0.6, 0.04):
        one = A.verdict(results, F.lit(rate), tested).select(F.lit(rate).alias("rate"), F.round("overall", 6).alias("overall"), "wins_a", "wins_b", "verdict")
        out = one if out is None else out.unionByName(one)
    return out


SQL_CHANCE = "list_sum(list_transform(range({0}, 13), lambda k: factorial(12) / (factorial(k::INT) * factorial((12 - k)::INT)))) / 4096"


@query(f"SELECT n_nationkey, round({SQL_CHANCE.format('n_nationkey % 12')}, 6) AS p, abs(2 * (n_nationkey % 12) - 12)::INT AS win_margin, round(least(2 * ({SQL_CHANCE.format('(12 + abs(2 * (n_nationkey % 12) - 12)) // 2')}), 1) * 0.75, 4) AS p_noise, CASE WHEN least(2 * ({SQL_CHANCE.format('(12 + abs(2 * (n_nationkey % 12) - 12)) // 2')}), 1) * 0.75 > 0.30 THEN 'LOW CONFIDENCE' ELSE 'CONFIDENT' END AS flag FROM nation")
def binomial_noise(spark, d):
    wins = (F.col("n_nationkey") % 12).cast("int")
    return table(spark, d, "nation").select("n_nationkey", F.round(A.noise_probability(wins, F.lit(12)), 6).alias("p"), A.stability(wins, F.lit(12), 0.375).alias("s")).select("n_nationkey", "p", "s.*")


FOUND = "(SELECT lang AS query, concat(source, '/', CAST(doc_id % 97 AS STRING)) AS file_path, CASE WHEN doc_id % 3 = 0 OR lang = 'fr' AND doc_id % 7 < 5 THEN 'grep' ELSE 'semantic' END AS src FROM documents)"
SHARES = f"(SELECT query, sum(n) AS total, count(*) FILTER (WHERE alone) AS novel FROM (SELECT query, file_path, count(*) AS n, bool_and(src = 'grep') AS alone FROM {FOUND} GROUP BY ALL) GROUP BY query)"


def _found(spark, d):
    i = F.col("doc_id")
    grep = (i % 3 == 0) | ((F.col("lang") == "fr") & (i % 7 < 5))
    return table(spark, d, "documents").select(F.col("lang").alias("query"), F.concat("source", F.lit("/"), (i % 97).cast("string")).alias("file_path"), F.when(grep, "grep").otherwise("semantic").alias("source"))


@query(f"SELECT query, total::BIGINT AS total, novel, round(novel / total, 6) AS share FROM {SHARES}")
def marginal_contrib(spark, d):
    """Of each query's results the files that only grep found, over all results."""
    return A.marginal(_found(spark, d)).select("query", "total", "novel", F.round("share", 6).alias("share"))


@query(f"SELECT queries, round(mean, 6) AS mean, with_novel, CASE WHEN mean < 0.10 THEN 'mostly noise' WHEN mean > 0.50 THEN 'semantic incomplete' ELSE 'healthy range' END AS advisory FROM (SELECT count(*) AS queries, avg(novel / total) AS mean, avg(CASE WHEN novel > 0 THEN 100.0::DOUBLE ELSE 0 END) AS with_novel FROM {SHARES})")
def marginal_report(spark, d):
    return A.marginal_report(A.marginal(_found(spark, d))).select("queries", F.round("mean", 6).alias("mean"), "with_novel", "advisory")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_files(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


RATES = "(SELECT event_id % 11 AS k, avg(CASE WHEN value > (event_id % 11) * 20 THEN 1 ELSE 0 END) AS r FROM events GROUP BY ALL)"


@query(f"SELECT k, round(r, 6) AS rate, CASE WHEN r > 0.55 THEN 'ABOVE CEILING' WHEN r > 0.25 THEN 'ABOVE TARGET' WHEN r < 0.05 THEN 'BELOW FLOOR' WHEN r < 0.15 THEN 'BELOW TARGET' ELSE 'IN TARGET RANGE' END AS band, r BETWEEN 0.05 AND 0.55 AS gate FROM {RATES}")
def rate_band(spark, d):
    k = F.col("event_id") % 11
    g = table(spark, d, "events").groupBy(k.alias("k")).agg(F.avg(F.when(F.col("value") > k * 20, 1).otherwise(0)).alias("r"))
    return g.select("k", F.round("r", 6).alias("rate"), A.rate_band(F.col("r")).alias("band"), A.gate(F.col("r")).alias("gate"))


@query("SELECT doc_id, CASE WHEN ('0x' || left(md5(concat('42:', CAST(doc_id AS STRING))), 1))::INT < 8 THEN 'a' ELSE 'b' END AS alpha FROM documents")
def blinded(spark, d):
    return table(spark, d, "documents").select("doc_id", A.blinded(F.col("doc_id"), 42).alias("alpha"))


@query("SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents) s, (SELECT DISTINCT lang FROM documents) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND d.lang = l.lang)")
def missing_grid(spark, d):
    t = table(spark, d, "documents").select("source", "lang").distinct()
    # Few sources and languages: the grid of all is what is asked for.
    grid = t.select("source").distinct().crossJoin(F.broadcast(t.select("lang").distinct()))
    return grid.join(t, ["source", "lang"], "left_anti")


@query("SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_value(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"))


TOOL = "CASE CAST(turn % 6 AS INT) WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'Grep' WHEN 3 THEN 'Glob' WHEN 4 THEN 'Other' END"
ARGUMENTS = "CASE CAST(turn % 6 AS INT) WHEN 0 THEN concat('{\"command\": \"run ', CAST(turn AS STRING), '\"}') WHEN 1 THEN concat('{\"file_path\": \"a/', CAST(conv_id AS STRING), '\", \"offset\": 3', CASE WHEN conv_id % 2 = 0 THEN ', \"limit\": 9' ELSE '' END, '}') WHEN 2 THEN '{\"pattern\": \"x\", \"path\": \"src\"}' WHEN 3 THEN '{\"pattern\": \"*.py\"}' WHEN 4 THEN '{\"k\": 1}' END"
NL = "chr(10)"
SQL_CALL = (
    f"concat({NL}, '**[Tool Call ', CAST(n AS STRING), '] ', tool, ':**', CASE tool WHEN 'Bash' THEN concat({NL}, '```bash', {NL}, coalesce(args ->> '$.command', ''), {NL}, '```') "
    "WHEN 'Read' THEN concat(' `', args ->> '$.file_path', '` (offset=', args ->> '$.offset', coalesce(', limit=' || (args ->> '$.limit'), ''), ')') "
    "WHEN 'Grep' THEN concat(' pattern=`', args ->> '$.pattern', '` path=`', coalesce(args ->> '$.path', ''), '` mode=files_with_matches') WHEN 'Glob' THEN concat(' pattern=`', args ->> '$.pattern', '` path=`', coalesce(args ->> '$.path', ''), '`') ELSE concat(' ', args) END, chr(10))"
)


@query(
    f"SELECT conv_id, turn, concat(CASE WHEN role = 'assistant' THEN concat({NL}, '### Assistant', {NL}, {NL}, text, {NL}) ELSE concat({NL}, '**Tool Result:**', {NL}, '```', {NL}, CASE WHEN length(text) > 3000 THEN concat(left(text, 3000), {NL}, '... [truncated]') ELSE text END, {NL}, '```', {NL}) END, CASE WHEN called THEN {SQL_CALL} ELSE '' END) AS line, n::BIGINT AS calls "
    f"FROM (SELECT *, sum(CASE WHEN called THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, role, text, {TOOL} AS tool, {ARGUMENTS} AS args, role = 'assistant' AND {TOOL} IS NOT NULL AS called FROM conversations))"
)
def transcript(spark, d):
    """Readable messages: what was said, each call of a tool with its running number in the conversation, and results cut at 3,000 letters."""
    m = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.expr(TOOL).alias("tool"), F.expr(ARGUMENTS).alias("arguments"))
    return A.transcript(m, "conv_id", "turn").select("conv_id", "turn", "line", "calls")
