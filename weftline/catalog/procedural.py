"""Operators that fold over a document or a key's rows; their SQL folds by recursion over lists of running totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog.standins import FILES_SQL, files, table
from weftline.functions import paths as P
from weftline.operators import chunking as C

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Words of x; entries of the running totals u that are at most v, and that are below v.
SQL_N = "len(regexp_extract_all({0}, '\\S+'))"
SQL_UPTO = "len(list_filter(u, lambda x: x <= {0}))"
SQL_BELOW = "len(list_filter(u, lambda x: x < {0}))"


def _totals(pieces: str, keys: str, source: str) -> str:
    """SQL of (keys, c, u, n): costs of the pieces in order, their running totals from 0 on, how many they are."""
    return f"(SELECT {keys}, list(k ORDER BY i) AS c, list_prepend(0, list(s ORDER BY i)) AS u, count(*) AS n FROM (SELECT *, sum(k) OVER (PARTITION BY {keys} ORDER BY i) AS s FROM (SELECT {keys}, {pieces}, i FROM {source})) GROUP BY ALL)"


LINES = "(SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE trim(text, concat(' ', chr(9), chr(10), chr(13))) <> ''))"
SPAN_END = f"least(greatest(b + 1, {SQL_UPTO.format('u[b + 1] + 200')} - 1), wall)"


@query(
    f"WITH RECURSIVE t AS (SELECT *, list_append(list_filter(range(n), lambda x: c[x + 1] > 200), n) AS walls FROM {_totals(SQL_N.format('line') + ' AS k', 'doc_id', LINES)}), "
    "step AS (SELECT doc_id, -1 AS part, 0::BIGINT AS b, 0::BIGINT AS e, 0::BIGINT AS pos FROM t UNION ALL "
    f"SELECT doc_id, part + 1, CASE WHEN wide THEN pos ELSE b END, CASE WHEN wide THEN pos + 1 ELSE {SPAN_END} END, CASE WHEN wide THEN pos + 1 ELSE {SPAN_END} END FROM ("
    f"SELECT doc_id, part, pos, c, u, n, wall, wall = pos AS wide, CASE WHEN part < 0 OR fresh THEN pos ELSE greatest(b0, {SQL_BELOW.format('u[pos + 1] - greatest(least(20, 200 - c[pos + 1]), 0)')}) END AS b FROM ("
    "SELECT step.doc_id, part, step.b AS b0, step.pos, c, u, n, list_min(list_filter(walls, lambda x: x >= step.pos)) AS wall, list_contains(walls, step.pos) OR list_contains(walls, step.b) AS fresh FROM step JOIN t USING (doc_id) WHERE step.pos < n))) "
    "SELECT doc_id, part, (b + 1)::INT AS line_start, e::INT AS line_end, (u[e + 1] - u[b + 1])::BIGINT AS tokens FROM step JOIN t USING (doc_id) WHERE part >= 0"
)
def chunk_lines(spark, d):
    """Runs of lines of at most 200 words; each begins with up to 20 words of lines of the one before."""
    return C.line_chunks(table(spark, d, "documents"), "doc_id", "text", most=200, overlap=20)


SEPARATORS = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(C.SEPARATORS)) + ") AS x(place, sep)"
PIECES = f"(SELECT doc_id, place, sep, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, place, sep, string_split(text, sep) AS ps FROM documents, {SEPARATORS} WHERE {SQL_N.format('text')} > 400))"


@query(
    f"WITH RECURSIVE f AS (SELECT * FROM {_totals(SQL_N.format('CASE WHEN i > 1 THEN concat(sep, piece) ELSE piece END') + ' AS k', 'doc_id, place, sep', PIECES)} WHERE n > 1 AND list_max(c) <= 400 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1), "
    f"step AS (SELECT doc_id, 0::BIGINT AS b, 0::BIGINT AS e FROM f UNION ALL SELECT doc_id, e, greatest(e + 1, {SQL_UPTO.format('u[e + 1] + 400')} - 1) FROM step JOIN f USING (doc_id) WHERE e < n), "
    "runs AS (SELECT doc_id, b, regexp_replace(list_reduce(string_split(text, sep)[b + 1:e], lambda x, y: concat(x, sep, y)), '^\\s+|\\s+$', '', 'g') AS content FROM step JOIN f USING (doc_id) JOIN documents USING (doc_id) WHERE e > 0) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1)::INT AS part, content FROM runs WHERE content <> '' "
    f"UNION ALL SELECT doc_id, 0, text FROM documents WHERE {SQL_N.format('text')} BETWEEN 1 AND 400"
)
def chunk_recursive(spark, d):
    """Whole documents of at most 400 words; others between the coarsest separator whose pieces all fit."""
    f = table(spark, d, "documents").withColumn("path", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")))
    return C.chunked(f, "path", "text", most=400, overlap=0, keep=("doc_id",)).select("doc_id", "part", "content")


@query(
    f"WITH RECURSIVE t AS (SELECT conv_id, list(turn ORDER BY turn, k) AS turns, list_prepend(0, list(s ORDER BY turn, k)) AS u, count(*) AS n FROM (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT conv_id, turn, {SQL_N.format('text')} AS k FROM conversations)) GROUP BY conv_id), "
    "step AS (SELECT conv_id, -1 AS batch, 0::BIGINT AS b, 0::BIGINT AS e FROM t UNION ALL SELECT conv_id, batch + 1, e0, CASE WHEN e1 < n AND u[e1 + 1] = u[e0 + 1] THEN e1 + 1 ELSE e1 END "
    f"FROM (SELECT conv_id, batch, e AS e0, u, n, {SQL_UPTO.format('u[e + 1] + 200')} - 1 AS e1 FROM step JOIN t USING (conv_id) WHERE e < n)) "
    "SELECT conv_id, unnest(turns[b + 1:e]) AS turn, batch::INT AS batch FROM step JOIN t USING (conv_id) WHERE batch >= 0"
)
def token_batches(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    return C.batched(rows, "conv_id", "turn", "n", 200)


HASH = f"sha1(unhex('{P.NAMESPACE.replace('-', '')}') || encode(concat(file_path, '::toplevel::', left(sha256(content), 12))))"


@query(
    "SELECT doc_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4 + 1), 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS point_id "
    f"FROM (SELECT doc_id, {HASH} AS h FROM {FILES_SQL})"
)
def uuid5(spark, d):
    f = files(spark, d)
    chunk = P.chunk_id(F.col("file_path"), F.lit("toplevel"), F.lit(""), F.col("content"))
    return f.select("doc_id", P.point_id(chunk).alias("point_id"))
