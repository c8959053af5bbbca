"""Entities and relationships of sources that are generated from documents' numbers, so that SQL can say what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.api import api_edges
from weftline.catalog.standins import table
from weftline.operators import chunking as C
from weftline.operators import extract as X

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _n(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


#: A module, a script, a test and routes for each document: path and content, in both dialects but for line breaks.
MODULE = (
    f"concat('app', {_n('doc_id % 9')}, '/m', {_n('doc_id')}, '.py')",
    f"concat('import os', {_n('doc_id % 5')}, '\nfrom pkg', {_n('doc_id % 3')}, '.mod import thing', {_n('doc_id % 7')}, ' as t\n\n\nclass M', {_n('doc_id')}, '(Base', {_n('doc_id % 4')}, 'Model):\n    owner = models.ForeignKey(\"User', {_n('doc_id % 6')}, "
    f"'\")\n    peer = OneToOneField(\"self\")\n\n    def run(self):\n        \"\"\"Doc ', {_n('doc_id')}, '.\"\"\"\n        t()\n        self.x()\n        return helper(1)\n\n\n@wrap', {_n('doc_id % 2')}, '\ndef helper(n):\n    return M', {_n('doc_id')}, '()\n')",
)
SCRIPT = (
    f"concat('src/s', {_n('doc_id')}, '.ts')",
    f"concat('import x from \"./b', {_n('doc_id % 3')}, '\"\nclass A', {_n('doc_id')}, ' extends B', {_n('doc_id % 2')}, ' {{}}\nfunction go', {_n('doc_id')}, '() {{ fetch(\"/api/item/', {_n('doc_id % 50')}, '/\"); run() }}\nconst V', {_n('doc_id')}, ' = () => <Panel a={{1}} />\n')".replace("{{", "{").replace("}}", "}"),
)
TEST = (f"concat('tests/test_', {_n('doc_id')}, '.py')", f"concat('from pkg import f', {_n('doc_id % 8')}, '\nimport a', {_n('doc_id % 4')}, '\n')")
ROUTES = (
    f"concat('p', {_n('doc_id % 10')}, '/urls.py')",
    f"concat('urlpatterns = [\n    path(\"api/item/<int:pk>/\", views.show', {_n('doc_id % 10')}, ', name=\"n', {_n('doc_id % 10')}, '\"),\n    path(\"sub', {_n('doc_id % 10')}, '/\", include(\"app.urls\")),\n    re_path(\"/x', {_n('doc_id % 10')}, '\", V.as_view()),\n]\n')",
)


def _files(spark, d, kind, where="true"):
    path, content = (F.expr(x.replace("\n", "\\n")) for x in kind)
    return table(spark, d, "documents").where(where).select("doc_id", path.alias("file_path"), content.alias("content"))


def _edges(kind, *edges: tuple[str, str, str]) -> str:
    rows = ", ".join(f"{{'s': {s}, 'r': '{r}', 't': {t}}}" for s, r, t in edges)
    return f"SELECT DISTINCT e.s AS source_entity, e.r AS relationship, e.t AS target_entity, p AS file_path FROM (SELECT p, unnest([{rows}]) AS e FROM (SELECT doc_id, {kind[0]} AS p FROM documents))"


MODEL, RUN, HELPER = f"concat(p, '::M', {_n('doc_id')})", f"concat(p, '::M', {_n('doc_id')}, '.run')", "concat(p, '::helper')"
THING = f"concat('pkg', {_n('doc_id % 3')}, '.mod::thing', {_n('doc_id % 7')})"
KEYS = ("source_entity", "relationship", "target_entity", "file_path")


@query(
    _edges(
        MODULE, ("p", "imports", f"concat('os', {_n('doc_id % 5')})"), ("p", "imports", THING), (MODEL, "inherits", f"concat('Base', {_n('doc_id % 4')}, 'Model')"), (MODEL, "has_fk", f"concat('User', {_n('doc_id % 6')})"),
        (MODEL, "has_o2o", f"concat('M', {_n('doc_id')})"), (MODEL, "contains", RUN), (RUN, "calls", THING), (RUN, "calls", HELPER), (HELPER, "decorates", f"concat('wrap', {_n('doc_id % 2')})"), (HELPER, "calls", MODEL),
    )
)
def extract_python(spark, d):
    """Imports, inheritance, model fields, containment, calls and decorators of modules."""
    return X.relationships(_files(spark, d, MODULE)).select(*KEYS)


SCRIPT_EDGES = (
    ("p", "imports", f"concat('src/b', {_n('doc_id % 3')})"), (f"concat(p, '::A', {_n('doc_id')})", "inherits", f"concat('B', {_n('doc_id % 2')})"), (f"concat(p, '::go', {_n('doc_id')})", "calls_api", f"concat('/api/item/', {_n('doc_id % 50')}, '/')"),
    (f"concat(p, '::go', {_n('doc_id')})", "calls", "'run'"), (f"concat(p, '::V', {_n('doc_id')})", "renders", "'Panel'"),
)


@query(_edges(SCRIPT, *SCRIPT_EDGES))
def extract_script(spark, d):
    """Imports, inheritance, calls of URLs and functions, and rendered components of scripts."""
    return X.relationships(_files(spark, d, SCRIPT)).select(*KEYS)


@query(_edges(TEST, *((s, r, t) for r in ("imports", "tests") for s, t in (("p", f"concat('pkg::f', {_n('doc_id % 8')})"), ("p", f"concat('a', {_n('doc_id % 4')})")))))
def extract_tests(spark, d):
    """What a test file imports, it tests."""
    return X.relationships(_files(spark, d, TEST)).select(*KEYS)


K = _n("doc_id")
ROUTE_ROWS = f"[{{'i': 0, 'pattern': '/api/item/<int:pk>/', 'view': concat('views.show', {K}), 'name': concat('n', {K}), 'include': ''}}, {{'i': 1, 'pattern': concat('/sub', {K}, '/'), 'view': '', 'name': '', 'include': 'app.urls'}}, {{'i': 2, 'pattern': concat('/x', {K}), 'view': 'V.as_view', 'name': '', 'include': ''}}]"


@query(f"SELECT concat('p', {K}, '/urls.py') AS file_path, r.i::INT AS place, r.pattern AS pattern, r.view AS view, r.name AS name, r.include AS include FROM (SELECT doc_id, unnest({ROUTE_ROWS}) AS r FROM (SELECT DISTINCT doc_id % 10 AS doc_id FROM documents))")
def extract_routes(spark, d):
    """Patterns of routes with their views, names and what they include, in order."""
    return X.routes(_files(spark, d, ROUTES).dropDuplicates(["file_path"]))


@query(f"SELECT concat('src/s', {K}, '.ts::go', {K}) AS source_entity, 'calls_api' AS relationship, 'p0/urls.py::views.show0' AS target_entity FROM documents")
def api_boundary(spark, d):
    """Calls of URLs linked to the view whose route matches; of routes alike the first by file."""
    calls = X.relationships(_files(spark, d, SCRIPT)).where("relationship = 'calls_api'")
    return api_edges(calls, X.routes(_files(spark, d, ROUTES).dropDuplicates(["file_path"]))).select(*KEYS[:3])


@query(
    f"SELECT doc_id, e.k AS kind, e.q AS qualified, e.a AS line_start, e.b AS line_end, e.d AS docstring FROM (SELECT doc_id, unnest([{{'k': 'class', 'q': concat('M', {K}), 'a': 5, 'b': 13, 'd': ''}}, {{'k': 'method', 'q': concat('M', {K}, '.run'), 'a': 9, 'b': 13, 'd': concat('Doc ', {K}, '.')}}, "
    f"{{'k': 'function', 'q': 'run', 'a': 9, 'b': 13, 'd': concat('Doc ', {K}, '.')}}, {{'k': 'function', 'q': 'helper', 'a': 17, 'b': 18, 'd': ''}}]) AS e FROM documents) "
    f"UNION ALL SELECT doc_id, e.k, e.q, e.a, e.a, '' FROM (SELECT doc_id, unnest([{{'k': 'class', 'q': concat('A', {K}), 'a': 2}}, {{'k': 'function', 'q': concat('go', {K}), 'a': 3}}, {{'k': 'function', 'q': concat('V', {K}), 'a': 4}}]) AS e FROM documents)"
)
def source_entities(spark, d):
    """Classes, methods (as functions too) and functions, with lines and docstrings; of scripts by patterns."""
    return C.entities(_files(spark, d, MODULE).unionByName(_files(spark, d, SCRIPT)), "doc_id")


@query(
    "WITH RECURSIVE t AS (SELECT doc_id, list(w ORDER BY i) AS ws, list_prepend(0, list(s ORDER BY i)) AS u, count(*) AS n FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT doc_id, w, i, len(regexp_extract_all(w, '\\S+')) AS k FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE regexp_matches(text, '\\S'))))) GROUP BY doc_id), "
    "step AS (SELECT doc_id, -1 AS part, 0::BIGINT AS b, 0::BIGINT AS e FROM t UNION ALL SELECT doc_id, part + 1, e, greatest(e + 1, len(list_filter(u, lambda x: x <= u[e + 1] + 120)) - 1) FROM step JOIN t USING (doc_id) WHERE e < n) "
    "SELECT doc_id, part, array_to_string(ws[b + 1:e], ' ') AS content FROM step JOIN t USING (doc_id) WHERE part >= 0"
)
def chunk_words(spark, d):
    """Runs of at most 120 words of whole documents, cut at blanks."""
    return C.word_chunks(table(spark, d, "documents"), "doc_id", "text", most=120)
