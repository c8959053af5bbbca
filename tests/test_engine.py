"""Golden cases of the operators on small inputs."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from weftline.api import Engine
from weftline.config import Config, ConfigError, IndexConfig, LimitError
from weftline.functions import paths as P
from weftline.functions import text as T
from weftline.operators import analytics, chunking, extract, graph, incremental
from weftline.operators import retrieval as R
from weftline.plans.search import SearchRequest
from weftline.providers import CircuitBreaker, HashingEmbedder
from weftline.sources import files as sources
from weftline.sources import git
from weftline.sources.files import IgnoreRules
from weftline.sources.registry import Registry
from weftline.sources.tables import VERSION, Store, VersionError, report, report_json


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "parts"),
    [("getUserById", ["get", "user", "by", "id"]), ("get_user_by_id", ["get", "user", "by", "id"]), ("PrescriptionFillOrder", ["prescription", "fill", "order"]), ("HTMLParser", ["html", "parser"]), ("CONSTANT", ["constant"]), ("__", ["__"])],
)
def test_identifiers(spark, name, parts):
    assert one(spark, T.parts_of(F.lit(name))) == parts


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("x = a + b"))) == [] and one(spark, T.all_tokens(F.lit("word"))) == ["word", "word"]
    assert one(spark, T.without_stop_words(F.array(*[F.lit(w) for w in "the of in to is word".split()]))) is None


@pytest.mark.parametrize(
    ("query", "kind"),
    [("fix the bug", "debug"), ("login not working", "debug"), ("why is it broken", "debug"), ("fix it", "code"), ("where is Order", "location"), ("what is a token?", "docs"), ("how tokens flow?", "docs"), ("OrderModel", "location"), ("get_user", "location"), ("", "code"), ("WHERE IS x", "location"), ("parse the tree", "code")],
)
def test_intents(spark, query, kind):
    assert one(spark, T.intent(F.lit(query))) == kind


SCORES = [1.0, 0.7, 0.5, 0.45, 0.40, 0.38, 0.37, 0.36, 0.35, 0.34]


@pytest.mark.parametrize(
    ("scores", "label", "hint", "z"),
    [
        (SCORES, "high", "none", 1.556), ([0.1 * s for s in SCORES], "high", "none", 1.556), ([1.0, 0.92, 0.86, 0.80, 0.74, 0.68, 0.62, 0.56, 0.50, 0.44], "medium", "try_keyword", None),
        ([1.0, 0.98, 0.96, 0.94, 0.92, 0.85, 0.75, 0.65, 0.55, 0.45], "low", "try_exhaustive", None), ([], "low", "try_exhaustive", 0), ([1.0, 0.5], "low", "try_exhaustive", 0), ([0.0] * 4, "low", "try_exhaustive", 0), ([1.0] * 5, "low", "try_exhaustive", 0),
    ],
)
def test_confidence(spark, scores, label, hint, z):
    got = one(spark, R.confidence(F.array(*[F.lit(s) for s in scores]).cast("array<double>")))
    assert (got["label"], got["suggestion"]) == (label, hint)
    assert z is None or abs(got["z"] - z) < 1e-3


def test_paths(spark):
    for text in ("a/b.py::function::f", "", "é漢"):
        assert one(spark, P.point_id(F.lit(text))) == str(uuid.uuid5(uuid.UUID(P.NAMESPACE), text))
    layer = lambda p: one(spark, P.layer(F.lit(p)))
    assert [layer(p) for p in ("a/models.py", "tests/models.py", "a/B.tsx", "a/b.py", "a/.tsx")] == ["model", "test", "component", "other", "other"]
    assert one(spark, P.app_name(F.lit("b/care/models.py"))) == "care" and one(spark, P.app_name(F.lit("models.py"))) == ""
    assert one(spark, P.bare_symbol(F.lit("a::b::c"))) == "b::c" and one(spark, P.bare_symbol(F.lit("a"))) is None


def edges_of(spark, *pairs):
    return spark.createDataFrame([(a, r, b) for a, r, b in pairs], "source_entity string, relationship string, target_entity string")


def walk(spark, edges, start, direction, depth, types=()):
    return sorted((r["source_entity"], r["target_entity"], r["depth"]) for r in graph.trace(edges, spark.createDataFrame([(start,)], "entity string"), direction, depth, types).collect())


def test_traces(spark):
    chain = edges_of(spark, ("A", "calls", "B"), ("B", "calls", "C"), ("C", "imports", "D"))
    assert walk(spark, chain, "A", "outbound", 1) == [("A", "B", 1)]
    assert walk(spark, chain, "A", "outbound", 5) == [("A", "B", 1), ("B", "C", 2), ("C", "D", 3)]
    assert walk(spark, chain, "A", "outbound", 3, ["imports"]) == []
    assert len(walk(spark, edges_of(spark, ("A", "calls", "B"), ("B", "calls", "A")), "A", "outbound", 5)) == 2
    assert len(walk(spark, edges_of(spark, ("A", "calls", "C"), ("B", "calls", "C")), "C", "inbound", 1)) == 2
    diamond = edges_of(spark, ("A", "calls", "B"), ("A", "calls", "C"), ("B", "calls", "D"), ("C", "calls", "D"))
    got = graph.trace(diamond, spark.createDataFrame([("A",)], "entity string"), "outbound", 2).collect()
    assert len(got) == 4 and sum(r["cycle_detected"] for r in got) == 1


def resolve(spark, edges, name, language=None):
    return graph.resolved(spark.createDataFrame([(name,)], "name string"), edges, language).first()["entity"]


def test_resolution(spark):
    e = edges_of(spark, ("/r/a.py::Foo", "calls", "z"), ("gen/generated/b.py::Bar", "calls", "z"), ("src/b.py::Bar", "calls", "z"), ("x.ts::Baz", "calls", "q"), ("x.ts::Baz", "calls", "r"), ("y.py::Baz", "calls", "q"))
    assert resolve(spark, e, "a.py::Foo") == "/r/a.py::Foo" and resolve(spark, e, "Foo") == "/r/a.py::Foo"
    assert resolve(spark, e, "none such") == "none such" and resolve(spark, e, "Bar") == "src/b.py::Bar"
    assert resolve(spark, e, "z") == "z" and resolve(spark, e, "az") == "x.ts::Baz"
    assert graph.resolved(spark.createDataFrame([("Bar",)], "name string"), e, context_file="src/x.py").first()["entity"] == "src/b.py::Bar"
    assert resolve(spark, e, "Baz") == "x.ts::Baz" and resolve(spark, e, "Baz", F.lit("python")) == "y.py::Baz"


def test_lookup_falls_back_to_the_bare_symbol(spark):
    e = edges_of(spark, ("y", "calls", "helper"))
    assert graph.lookup(e, "x/a.py::helper", "inbound").count() == 1 and graph.lookup(e, "x/a.py::helper", "inbound", bare_fallback=False).count() == 0


def test_normalised_targets_stay_unique(spark):
    e = edges_of(spark, ("a.py::f", "calls", "g"), ("a.py::f", "calls", "b.py::g"), ("b.py::g", "calls", "h"))
    assert sorted(map(tuple, graph.rewritten(e).collect())) == [("a.py::f", "calls", "b.py::g"), ("b.py::g", "calls", "h")]


def test_importance(spark):
    e = edges_of(spark, *[(f"s{i}", "calls", f"core.py::f{i}") for i in range(4)], ("s", "imports", "util.py"))
    assert {r["file_path"]: r["importance"] for r in graph.importance(e).collect()} == {"core.py": 1.0, "util.py": 0.25}


def test_fusion_and_steps(spark):
    lists = [spark.createDataFrame(x, "k int, rank long") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)])]
    got = {r["k"]: r["score"] for r in R.fused(lists, "k").collect()}
    assert got == {r["k"]: r["score"] for r in R.fused(lists[::-1], "k").collect()} and got[2] == max(got.values())
    s = one(spark, R.demoted(R.boosted(F.lit(0.9), F.lit(0.8)), F.lit(True), "code"))
    assert abs(s - 0.9 * 1.2 * 0.8) < 1e-12 and abs(one(spark, R.boosted(F.lit(0.8), F.lit(1.0))) - 1.0) < 1e-12
    with pytest.raises(R.InvalidFilterError):
        R.payload_filter({"colour": "red"})


def test_chunks_cover_every_line(spark):
    text = "\n".join(f"line {i} with some words" for i in range(100))
    parts = chunking.line_split(text, 40)
    assert "\n".join(parts) == text and all(chunking.count_words(p) <= 40 for p in parts)
    assert all(chunking.count_words(p) <= 40 for p in chunking.line_split(text, 40, 10))
    assert chunking.word_split("a b c d e", 2) == ["a b", "c d", "e"] and chunking.line_split("x " * 100, 30)[0].count("x") == 30
    assert all(chunking.count_words(p) <= 60 for p in chunking.recursive_split(text.replace("line 5", "\n\nline 5"), 60, 5))
    assert chunking.token_batches([50, 60, 10, 200, 5], 100) == [0, 1, 1, 2, 3]


SOURCE = "import os\nfrom a.b import c as d\n\n\nclass M(BaseModel):\n    owner = models.ForeignKey('User')\n\n    def save(self):\n        '''Doc.'''\n        d()\n        self.x()\n\n\n@wrap\ndef f():\n    return M()\n"


def test_python_sources():
    kinds = [(e["kind"], e["qualified"]) for e in chunking.python_entities(SOURCE)]
    assert kinds == [("class", "M"), ("function", "save"), ("method", "M.save"), ("function", "f")]
    edges = set(extract.python_edges("m.py", SOURCE))
    assert {("m.py", "imports", "os"), ("m.py", "imports", "a.b::c"), ("m.py::M", "inherits", "BaseModel"), ("m.py::M", "has_fk", "User"), ("m.py::M", "contains", "m.py::M.save"), ("m.py::M.save", "calls", "a.b::c"), ("m.py::f", "decorates", "wrap"), ("m.py::f", "calls", "m.py::M")} <= edges
    assert chunking.python_entities("def (") == [] and extract.python_edges("x.py", "def (") == []
    assert not any(e[1] == "has_fk" for e in extract.python_edges("m.py", SOURCE.replace("BaseModel", "Base")))
    assert extract.test_edges("tests/test_m.py", [("tests/test_m.py", "imports", "m::f")]) == [("tests/test_m.py", "tests", "m::f")]
    assert extract.url_patterns("a/urls.py", "urlpatterns = [path('x/<int:pk>/', views.show, name='n')]") == [("/x/<int:pk>/", "views.show", "n", "")]
    assert extract.url_patterns("urls.py", "path('api/', include('api.urls'))\nre_path('/x', V.as_view())") == [("/api/", "", "", "api.urls"), ("/x", "V.as_view", "", "")]


@pytest.mark.parametrize("source", ["x " * 10 + "-" * 100_000 + "1", "(" * 100_000, "f" + ".a" * 50_000 + "()", "x = " + "+".join(["a()"] * 30_000), "x\0y"])
def test_sources_that_do_not_parse_or_nest_deeply(spark, source):
    assert chunking.python_entities(source) == [] and extract.url_patterns("urls.py", source) == []
    assert set(extract.python_edges("a.py", source)) <= {("a.py", "calls", "a"), ("a.py", "calls", "f" + ".a" * 50_000)}
    got = chunking.chunked(spark.createDataFrame([("a.py", source)], "file_path string, content string"), most=100_000).collect()
    assert [r["kind"] for r in got] == ["section"] and got[0]["content"].split() == source.split()


def test_splits_are_linear_and_greedy():
    rng = random.Random(3)
    for _ in range(200):
        lines = [" ".join(["w"] * rng.choice([0, 0, 1, 2, 3, 9])) for _ in range(rng.randint(1, 30))]
        most, overlap = rng.randint(2, 8), rng.randint(0, 4)
        spans = chunking.line_spans(lines, most, overlap)
        n = lambda a, b: sum(len(x.split()) for x in lines[a:b])
        assert spans[0][0] == 0 and spans[-1][1] == len(lines) and all(x[1] < y[1] and x[0] <= y[0] <= x[1] for x, y in zip(spans, spans[1:]))
        for (a, b), after in zip(spans, [*spans[1:], None]):
            assert n(a, b) <= most or b == a + 1
            assert b == len(lines) or n(a, b + 1) > most  # nothing more would have fitted
            if after and after[0] < b:
                assert n(after[0], b) <= overlap
        assert "\n".join(chunking.line_split("\n".join(lines), most)).split() == " ".join(lines).split()
    assert chunking.word_split("a\tb c  d", 2) == ["a\tb", "c  d"]
    assert len(chunking.word_split("w " * 300_000, 1000)) == 301 - 1


def test_script_entities():
    source = "import x from 'y'\nexport class A extends B {\n  go() { return '}' } // }\n}\nconst f = (a) => {\n  return `{`\n}\nfunction g() {}\nconst n = 1\n"
    got = [(e["kind"], e["qualified"], e["line_start"], e["line_end"]) for e in chunking.script_entities(source)]
    assert got == [("class", "A", 2, 4), ("function", "f", 5, 7), ("function", "g", 8, 8)]


def test_tokens_of_a_file_of_merges():
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    assert chunking.Tokens(path)("hello world") == 2
    assert all(chunking.Tokens(path)(c) <= 20 for c in chunking.recursive_split("some words of a text\n" * 50, 20, count=chunking.Tokens(path)))


def test_script_sources():
    edges = set(extract.script_edges("src/a.ts", "import x from './b'\nclass A extends B {}\nfunction go() { fetch(`/api/${id}/`); run() }\nconst V = () => <Panel a={1} />\n"))
    assert {("src/a.ts", "imports", "src/b"), ("src/a.ts::A", "inherits", "B"), ("src/a.ts::go", "calls_api", "/api/<str:arg>/"), ("src/a.ts::go", "calls", "run"), ("src/a.ts::V", "renders", "Panel")} <= edges


def test_rules_patterns_and_snapshots(spark):
    rules = IgnoreRules(["build/", "*.log", "/top.txt", "!keep.log"])
    ignored = lambda p: one(spark, rules.matches(F.lit(p)))
    assert [ignored(p) for p in ("a/build/x", "x.log", "top.txt", "a/top.txt", "a/keep.log", "builder/x")] == [True, True, True, False, False, False]
    assert one(spark, T.grep_patterns(F.lit("find the UserModel url"))) == T.FRAMEWORK_PATTERNS["url"] + T.FRAMEWORK_PATTERNS["model"] + ["UserModel"]
    old, new = (spark.createDataFrame(x, "k int, h string") for x in ([(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "x"), (4, "d")]))
    assert dict(map(tuple, incremental.changes(old, new, "k", "h").collect())) == {1: "unchanged", 2: "modified", 3: "deleted", 4: "added"}
    up = incremental.upserted(old, new, "k")
    assert sorted(map(tuple, up.collect())) == sorted(map(tuple, incremental.upserted(up, new, "k").collect()))


def test_statistics(spark):
    assert abs(one(spark, analytics.noise_probability(F.lit(7), F.lit(12))) - 0.387207) < 1e-6
    got = analytics.wilcoxon(spark.createDataFrame([(3.0, 1.0), (1.0, 3.0), (5.0, 1.0), (1.0, 1.0)], "a double, b double"), "a", "b").first()
    assert (got["n_nonzero"], got["w_plus"], got["w_minus"]) == (3, 4.5, 1.5)
    with pytest.raises(ConfigError):
        Config.from_dict({"search": {"limit": 0}})
    now = [0.0]
    breaker = CircuitBreaker(2, 10, lambda: now[0])
    breaker.record(False)
    breaker.record(False)
    assert breaker.is_open
    now[0] = 10
    assert not breaker.is_open


FILES = [
    ("a/m.py", SOURCE), ("a/readme.md", "How orders are kept\n\nOrders are rows."), ("b/api.ts", "function load() { return fetch('/api/x/7') }"),
    ("b/urls.py", "urlpatterns = [path('api/x/<int:pk>', views.show)]"), ("tests/test_m.py", "from a.m import f\n\n\ndef test_f():\n    f()\n"), ("a/many.py", "\n\n".join(f"def keeper{i}():\n    return 'ledger {i}'" for i in range(6))),
    ("a/odd.py", "x " * 10 + "-" * 100_000 + "1"), ("a/blank.py", "  "),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = Engine.open(spark, str(tmp_path_factory.mktemp("store")), embedder=HashingEmbedder(16))
    files = spark.createDataFrame(FILES, "file_path string, content string")
    assert {r["change"] for r in out.index(files).collect()} == {"added"}
    return out


def test_index_and_search(spark, engine, tmp_path):
    assert engine.search(SearchRequest("orders kept")).first()["file_path"] == "a/readme.md"
    # Each range of a file is a result of its own.
    own = [r for r in engine.search(SearchRequest("ledger keeper", limit=20), full=True).collect() if r["file_path"] == "a/many.py" and r["chunk_type"] == "function"]
    assert len(own) == 6 and len({r["line_start"] for r in own}) == 6 and "ledger" in own[0]["content"]
    only = engine.search(SearchRequest("ledger keeper", filters={"language": "markdown"})).collect()
    assert only and {r["file_path"] for r in only} == {"a/readme.md"}
    with pytest.raises(R.InvalidFilterError):
        engine.search(SearchRequest("x", filters={"colour": "red"}))
    with pytest.raises(ValueError):
        SearchRequest("x", mode="loud")
    assert engine.trace("M.save", "outbound", 1).count() == 1 and all(ok for _, ok, _ in engine.health())
    assert {r[0]: r[1] for r in engine.context("a/m.py", 5, 6).select("file_path", "content").collect()} == {"a/m.py": "\n".join(SOURCE.split("\n")[4:6])}
    text = engine.explain("m.py::M").first()["explanation"]
    assert "Used by: " in text and "class M(BaseModel)" in text


def test_response(engine, tmp_path):
    events = str(tmp_path / "events")
    out = engine.respond(SearchRequest("where is keeper0", mode="exhaustive"), events)
    assert (out.intent, out.mode_used) == ("location", "exhaustive") and out.confidence_label in ("high", "medium", "low") and out.total_candidates > 0
    rows = out.results.collect()
    lines = [r for r in rows if r["source"] == "grep"]
    ranges = [(r["file_path"], r["line_start"], r["line_end"]) for r in rows if r["source"] == "semantic"]
    assert all(not any(f == g["file_path"] and a <= g["line_start"] <= b for f, a, b in ranges) for g in lines)
    event = engine.spark.read.json(events).first()
    assert event["mode_used"] == "exhaustive" and len(event["query_hash"]) == 64 and event["result_count"] == len(rows)
    f = {r["function_name"]: r["context"] for r in engine.respond(SearchRequest("f return M")).results.collect() if r["file_path"] == "a/m.py" and r["rank"] <= 5}
    assert any(c and "Tests: " in c for c in f.values())
    none = engine.respond(SearchRequest("anything", filters={"app_name": "nowhere"}))
    assert (none.result_count, none.suggestion, none.results.count()) == (0, "try_exhaustive", 0)
    wide = engine.respond(SearchRequest("ledger", mode="keyword"))
    assert wide.intent == "enumeration" and wide.result_count > 6


def test_index_keeps_relations_summaries_and_postings(engine):
    e = {(r["source_entity"], r["relationship"], r["target_entity"]) for r in engine.store.read("graph").collect()}
    assert ("b/api.ts::load", "calls_api", "b/urls.py::views.show") in e and ("tests/test_m.py", "tests", "a/m.py::f") in e and ("a/m.py::f", "calls", "a/m.py::M") in e
    chunks = engine.store.read("chunks")
    summary = chunks.where("chunk_type = 'file_summary' and file_path = 'a/m.py'").first()["content"]
    assert summary == "# File: a/m.py\n# Imports: import os, from a.b import c as d\n# Entities:\n#   class M(BaseModel)\n#   def save(self)\n#   def save(self)\n#   def f()"
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    assert chunks.where("file_path = 'a/odd.py'").first()["chunk_type"] == "section" and chunks.where("file_path = 'a/blank.py'").count() == 0
    postings = engine.store.read("postings")
    words = chunks.select("chunk_id", F.size(T.all_tokens(F.col("content"))).alias("n")).agg(F.sum("n")).first()[0]
    assert postings.agg(F.sum("tf")).first()[0] == words


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    engine = Engine.open(spark, str(tmp_path / "s"), embedder=HashingEmbedder(8))
    files = spark.createDataFrame([(f"d/f{i}.py", f"def f{i}():\n    return g{i}()") for i in range(40)], "file_path string, content string")
    engine.index(files)
    before = engine.store._manifest("chunks", 1)["buckets"]
    changed = files.withColumn("content", F.when(F.col("file_path") == "d/f3.py", "def other():\n    return 1").otherwise(F.col("content"))).where("file_path <> 'd/f5.py'")
    assert {r["file_path"]: r["change"] for r in engine.index(changed).where("change <> 'unchanged'").collect()} == {"d/f3.py": "modified", "d/f5.py": "deleted"}
    after = engine.store._manifest("chunks", 2)["buckets"]
    assert sum(before[b] != after.get(b) for b in before) <= 2
    names = {r["name"] for r in engine.store.read("chunks").where("chunk_type = 'function'").collect()}
    assert names == {f"f{i}" for i in range(40)} - {"f3", "f5"} | {"other"}
    assert engine.status()["file_hashes"] == 39
    vectors = engine.store.read("embeddings")
    known = vectors.count()
    assert known == vectors.select("content_hash").distinct().count() > 39
    engine.index(changed, full=True)  # caches stay, so nothing is embedded anew
    assert engine.store.read("embeddings").count() == known and engine.store.read("chunks").where("vector_body is null").count() == 0
    with pytest.raises(LimitError):
        Engine.open(spark, str(tmp_path / "t"), Config(index=IndexConfig(max_chunks=5)), HashingEmbedder(8)).index(files)


def test_store_bookkeeping(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.migrate() == VERSION == store.version()
    ran = []
    assert store.migrate({VERSION: lambda s: ran.append(1), VERSION + 1: lambda s: ran.append(2), VERSION + 2: lambda s: ran.append(3)}, VERSION + 2) == VERSION + 2 and ran == [2, 3]
    with pytest.raises(VersionError):
        store.migrate()
    fail = lambda *names: spark.createDataFrame([(n, "bad") for n in names], "file_path string, error string")
    store.record_failures(fail("a", "b"), "2024-01-01")
    store.record_failures(fail("b"), "2024-01-02")
    assert [(r["file_path"], r["retry_count"]) for r in store.failed_files().collect()] == [("b", 2), ("a", 1)]
    assert list(report(spark.range(1500).toDF("n"), "R"))[-1] == "| 1499 |" and len(list(report_json(spark.range(1200)))) == 1200


def test_registry_git_and_ignore_sources(spark, tmp_path, monkeypatch):
    import subprocess

    r = Registry(str(tmp_path / "x" / "projects.json"))
    assert r.find("a") is None and not r.unregister("a")
    r.register("a", str(tmp_path / "work" / "alpha"), "s1")
    r.register("alpha", "/other/place", "s2")
    assert r.find("alpha")["store"] == "s2" and r.find(str(tmp_path / "work" / "alpha"))["name"] == "a" and r.find("place")["name"] == "alpha"
    assert r.unregister("a") and [p["name"] for p in r.list()] == ["alpha"]

    root = tmp_path / "repo"
    root.mkdir()
    assert git.listed(str(tmp_path / "none")) is None and git.staleness(str(tmp_path / "none"), None).commits_behind == -1
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "a.py").write_text("x = 1")
    (root / ".gitignore").write_text("*.log\n")
    (root / "b.log").write_text("no")
    run("add", ".")
    run("commit", "-qm", "one")
    first = git.current_commit(str(root))
    assert git.listed(str(root)) == [".gitignore", "a.py"] and not git.staleness(str(root), first).is_stale and not git.merging(str(root))
    (root / "c.py").write_text("y = 2")
    run("add", ".")
    run("commit", "-qm", "two")
    assert git.staleness(str(root), first).commits_behind == 1
    changes = git.changed(spark, str(root), first)
    files = spark.createDataFrame([("a.py",), ("c.py",)], "file_path string")
    assert sorted(map(tuple, git.selected(files, changes).collect())) == [("a.py", "unchanged"), ("c.py", "added")]
    assert git.known(spark.createDataFrame([("a.py",), ("b.log",)], "file_path string"), str(root)).count() == 1

    (root / ".codesearchignore").write_text("# own\nc.py\n")
    monkeypatch.setenv(sources.ENVIRONMENT, "d/, e/")
    got = sources.ignore_patterns(str(root), ["s/"])
    assert got == [*sources.DEFAULT_IGNORES, "*.log", "c.py", "s/", "d/", "e/"]
    found = sources.discover(spark, str(root), ["py", "LOG"], sources.IgnoreRules(got)).collect()
    assert [f["file_path"] for f in found] == ["a.py"]
    assert sources.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}


def test_pattern_columns(spark):
    got = one(spark, T.grep_patterns(F.lit("fix get_user and the OrderModel of path"), F.array(F.lit("a.b"), F.lit("the"), F.lit(None).cast("string"))))
    assert got == [r"class\s+\w+\(.*Model\)", r"models\.\w+Field", "get_user", "OrderModel", "path", r"a\.b"]
    few = graph.urls_matched(spark.createDataFrame([("/a/7/b/",), ("/a/7/8/b",), ("/a/zz",), ("/no",), ("/q.x/1",)], "url string"), spark.createDataFrame([(0, "/a/<int:k>/b"), (1, "/a/"), (2, "/a/<int:k>/<str:s>/b/"), (3, "/q.x/<int:n>"), (4, "/qqx/<int:n>")], "place int, pattern string"))
    assert {r["url"]: (r["pattern"], r["tier"]) for r in few.collect()} == {"/a/7/b/": ("/a/<int:k>/b", 1), "/a/7/8/b": ("/a/<int:k>/<str:s>/b/", 1), "/a/zz": ("/a/<int:k>/b", 2), "/q.x/1": ("/q.x/<int:n>", 1)}


def test_table_functions(spark):
    from weftline.functions import udtf

    udtf.register(spark)
    spark.createDataFrame(FILES, "file_path string, content string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.file_path, c.kind, c.name FROM some_files f, LATERAL code_chunks(f.file_path, f.content) c").collect()
    assert ("a/m.py", "method", "M.save") in {tuple(r) for r in got} and not any(r["file_path"] == "a/blank.py" for r in got)
    edges = spark.sql("SELECT c.* FROM some_files f, LATERAL code_edges(f.file_path, f.content) c").collect()
    assert sorted(tuple(r)[:3] for r in edges) == sorted(tuple(r)[:3] for r in extract.relationships(spark.table("some_files")).collect())


def test_command_line(spark, tmp_path, capsys):
    import json

    from weftline.__main__ import main

    root = tmp_path / "work" / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "m.py").write_text(SOURCE)
    (root / "pkg" / "big.py").write_bytes(b"x = 1\n\xff")
    (root / "build").mkdir()
    (root / "build" / "no.py").write_text("y = 1")
    own = ["--store", str(tmp_path / "store"), "--registry", str(tmp_path / "projects.json")]

    def call(*args):
        code = main([*own, *args])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert call("index", str(root)) == (0, [{"change": "added", "count": 2}])
    assert call("index", str(root)) == (0, [{"change": "unchanged", "count": 2}])
    head, *found = call("search", "save the model", "--filter", "language=python")[1]
    assert head["intent"] == "code" and found and {f["file_path"] for f in found} <= {"pkg/m.py", "pkg/big.py"} and "content" not in found[0]
    assert call("trace", "M.save", "--direction", "outbound", "--depth", "1")[1] and call("status")[1][0]["file_hashes"] == 2
    assert call("projects")[1][0]["name"] == "proj" and call("doctor")[0] == 0 and "Used by" in call("explain", "m.py::M")[1][0]["explanation"]
    assert sources.failures(spark, str(root), ["py"]).select("error").distinct().collect()[0]["error"] == "not UTF-8: mended"


def test_streamed_files_replace_their_chunks(spark, tmp_path):
    from weftline.streaming.ingest import ingest, stream_files

    store, inbox = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    schema = "file_path string, content string"
    spark.createDataFrame([("a.md", "one two"), ("b.py", "x " * 10 + "-" * 100_000 + "1")], schema).write.mode("append").parquet(inbox)
    ingest(stream_files(spark, inbox, schema), store, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("a.md", "three")], schema).write.mode("append").parquet(inbox)
    ingest(stream_files(spark, inbox, schema), store, str(tmp_path / "c")).awaitTermination()
    got = {r["file_path"]: r["content"][:5] for r in store.read("chunks").collect()}
    assert got == {"a.md": "three", "b.py": "x x x"}


def test_evaluation_rules(spark):
    pairs = lambda d: spark.createDataFrame([(float(x), 0.0) for x in d], "a double, b double")
    w = analytics.wilcoxon(pairs([1, 2, 3, 4, 5, 6, -0.5, 7]), "a", "b").first()
    assert (w["w_plus"], w["w_minus"]) == (35.0, 1.0) and abs(w["p_value"] - 0.00865) < 2e-4 and w["passes"]  # z = 17 / sqrt(51)
    few = analytics.wilcoxon(pairs([0.3, 0.2]), "a", "b").first()
    assert few["p_value"] is None and few["passes"] and not analytics.wilcoxon(pairs([0.1, 0.2]), "a", "b").first()["passes"]
    assert analytics.wilcoxon(pairs([]), "a", "b").first()["n_nonzero"] == 0
    bands = [one(spark, analytics.rate_band(F.lit(x))) for x in (0.0, 0.1, 0.2, 0.3, 0.6)]
    assert bands == ["BELOW FLOOR", "BELOW TARGET", "IN TARGET RANGE", "ABOVE TARGET", "ABOVE CEILING"]
    results = spark.createDataFrame([("A", 4.0, "a")] * 7 + [("B", 4.0, "b")], "track string, score double, winner string")
    tested = lambda ok: spark.createDataFrame([(ok,)], "passes boolean")
    say = lambda **k: analytics.verdict(results, **k).first()["verdict"]
    assert (say(), say(tested=tested(False)), say(rate=F.lit(0.9)), say(rate=F.lit(0.2), tested=tested(True))) == ("Ship", "Iterate", "Kill", "Ship")
    assert one(spark, analytics.stability(F.lit(7), F.lit(12), 0.5))["flag"] == "LOW CONFIDENCE" and one(spark, analytics.stability(F.lit(12), F.lit(12), 0.5))["flag"] == "CONFIDENT"
