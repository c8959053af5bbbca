"""What a user calls: index, search, trace, context, explain, status, health."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import Config, LimitError
from weftline.functions import paths as P
from weftline.functions import text as T
from weftline.operators import chunking, extract, graph
from weftline.operators import grep as G
from weftline.operators import incremental as I
from weftline.operators import retrieval as R
from weftline.plans import search as S
from weftline.providers import CircuitBreaker, EmbeddingProvider, ExtractiveDescriber, HashingEmbedder, RerankProvider, reranker
from weftline.sources import files as sources
from weftline.sources import git
from weftline.sources.tables import Store, record, telemetry_row

#: Named vectors of a chunk, each of another text.
VECTORS = ("signature", "semantic", "body")


@dataclass
class Engine:
    """One corpus: its store, its settings, its models, the terms that queries are enhanced with."""

    spark: SparkSession
    root: str
    config: Config
    embedder: EmbeddingProvider
    reranker: RerankProvider | None = None
    terms: tuple[dict[str, str], dict[str, list[str]]] = ({}, {})
    breaker: CircuitBreaker = field(default_factory=CircuitBreaker)

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: Config | None = None, embedder: EmbeddingProvider | None = None) -> Engine:
        c = config or Config()
        out = cls(spark, root, c, embedder or HashingEmbedder(), reranker(c.search.reranker), T.terminology(c.search.terminology) if c.search.terminology else ({}, {}))
        out.store.migrate()
        return out

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root)

    def index(self, files: DataFrame | str, full: bool = False) -> DataFrame:
        """Indexes files (file_path, content) or a folder; only what changed unless full. Returns (file_path, change)."""
        c, store = self.config.index, self.store
        if isinstance(files, str):
            files = sources.discover(self.spark, files, c.extensions, sources.IgnoreRules(sources.ignore_patterns(files, c.ignore)), c.max_file_bytes)
        files = files.select("file_path", "content").dropDuplicates(["file_path"])
        if full:
            store.clear()
            store.migrate()
        digests = files.select("file_path", F.sha2("content", 256).alias("digest"))
        old = store.read("file_hashes") if store.exists("file_hashes") else digests.limit(0)
        store.overwrite("changes", I.changes(old, digests, "file_path", "digest"))
        changes = store.read("changes")
        todo = files.join(changes.where("change in ('added', 'modified')"), "file_path", "left_semi")
        moved = changes.where("change <> 'unchanged'").select("file_path")
        store.replace("files", todo, moved)
        held = store.read("files").join(changes.where("change in ('added', 'modified')"), "file_path", "left_semi")
        # Relationships of the whole corpus come before the texts that are made with them.
        store.replace("edges", extract.relationships(held).dropDuplicates(["file_path", *graph.KEY]), moved)
        edges = store.read("edges")
        routes = extract.routes(store.read("files"))
        api = api_edges(edges.where("relationship = 'calls_api'"), routes)
        store.overwrite("graph", graph.normalised(edges.unionByName(api).dropDuplicates(list(graph.KEY))))
        network = store.read("graph")
        store.overwrite("importance", graph.importance(network))
        chunks = self._chunks(held, network)
        self._guard(chunks, moved)
        store.replace("chunks", chunks, moved)
        for v in VECTORS:
            store.check_dimension(store.read("chunks"), f"vector_{v}", self.embedder.dimensions)
        new = store.read("chunks").join(moved, "file_path", "left_semi")
        postings = R.term_frequencies(new, "chunk_id", F.col("content")).join(new.select("chunk_id", "file_path"), "chunk_id")
        store.replace("postings", postings.select("file_path", "chunk_id", "idx", "tf"), moved, order="idx")
        store.overwrite("file_hashes", digests)
        return changes

    def _chunks(self, files: DataFrame, network: DataFrame) -> DataFrame:
        """Chunks with their metadata, three texts and vectors, and a summary of each file."""
        c, path = self.config.index, F.col("file_path")
        raw = chunking.chunked(files, most=c.chunk_tokens, overlap=c.overlap_tokens)
        raw = raw.unionByName(file_summaries(files, raw).select("file_path", F.lit(-1).alias("part"), F.lit("file_summary").alias("kind"), F.lit("file_summary").alias("name"), F.lit("").alias("docstring"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), "content"))
        parent = F.when(F.col("kind") == "class", F.col("name")).when(F.contains("name", F.lit(".")), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise("")
        named = P.chunk_id(path, F.when(F.col("kind") == "section", "toplevel").otherwise(F.col("kind")), F.col("name"), F.col("content"))
        out = raw.withColumn("chunk_id", named).withColumn("chunk_id", F.when(F.row_number().over(Window.partitionBy("chunk_id").orderBy("part")) == 1, F.col("chunk_id")).otherwise(F.concat_ws("#", "chunk_id", F.col("part").cast("string"))))
        out = out.withColumn("class_name", parent).withColumnRenamed("kind", "chunk_type").withColumns(
            {"point_id": P.point_id(F.col("chunk_id")), "language": P.language(path), "layer": P.layer(path), "app_name": P.app_name(path), "is_test": P.is_test(path),
             "function_name": F.when(F.col("chunk_type").isin("function", "method"), F.substring_index("name", ".", -1)).otherwise(""), "signature": P.signature(F.col("chunk_type"), F.col("content"))}
        )
        entity = F.concat(path, F.lit("::"), "name")
        about = graph.neighbours(out.select(entity.alias("entity")).distinct(), network, c.neighbours)
        out = out.withColumn("_e", entity).join(about.withColumnRenamed("entity", "_e"), "_e", "left").drop("_e")
        head = P.signature_text(F.col("chunk_id"), F.col("signature"), F.col("class_name"), F.col("app_name"), F.col("layer"))
        described = ExtractiveDescriber().columns(F.col("content"))
        rich = P.enriched_text(path, F.col("layer"), F.col("app_name"), described["description"], described["keywords"], F.col("callers"), F.col("calls"), F.col("imports"))
        texts = {"signature": head, "semantic": F.when(F.lit(c.enrich), rich).otherwise(P.semantic_stub(head, F.col("callers"), F.col("calls"), F.col("imports"))), "body": F.col("content")}
        return self._embedded(out.withColumn("enriched", F.lit(c.enrich)), texts).drop("callers", "calls", "imports")

    def _embedded(self, chunks: DataFrame, texts: dict[str, Column]) -> DataFrame:
        """chunks with a vector for each text. Texts that the cache knows by content and model are not embedded again."""
        store, model = self.store, F.col("model") == self.embedder.model_name
        store.overwrite("staging", chunks.withColumns({f"_text_{k}": v for k, v in texts.items()}))
        out = store.read("staging").withColumns({f"_hash_{k}": F.sha2(f"_text_{k}", 256) for k in texts})
        each = out.select(F.explode(F.array(*[F.struct(F.col(f"_hash_{k}").alias("content_hash"), F.col(f"_text_{k}").alias("text")) for k in texts])).alias("x")).select("x.*").dropDuplicates(["content_hash"])
        if store.exists("embeddings"):
            each = each.join(store.read("embeddings").where(model).select("content_hash"), "content_hash", "left_anti")
        store.append("embeddings", each.select("content_hash", F.lit(self.embedder.model_name).alias("model"), self.embedder.column(F.col("text")).alias("vector")))
        known = store.read("embeddings").where(model)
        for k in texts:
            out = out.join(known.select(F.col("content_hash").alias(f"_hash_{k}"), F.col("vector").alias(f"vector_{k}")), f"_hash_{k}", "left")
        return out.drop(*[f"_{x}_{k}" for k in texts for x in ("text", "hash")])

    def _guard(self, chunks: DataFrame, moved: DataFrame) -> None:
        """Refuses an index of more chunks than the settings allow, of all or of one collection (docs or code)."""
        c = self.config.index
        if c.max_chunks is None and not c.max_chunks_of:
            return
        kind = F.when(F.col("language") == "markdown", "docs").otherwise("code").alias("collection")
        kept = chunks.select(P.language(F.col("file_path")).alias("language"))
        if self.store.exists("chunks"):
            kept = kept.unionByName(self.store.read("chunks").join(moved, "file_path", "left_anti").select("language"))
        counts = {r[0]: r[1] for r in kept.groupBy(kind).count().collect()}
        limits = [("all", sum(counts.values()), c.max_chunks), *((k, counts.get(k, 0), n) for k, n in c.max_chunks_of.items())]
        for name, n, most in limits:
            if most is not None and n > most:
                raise LimitError(f"{n} chunks of {name}, at most {most} are allowed", "Raise the limit or leave files out")

    def lists(self, query: str, keep: Column) -> S.Lists:
        """The ranked lists of a query over the chunks that a filter keeps. Of the postings only the query's terms are read."""
        store = self.store
        chunks = store.read("chunks")
        some = chunks.where(keep)
        question = self.spark.range(1).select(F.lit(query).alias("text"), F.lit(0).alias("q"))
        wanted = R.term_frequencies(question, "q", F.col("text")).select("idx", F.col("tf").alias("q_tf"))
        terms = [r[0] for r in wanted.select("idx").collect()]  # those of one query
        numbers = [float(x) for x in self.embedder.embed([query])[0]]
        vector = F.array(*[F.lit(x) for x in numbers])

        def ranked(p: S.Prefetch) -> DataFrame:
            own = some if p.module is None else some.where(F.col("app_name") == p.module)
            if p.using == "bm25":
                postings = store.read("postings").where(F.col("idx").isin(*terms)) if terms else store.read("postings").limit(0)
                scores = R.sparse_scores(postings, wanted, R.idf(postings, chunks.count()), "chunk_id")
                return scores.join(own.select("chunk_id"), "chunk_id", "left_semi")
            return own.select("chunk_id", F.round(R.cosine(F.col(f"vector_{p.using}"), vector), R.DIGITS).alias("score")).where("score is not null")

        return ranked

    def respond(self, request: S.SearchRequest, telemetry: str | None = None) -> S.SearchResponse:
        """The whole search: results with confidence and context; noted as an event where a telemetry path is given."""
        store = self.store
        importance = store.read("importance") if store.exists("importance") else self.spark.createDataFrame([], "file_path string, importance double")
        chunks = store.read("chunks").drop(*[f"vector_{v}" for v in VECTORS]).join(importance, "file_path", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
        out = S.respond(request, chunks, self.lists, "chunk_id", store.read("files"), store.read("graph"), self.reranker, self.terms)
        if telemetry is not None:
            record(telemetry_row(self.spark, request.query, out.intent, out.mode_used, out.result_count, out.top_score, out.confidence, out.confidence_label, out.reranked), telemetry)
        return out

    def search(self, request: S.SearchRequest, full: bool = False) -> DataFrame:
        """Ranked results as they are shown."""
        return S.compact(self.respond(request).results, full)

    def trace(self, entity: str, direction: str = "both", max_depth: int = 2, types: tuple[str, ...] = ()) -> DataFrame:
        edges = self.store.read("graph")
        found = graph.resolved(self.spark.createDataFrame([(entity,)], "name string"), edges)
        return graph.trace(edges, found.select("entity"), direction, max_depth, types)

    def context(self, file_path: str, line_start: int, line_end: int) -> DataFrame:
        """The lines asked for, and files related to the file."""
        files = self.store.read("files").where(F.col("file_path") == file_path)
        ends = self.store.read("graph")
        own = self.store.read("chunks").where(F.col("file_path") == file_path)
        entities = graph.result_entities(own, "chunk_id").select("entity").distinct()
        related = graph.surfaced(files.select("file_path"), entities, ends).agg(F.array_sort(F.collect_list("file_path")).alias("related"))
        return files.select("file_path", G.line_range(F.col("content"), line_start, line_end).alias("content")).crossJoin(F.broadcast(related))

    def explain(self, entity: str, most: int = 5, shown: int = 3) -> DataFrame:
        """An entity in words: the chunks a search for it finds first, who uses it and what it uses."""
        edges = self.store.read("graph")
        found = graph.resolved(self.spark.createDataFrame([(entity,)], "name string"), edges).select("entity")
        n = graph.neighbours(found, edges, most)
        line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
        results = self.respond(S.SearchRequest(entity)).results.where(F.col("rank") <= shown)
        place = F.concat("file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(" ("), "chunk_type", F.lit(")"))
        about = F.concat_ws("\n", place, F.when(F.col("signature") != "", F.col("signature")), F.when(F.col("docstring") != "", T.shortened(F.col("docstring"), 300)))
        lines = results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", about.alias("t")))), lambda x: x["t"]), "\n").alias("shown"))
        own = found.join(n, "entity", "left").crossJoin(F.broadcast(lines))
        return own.select("entity", P.joined(F.col("entity"), F.col("shown"), line("Used by: ", "callers"), line("Depends on: ", "calls"), line("Imports: ", "imports")).alias("explanation"))

    def status(self) -> dict[str, int]:
        return {name: self.store.count(name) for name in ("chunks", "edges", "file_hashes")}

    def health(self, repository: str | None = None, last_commit: str | None = None) -> list[tuple[str, bool, str]]:
        """(check, passed, hint)."""
        store = self.store
        made = store.exists("chunks")
        checks = [
            ("settings", not self.config.problems(), "; ".join(self.config.problems())),
            ("store", store.version() > 0, "the store's folder can't be written"),
            ("index", made, "" if made else "index the corpus first"),
            ("embedder", len(self.embedder.embed(["probe"])[0]) == self.embedder.dimensions, "the embedder gives vectors of another length than it says"),
            ("dimension", not made or not store.read("chunks").where(F.size("vector_body") != self.embedder.dimensions).limit(1).count(), "index anew after a change of the embedder"),
            ("enrichment", not self.config.index.enrich or not made or not store.read("chunks").where("not enriched").limit(1).count(), "index anew to enrich all chunks"),
            ("calls", not self.breaker.is_open, "a model failed several times in a row; wait for the cool-down"),
        ]
        if repository is not None:
            stale = git.staleness(repository, last_commit)
            checks.append(("fresh", not stale.is_stale, f"{stale.commits_behind} commits behind" if stale.commits_behind >= 0 else "no commit of the last index is known"))
        return [(name, bool(ok), "" if ok else hint) for name, ok, hint in checks]


def api_edges(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Edges from callers of URLs to the views that answer them: file::view, or the routes' file where no view is named."""
    place = routes.withColumn("place", F.xxhash64("file_path", "place"))
    found = graph.urls_matched(calls.select(F.col("target_entity").alias("url")), place.select("place", "pattern"))
    first = routes.groupBy("pattern").agg(F.min(F.struct("file_path", "place", "view")).alias("r")).select("pattern", F.concat_ws("::", "r.file_path", F.when(F.col("r.view") != "", F.col("r.view"))).alias("_view"))
    hit = found.select(F.col("url").alias("target_entity"), "pattern").join(first, "pattern").drop("pattern")
    return calls.join(hit, "target_entity").select("source_entity", "relationship", F.col("_view").alias("target_entity"), "file_path", F.lit("inferred").alias("confidence"))


# Imports and signatures that a summary names at most.
IMPORTS_NAMED, SIGNATURES_NAMED = 20, 30


def file_summaries(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_path, content): path, module docstring, imports and signatures of each file that has one of the last two.

    chunks: file_path, kind, line_start, part, content. Signatures are ranked before they are gathered, so no list grows.
    """
    lines = F.transform(F.split("content", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    imports = F.slice(F.filter("_lines", lambda x: x.startswith("import ") | x.startswith("from ")), 1, IMPORTS_NAMED)
    # The first line that is neither blank nor a comment; a docstring may also follow comments.
    first = F.coalesce(F.get(F.filter("_lines", lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), F.lit(""))
    doc = F.when(first.rlike("^(\"\"\"|''')"), F.regexp_replace(first, "^[\"']+|[\"']+$", "")).otherwise("")
    heads = files.withColumn("_lines", lines).select("file_path", doc.alias("_doc"), imports.alias("_imports"))
    signed = chunks.select("file_path", "line_start", "part", P.signature(F.col("kind"), F.col("content")).alias("sig")).where((F.col("sig") != "") & F.col("kind").isin("function", "class", "method"))
    n = F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "part"))
    named = signed.withColumn("_n", n).where(F.col("_n") <= SIGNATURES_NAMED).groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "sig"))), lambda x: F.concat(F.lit("#   "), x["sig"])).alias("_sigs"))
    both = heads.join(named, "file_path", "left").withColumn("_sigs", F.coalesce("_sigs", F.array().cast("array<string>")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# File: "), "file_path"), F.when(F.col("_doc") != "", F.concat(F.lit("# "), "_doc")), F.when(F.size("_imports") > 0, F.concat(F.lit("# Imports: "), F.array_join("_imports", ", "))),
        F.when(F.size("_sigs") > 0, F.concat(F.lit("# Entities:\n"), F.array_join("_sigs", "\n"))),
    )
    return both.where((F.size("_imports") > 0) | (F.size("_sigs") > 0)).select("file_path", text.alias("content"))
