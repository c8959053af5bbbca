"""From a request to a response: routing, ranked lists, fusion, expansion, rerank, boost, demotion, confidence, grep, context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import paths as P
from weftline.functions import text as T
from weftline.operators import graph
from weftline.operators import grep as G
from weftline.operators import retrieval as R
from weftline.providers import RerankProvider

#: Modes; results of an enumeration; candidates, those kept by a reranker; results with context, merged grep lines.
MODES = ("semantic", "keyword", "exhaustive")
ENUMERATION, CANDIDATES, RERANKED, IN_CONTEXT, GREP_LINES = 200, 30, 10, 5, 100
#: Fixed value: a best score below this widens the search.
ENOUGH = 0.65


@dataclass
class SearchRequest:
    """One query. mode: None, semantic, keyword or exhaustive; active_file: the file at hand, whose module is preferred."""

    query: str
    limit: int = 10
    mode: str | None = None
    intent: str | None = None
    filters: dict[str, str] = field(default_factory=dict)
    active_file: str | None = None

    def __post_init__(self):
        if self.mode is not None and self.mode not in MODES:
            raise ValueError(f"no mode {self.mode!r}; there are {', '.join(MODES)}")


@dataclass(frozen=True)
class Prefetch:
    """One ranked list: which vector (or bm25), how many, of one module only."""

    using: str
    limit: int
    module: str | None = None


#: Gives the scored candidates (key, score) of a list; filters are applied before it is cut.
Lists = Callable[[Prefetch], DataFrame]
#: The lists that a search is widened to.
WIDE = (Prefetch("signature", 20), Prefetch("semantic", 20), Prefetch("body", 20), Prefetch("bm25", 30))


@dataclass
class SearchResponse:
    """results: ranked rows; the other fields say how they came about and how far to trust them."""

    results: DataFrame
    query_enhanced: str
    intent: str
    mode_used: str
    total_candidates: int
    confidence: float
    confidence_label: str
    suggestion: str
    reranked: bool
    top_score: float
    result_count: int


def routed(request: SearchRequest, intent: str) -> tuple[SearchRequest, str]:
    """Request and intent as the mode has them: keyword enumerates, semantic doesn't."""
    if request.mode == "keyword":
        return replace(request, limit=max(request.limit, ENUMERATION)), "enumeration"
    return request, "code" if request.mode == "semantic" and intent == "enumeration" else intent


def prefetches(intent: str, module: str = "") -> list[Prefetch]:
    """The lists by intent, with one of the active file's module."""
    if intent == "enumeration":
        return [Prefetch("bm25", ENUMERATION), Prefetch("semantic", 60)]
    using = "signature" if intent == "location" else "semantic"
    return [Prefetch(using, 30), Prefetch("bm25", 50 if intent == "location" else 30), *([Prefetch(using, 15, module)] if module else [])]


def fused(lists: Lists, plan: list[Prefetch] | tuple[Prefetch, ...], key: str, limit: int = CANDIDATES) -> DataFrame:
    """(key, score): reciprocal ranks of the lists' first, summed; the best `limit`."""
    return R.top(R.fused([R.top(lists(p), p.limit, key) for p in plan], key), limit, key).select(key, "score")


def expanded(first: DataFrame, wide: DataFrame, key: str, enough: float = ENOUGH) -> DataFrame:
    """first, and where its best score is below `enough` also wide, with the best score of each key. One plan, no action."""
    best = first.agg(F.max("score").alias("_best"))
    more = wide.crossJoin(F.broadcast(best)).where(F.col("_best") < enough).drop("_best")
    return R.merged_best([first, more], key)


def once(lists: Lists, key: str) -> Lists:
    """Each list scored once, whatever it is cut to afterwards: its first ENUMERATION rows are kept in memory."""
    memo: dict[tuple, DataFrame] = {}

    def ranked(p: Prefetch) -> DataFrame:
        if (p.using, p.module) not in memo:
            memo[p.using, p.module] = R.top(lists(p), ENUMERATION, key).select(key, "score").persist()
        return memo[p.using, p.module]

    return ranked


def candidates(lists: Lists, intent: str, key: str, module: str = "", limit: int = CANDIDATES) -> DataFrame:
    """(key, score) of the best `limit`, widened where even the first is unsure; only then the other lists are made."""
    lists = once(lists, key)
    first = fused(lists, prefetches(intent, module), key, limit).persist()
    best = first.agg(F.max("score")).first()[0]
    if best is None or best >= ENOUGH:
        return first
    return R.top(expanded(first, fused(lists, WIDE, key, limit), key), limit, key).select(key, "score")


def reranked(rows: DataFrame, query: str, reranker: RerankProvider | None, key: str, text: str = "content") -> DataFrame:
    """rows with reranked (true if they were) and, if so, the reranker's scores and only its best; rows are candidates, so few."""
    if reranker is None:
        return rows.withColumn("reranked", F.lit(False))
    head = rows.agg(F.count("*").alias("_n"), F.max("score").alias("_best")).select((~R.skips_rerank(F.col("_n"), F.col("_best"), F.lit(query))).alias("reranked"))
    new = reranker.rerank(rows, query, text).select(F.col(key).alias("_k"), F.col("score").alias("_new"))
    both = rows.crossJoin(F.broadcast(head)).join(F.broadcast(R.top(new.withColumnRenamed("_new", "score"), RERANKED, "_k").select("_k", F.col("score").alias("_new"))), F.col(key) == F.col("_k"), "left")
    kept = both.where(~F.col("reranked") | F.col("_new").isNotNull())
    return kept.withColumn("score", F.when(F.col("reranked"), F.round("_new", R.DIGITS)).otherwise(F.col("score"))).drop("_k", "_new")


def ranked(rows: DataFrame, intent: str, key: str, limit: int | None = 10) -> DataFrame:
    """rows (key, file_path, line_start, line_end, is_test, importance, score, ...) boosted, demoted, one of each range, with rank; the first `limit`."""
    score = R.demoted(R.boosted(F.col("score"), F.coalesce("importance", F.lit(0.0))), F.col("is_test"), intent)
    out = R.deduplicated(rows.withColumn("score", score), ("file_path", "line_start", "line_end"), key)
    return R.top(out, limit if limit is not None else 1 << 30, key)


def confidence(results: DataFrame) -> DataFrame:
    """One row: z, label, suggestion, result_count, top_score, reranked of ranked results, which their limit bounds."""
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    row = results.agg(scores.alias("s"), F.coalesce(F.max("reranked"), F.lit(False)).alias("reranked"))
    return row.select(R.confidence(F.col("s")).alias("c"), F.size("s").alias("result_count"), F.coalesce(F.get("s", F.lit(0)), F.lit(0.0)).alias("top_score"), "reranked").select("c.*", "result_count", "top_score", "reranked")


def with_grep(results: DataFrame, hits: DataFrame, most: int = GREP_LINES) -> DataFrame:
    """results and, behind them, the first `most` grepped lines that lie in none of their ranges (source tells which)."""
    more = G.uncovered(hits, results).orderBy("file_path", "line_number", "line_content").limit(most)
    lines = more.select("file_path", F.col("line_number").alias("line_start"), F.col("line_number").alias("line_end"), F.col("line_content").alias("content"), F.lit(0.0).alias("score"), F.lit("grep").alias("source"))
    return results.withColumn("source", F.lit("semantic")).unionByName(lines, allowMissingColumns=True)


def with_context(results: DataFrame, edges: DataFrame, key: str, most: int = IN_CONTEXT) -> DataFrame:
    """results, the first `most` of them with context: who uses them and what tests them."""
    return results.join(graph.context(results.where(F.col("rank") <= most), edges, key), key, "left")


def compact(results: DataFrame, full: bool = False) -> DataFrame:
    """What is shown of results: a snippet in place of the content, unless full."""
    have = set(results.columns)
    shown = [c for c in ("rank", "file_path", "line_start", "line_end", "score", "chunk_type", "language", "function_name", "class_name", "is_test", "importance", "enriched", "source", "context") if c in have]
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return results.select(*shown, P.snippet(text("signature"), text("docstring"), text("content")).alias("snippet"), *(["content"] if full else []))


def understood(spark, request: SearchRequest, abbreviations: dict[str, str] | None = None, synonyms: dict[str, list[str]] | None = None) -> tuple[str, str, list[str]]:
    """Enhanced query, intent of the query as given, patterns to grep for."""
    q = F.lit(request.query)
    more: Column = T.enhanced(q, abbreviations or {}, synonyms or {})
    row = spark.range(1).select(more.alias("q")).select("q", T.intent(q).alias("intent"), T.grep_patterns(F.col("q")).alias("patterns")).first()
    return row["q"], request.intent or row["intent"], list(row["patterns"])


def respond(
    request: SearchRequest, chunks: DataFrame, lists: Callable[[str, Column], Lists], key: str, files: DataFrame | None = None, edges: DataFrame | None = None,
    reranker: RerankProvider | None = None, terms: tuple[dict[str, str], dict[str, list[str]]] = ({}, {}),
) -> SearchResponse:
    """The whole search. chunks: key, file_path, line_start, line_end, content, is_test, importance and what filters name.

    lists: for an enhanced query and a filter on chunks, the ranked lists. Candidates, results and grep lines are bounded by their
    limits, so they are kept in memory and fetched where a number of them is asked for.
    """
    spark = chunks.sparkSession
    enhanced, intent, patterns = understood(spark, request, *terms)
    effective, intent = routed(request, intent)
    module = spark.range(1).select(P.app_name(F.lit(request.active_file))).first()[0] if request.active_file else ""
    keep = R.payload_filter(request.filters)
    found = candidates(lists(enhanced, keep), intent, key, module, max(CANDIDATES, effective.limit) if effective.mode == "keyword" else CANDIDATES)
    rows = chunks.join(F.broadcast(found), key).persist()  # as many as the candidates at most
    total = rows.count()
    if not total:
        return SearchResponse(rows.withColumn("rank", F.lit(0)).limit(0), enhanced, intent, "semantic", 0, 0.0, "low", "try_exhaustive", False, 0.0, 0)
    results = ranked(reranked(rows, enhanced, reranker, key), intent, key, effective.limit).persist()
    c = confidence(results).first()
    mode, count = "semantic", c["result_count"]
    if edges is not None:
        results = with_context(results, edges, key)
    if effective.mode == "exhaustive" and files is not None:
        mode = "exhaustive"
        if patterns:
            results = with_grep(results, G.grep(files, patterns)).persist()
            count = results.count()
    return SearchResponse(results, enhanced, intent, mode, total, c["z"], c["label"], c["suggestion"], c["reranked"], c["top_score"], count)
