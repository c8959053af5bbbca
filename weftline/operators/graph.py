"""The typed relationship graph: lookups, resolution, bounded traversal, importance, target normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import paths as P

KEY = ("source_entity", "relationship", "target_entity")


def upserted(edges: DataFrame, order: str) -> DataFrame:
    """The last row of each (source, relationship, target)."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(order))
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup(edges: DataFrame, entity: str, direction: str = "both", types: Sequence[str] = (), bare_fallback: bool = True) -> DataFrame:
    """Edges at an entity; a direction without any falls back to the bare symbol behind the first ::."""
    some = edges.where(F.col("relationship").isin(*types)) if types else edges
    bare = entity.split("::", 1)[1] if bare_fallback and "::" in entity else None
    out = None
    for side, column in (("outbound", "source_entity"), ("inbound", "target_entity")):
        if direction not in ("both", side):
            continue
        own = some.where(F.col(column) == entity)
        if bare is not None:
            exact = own.limit(1).agg(F.count("*").alias("_exact"))
            own = own.unionByName(some.where(F.col(column) == bare).crossJoin(F.broadcast(exact)).where("_exact = 0").drop("_exact"))
        own = own.withColumn("direction", F.lit(side))
        out = own if out is None else out.unionByName(own)
    return out


def batch_hop(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """One hop from a set of entities (column entity), both directions; an edge inside the set comes twice."""
    out = edges.join(entities.select(F.col("entity").alias("source_entity")).distinct(), "source_entity", "left_semi").withColumn("direction", F.lit("outbound"))
    back = edges.join(entities.select(F.col("entity").alias("target_entity")).distinct(), "target_entity", "left_semi").withColumn("direction", F.lit("inbound"))
    return out.unionByName(back)


def trace(edges: DataFrame, start: DataFrame, direction: str = "both", max_depth: int = 2, types: Sequence[str] = ()) -> DataFrame:
    """Edges reached breadth-first from start (column entity), each once with its first depth; depth is held in 1 to 5.

    cycle_detected: the far end had been reached before, at an earlier level or by an earlier edge of this one. What a level has
    found is checkpointed where the session has a checkpoint folder, so that no level is computed twice; depth is bounded.
    """
    kept = edges.sparkSession.sparkContext.getCheckpointDir() is not None
    depth = min(5, max(1, max_depth))
    some = (edges.where(F.col("relationship").isin(*types)) if types else edges).select(*KEY)
    ends = []
    if direction in ("both", "outbound"):
        ends.append(some.select(F.col("source_entity").alias("near"), F.col("target_entity").alias("far"), *KEY))
    if direction in ("both", "inbound"):
        ends.append(some.select(F.col("target_entity").alias("near"), F.col("source_entity").alias("far"), *KEY))
    steps = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    visited = start.select(F.col("entity").alias("node"), F.lit(0).alias("level")).distinct()
    frontier, found = visited, None
    for d in range(1, depth + 1):
        reached = steps.join(frontier.select(F.col("node").alias("near")), "near")
        if found is not None:
            reached = reached.join(found.select(*KEY), list(KEY), "left_anti")
        # The first edge to each far end, by a partial aggregate: no hub's edges meet in one task.
        first = reached.groupBy("far").agg(F.min(F.struct(*KEY, "near")).alias("_first"))
        level = reached.dropDuplicates([*KEY, "far"]).join(first, "far").join(visited.select(F.col("node").alias("far"), F.lit(True).alias("_seen")), "far", "left")
        level = level.withColumn("cycle_detected", F.coalesce("_seen", F.lit(False)) | (F.struct(*KEY) != F.struct(*[F.col(f"_first.{k}") for k in KEY]))).withColumn("depth", F.lit(d))
        if kept:
            level = level.checkpoint()
        fresh = level.where(~F.col("cycle_detected")).select(F.col("far").alias("node"), F.lit(d).alias("level"))
        rows = level.groupBy(*KEY).agg(F.min("depth").alias("depth"), F.min("cycle_detected").alias("cycle_detected"))
        found = rows if found is None else found.unionByName(rows)
        visited, frontier = visited.unionByName(fresh), fresh
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """(entity, n): edges at either end; a self-loop counts once."""
    ends = F.array_distinct(F.array("source_entity", "target_entity"))
    return edges.select(F.explode(ends).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def importance(edges: DataFrame) -> DataFrame:
    """(file_path, importance): inbound edges of a file over those of the file with most."""
    counts = edges.groupBy(P.entity_file(F.col("target_entity")).alias("file_path")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("file_path", (F.col("n") / F.col("most")).alias("importance"))


def ranked(candidates: DataFrame, edges: DataFrame, by: str, language: Column | None = None) -> DataFrame:
    """(by, entity): for each query the candidate with no other language, not generated, with most edges, first by name."""
    file = P.entity_file(F.col("entity"))
    own = P.language(file)
    other = F.lit(0) if language is None else F.when((own != "unknown") & (own != language), 1).otherwise(0)
    scored = candidates.join(degrees(edges), "entity", "left").withColumn("_s", F.struct(other.alias("a"), P.generated(file).cast("int").alias("b"), (-F.coalesce("n", F.lit(0))).alias("c"), F.col("entity").alias("d")))
    return scored.groupBy(by).agg(F.min("_s").alias("_s")).select(by, F.col("_s.d").alias("entity"))


def in_context(candidates: DataFrame, edges: DataFrame, by: str, context_file: str) -> DataFrame:
    """The same near a file: same directory, then imported by the file, then others; then by name."""
    folder = lambda p: F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    here = context_file.rpartition("/")[0]
    linked = edges.where(F.col("source_entity") == context_file).select(F.col("target_entity").alias("entity"), F.lit(True).alias("_linked")).distinct()
    tier = F.when(F.lit(bool(here)) & (folder(P.entity_file(F.col("entity"))) == here), 0).when(F.col("_linked"), 1).otherwise(2)
    return candidates.join(linked, "entity", "left").groupBy(by).agg(F.min(F.struct(tier.alias("t"), F.col("entity").alias("e")))["e"].alias("entity"))


def resolved(names: DataFrame, edges: DataFrame, language: Column | None = None, context_file: str | None = None) -> DataFrame:
    """(name, entity): an equal entity, else the best of those that end in the name (letters of either case), else the name itself.

    Equal entities are found first, by an equi-join. The ends of an entity that a name can match are then found without comparing
    each with each: names are told apart by length, and an entity is joined by its ends of just those lengths. Ranked by edges
    or, with a context file, by nearness to it.
    """
    ends = edges.select(F.explode(F.array("source_entity", "target_entity")).alias("entity")).distinct()
    want = names.select("name").where("name is not null").distinct()
    exact = want.join(ends.select(F.col("entity").alias("name")), "name", "left_semi")
    rest = want.join(exact, "name", "left_anti").where("name <> ''").withColumn("_low", F.lower("name"))
    # One row: the different lengths of the names left, of which there are at most as many as letters in the longest.
    sizes = rest.agg(F.collect_set(F.length("_low")).alias("_sizes"))
    cut = ends.withColumn("_e", F.lower("entity")).crossJoin(F.broadcast(sizes)).select("entity", F.explode(F.transform(F.filter("_sizes", lambda n: n <= F.length("_e")), lambda n: F.right("_e", n))).alias("_low"))
    found = rest.join(cut, "_low").select("name", "entity")
    best = ranked(found, edges, "name", language) if context_file is None else in_context(found, edges, "name", context_file)
    best = best.unionByName(exact.select("name", F.col("name").alias("entity")))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("entity", "name").alias("entity"))


def bare_targets(edges: DataFrame) -> DataFrame:
    return edges.select("target_entity").where(~F.contains("target_entity", F.lit("::")) & ~F.contains("target_entity", F.lit("/"))).distinct()


def rewritten(edges: DataFrame) -> DataFrame:
    """Bare targets become the one source entity with that symbol, where there is just one; keys stay unique.

    Of a dotted target the part before the first dot is looked up, and the rest stays behind it.
    """
    symbols = edges.select("source_entity").distinct().where(F.contains("source_entity", F.lit("::"))).withColumn("_base", P.short_name(F.col("source_entity")))
    only = symbols.groupBy("_base").agg(F.count("*").alias("n"), F.min("source_entity").alias("_full")).where("n = 1").select("_base", "_full")
    bare = ~F.contains("target_entity", F.lit("::")) & ~F.contains("target_entity", F.lit("/"))
    base = F.substring_index("target_entity", ".", 1)
    out = edges.withColumn("_base", F.when(bare, base)).join(only, "_base", "left")
    rest = F.col("target_entity").substr(F.length(base) + 1, F.length("target_entity"))
    return out.withColumn("target_entity", F.when(F.col("_full").isNotNull(), F.concat("_full", rest)).otherwise(F.col("target_entity"))).drop("_base", "_full").dropDuplicates(list(KEY))


def module_resolved(targets: DataFrame, entities: DataFrame) -> DataFrame:
    """(target, entity): `a.b::sym` becomes the one entity with that symbol whose file holds a/b; others stay.

    Of a dotted symbol the part before the first dot is looked up, and the whole symbol is put behind the file found.
    """
    named = targets.select("target").distinct()
    t = named.withColumn("_sym", P.bare_symbol(F.col("target"))).withColumn("symbol", F.substring_index("_sym", ".", 1)).withColumn("module", F.replace(P.entity_file(F.col("target")), F.lit("."), F.lit("/")))
    e = entities.select("entity").where(F.contains("entity", F.lit("/"))).distinct().withColumn("symbol", P.short_name(F.col("entity"))).withColumn("file", P.entity_file(F.col("entity")))
    hits = t.where(~F.contains("target", F.lit("/"))).join(e.where(F.contains("entity", F.lit("::"))), "symbol").where(F.contains("file", F.col("module")))
    only = hits.groupBy("target").agg(F.count("*").alias("n"), F.min(F.concat("file", F.lit("::"), "_sym")).alias("found")).where("n = 1")
    return named.join(only, "target", "left").select("target", F.coalesce("found", "target").alias("entity"))


def normalised(edges: DataFrame) -> DataFrame:
    """Edges with bare, then module-qualified targets resolved where that is unambiguous; keys stay unique."""
    first = rewritten(edges)
    found = module_resolved(first.select(F.col("target_entity").alias("target")), edges.select(F.col("source_entity").alias("entity"))).where("entity <> target")
    out = first.join(found.select(F.col("target").alias("target_entity"), "entity"), "target_entity", "left")
    return out.withColumn("target_entity", F.coalesce("entity", "target_entity")).drop("entity").dropDuplicates(list(KEY)).select(*edges.columns)


def neighbours(entities: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(entity, callers, calls, imports): sorted names at the other ends, the first `most` of each.

    With `most` no list is ever longer than that: names are ranked before they are gathered, and partly so before the shuffle.
    """
    out = edges.select(F.col("source_entity").alias("entity"), F.when(F.col("relationship") == "imports", "imports").otherwise("calls").alias("side"), P.short_name(F.col("target_entity")).alias("other"))
    back = edges.where("relationship <> 'imports'").select(F.col("target_entity").alias("entity"), F.lit("callers").alias("side"), P.short_name(F.col("source_entity")).alias("other"))
    ends = out.unionByName(back).join(entities.select("entity").distinct(), "entity", "left_semi").distinct()
    if most is not None:
        ends = ends.withColumn("_n", F.row_number().over(Window.partitionBy("entity", "side").orderBy("other"))).where(F.col("_n") <= most)
    lists = [F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("other")))).alias(s) for s in ("callers", "calls", "imports")]
    return ends.groupBy("entity").agg(*lists)


# Relationships that count as use of an entity; how many users and tests are named.
USES, USERS_NAMED, TESTS_NAMED = ("calls", "imports", "inherits", "renders"), 3, 1


def result_entities(results: DataFrame, key: str) -> DataFrame:
    """(key, entity): a result's chunk id, and file::Class.function, file::function or file::Class where it has these names."""
    named = [c if c in results.columns else None for c in ("function_name", "class_name")]
    f, c = (F.coalesce(F.col(x), F.lit("")) if x else F.lit("") for x in named)
    symbol = F.when((c != "") & (f != ""), F.concat_ws(".", c, f)).when(f != "", f).when(c != "", c)
    own = [F.col("chunk_id")] if "chunk_id" in results.columns else []
    return results.select(key, "file_path", F.explode(F.array_compact(F.array(*own, F.concat("file_path", F.lit("::"), symbol)))).alias("entity"))


def context(results: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, context): `Called by: a, b, c | Tests: t` of each result, from the edges at either end of its file's entities.

    An entity of another result of the same file counts too. Names are in order of letters, each once.
    """
    owned = result_entities(results, key)
    belongs = results.select(key, "file_path").join(owned.select("file_path", "entity").distinct(), "file_path").select(key, "entity").distinct()
    ends = edges.select(F.col("source_entity").alias("entity"), F.col("target_entity").alias("other"), "relationship").unionByName(edges.select(F.col("target_entity").alias("entity"), F.col("source_entity").alias("other"), "relationship"))
    tests = (F.col("relationship") == "tests") | F.contains(F.lower("other"), F.lit("test"))
    side = F.when(tests, "tests").when(F.col("relationship").isin(*USES), "callers")
    # Results are few (their limit bounds them), so they go to the edges.
    near = ends.join(F.broadcast(belongs), "entity").select(key, side.alias("side"), P.short_name(F.col("other")).alias("name")).where("side is not null").distinct()
    n = F.row_number().over(Window.partitionBy(key, "side").orderBy("name"))
    kept = near.withColumn("_n", n).where(F.col("_n") <= F.when(F.col("side") == "tests", TESTS_NAMED).otherwise(USERS_NAMED))
    lists = kept.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("name")))).alias(s) for s in ("callers", "tests")])
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    return lists.select(key, F.concat_ws(" | ", part("Called by: ", "callers"), part("Tests: ", "tests")).alias("context"))


def surfaced(result_files: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Files at the other ends of the results' edges that are no results: the first edge of each file, the first `most` files."""
    from weftline.functions.text import category

    hop = batch_hop(edges, entities)
    sides = hop.select("relationship", F.explode(F.array("target_entity", "source_entity")).alias("entity")).withColumn("file_path", P.entity_file(F.col("entity")))
    other = sides.join(result_files.select("file_path").distinct(), "file_path", "left_anti")
    first = other.groupBy("file_path").agg(F.min(F.struct("entity", "relationship")).alias("e"))
    return first.select("file_path", category(F.col("e.relationship"), F.col("file_path")).alias("relationship"), F.col("e.entity").alias("entity")).orderBy("file_path").limit(most)


CONVERTER = r"<\w+:\w+>"


def urls_matched(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(url, pattern, tier): exact (0), then with converters as one path segment each (1), then by static prefix (2); first by place in each.

    patterns: (place, pattern). No url is held against every pattern: the exact tier is an equi-join; a pattern with converters is
    joined by its number of segments and its static segments that come first; a prefix by the url's prefixes.
    """
    from weftline.functions.text import normal_url

    p = patterns.select("place", "pattern", normal_url(F.col("pattern")).alias("_norm")).withColumn("_converts", F.col("_norm").rlike(CONVERTER))
    rows = calls.select("url").distinct().withColumn("_url", normal_url(F.col("url")))
    hit = lambda tier: ("url", F.lit(tier).alias("tier"), "place", "pattern")
    exact = rows.join(p.withColumnRenamed("_norm", "_url"), "_url").select(*hit(0))
    # Converters match one segment, so both have as many; the static text before the first converter's segment is joined on.
    slashes = lambda c: F.length(c) - F.length(F.translate(c, "/", ""))
    head = F.regexp_extract("_norm", r"^((?:[^<]*/)?)[^/]*<\w+:\w+>", 1)
    quoted = F.regexp_replace(F.col("_norm"), r"([.\\+*?\[\]^$(){}|\-])", r"\\$1")
    q = p.where("_converts").withColumns({"_n": slashes("_norm"), "_head": head, "_regex": F.concat(F.lit("^"), F.regexp_replace(quoted, CONVERTER, "[^/]+"), F.lit("$"))})
    shaped = rows.withColumn("_n", slashes("_url")).withColumn("_head", F.explode(F.expr("transform(sequence(0, _n), i -> if(i = 0, '', concat(substring_index(_url, '/', i), '/')))")))
    converted = shaped.join(q, ["_n", "_head"]).where(F.rlike(F.col("_url"), F.col("_regex"))).select(*hit(1))
    static = p.withColumn("_static", normal_url(F.regexp_extract("pattern", rf"^(.*?)({CONVERTER}|$)", 1))).where("_static <> ''")
    sizes = static.agg(F.collect_set(F.length("_static")).alias("_sizes"))
    cut = rows.crossJoin(F.broadcast(sizes)).select("url", F.explode(F.transform(F.filter("_sizes", lambda n: n < F.length("_url")), lambda n: F.left("_url", n))).alias("_static"))
    prefixed = cut.join(static, "_static").select(*hit(2))
    every = exact.unionByName(converted).unionByName(prefixed)
    return every.groupBy("url").agg(F.min(F.struct("tier", "place", "pattern")).alias("m")).select("url", F.col("m.pattern").alias("pattern"), F.col("m.tier").alias("tier"))
