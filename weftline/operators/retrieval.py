"""Dense and sparse ranked lists, reciprocal rank fusion and the steps after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Filterable fields of a chunk.
FILTERABLE = ("app_name", "chunk_type", "is_test", "language", "layer")
#: Score digits that ranks are taken on, so that equal scores of different engines tie alike.
DIGITS = 6


class InvalidFilterError(ValueError):
    def __init__(self, name: str, value: str):
        super().__init__(f"no filter {name!r} (value {value!r}); there are {', '.join(FILTERABLE)}")


def payload_filter(filters: dict[str, str]) -> Column:
    """AND of equalities; is_test is read as a truth value."""
    out = F.lit(True)
    for name, value in filters.items():
        if name not in FILTERABLE:
            raise InvalidFilterError(name, value)
        out = out & (F.col(name) == (value.lower() == "true" if name == "is_test" else value))
    return out


def term_frequencies(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, idx, tf): counts of token indices; tokens with one index add up. Each different identifier of a text is split and hashed once."""
    each = docs.select(key, F.explode(T.identifiers(text)).alias("_i")).groupBy(key, "_i").agg(F.count("*").alias("_n"))
    tokens = each.select(key, "_n", F.explode(T.tokens_of(F.col("_i"))).alias("_t"))
    return tokens.groupBy(key, T.token_index(F.col("_t")).alias("idx")).agg(F.sum("_n").cast("double").alias("tf"))


def idf(postings: DataFrame, n_docs: int | Column) -> DataFrame:
    """(idx, df, idf): ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
    return postings.groupBy("idx").agg(F.count("*").alias("df")).withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def sparse_scores(postings: DataFrame, query: DataFrame, weights: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, score): sum over shared indices of query tf x document tf x idf. query: (by, idx, q_tf), small."""
    wanted = query.join(weights.select("idx", "idf"), "idx")
    return postings.join(F.broadcast(wanted) if not by else wanted, "idx").groupBy(*by, key).agg(F.round(F.sum(F.col("q_tf") * F.col("tf") * F.col("idf")), DIGITS).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where either is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size)


def top(scored: DataFrame, k: int, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best of each list by score, ties by key, with rank from 1. Without a list the sort is a distributed top-k."""
    if not by:
        best = scored.orderBy(F.desc("score"), key).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key)).cast("long")).where(F.col("rank") <= k)


def fused(lists: list[DataFrame], key: str, k: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion: sum over lists of 1 / (k + rank - 1)."""
    both = reduce(DataFrame.unionByName, [x.select(*by, key, "rank") for x in lists])
    return both.groupBy(*by, key).agg(F.round(F.sum(F.lit(1.0).cast("double") / (F.lit(k) + F.col("rank") - 1)), DIGITS).alias("score"))


def merged_best(lists: list[DataFrame], key: str) -> DataFrame:
    """The best score of each key over lists: how an expansion joins the first result."""
    return reduce(DataFrame.unionByName, [x.select(key, "score") for x in lists]).groupBy(key).agg(F.max("score").alias("score"))


def boosted(score: Column, importance: Column, weight: float = 0.25) -> Column:
    return F.when(importance > 0, score * (1 + weight * importance)).otherwise(score)


def demoted(score: Column, is_test: Column, intent: Column | str) -> Column:
    """Tests count 0.80 of their score, 0.95 when debugging."""
    kind = F.lit(intent) if isinstance(intent, str) else intent
    return F.when(is_test, score * F.when(kind == "debug", 0.95).otherwise(0.80)).otherwise(score)


def deduplicated(results: DataFrame, key: tuple[str, ...], tie: str) -> DataFrame:
    """The best-scored row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), tie)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def noop_rerank(rank: Column, n: Column | int) -> Column:
    """1 - i / n for the place i from 0."""
    return F.lit(1.0) - (rank - 1).cast("double") / (n if isinstance(n, Column) else F.lit(n))


def skips_rerank(n: Column, best: Column, query: Column) -> Column:
    return (n <= 10) | (best > 0.92) | F.contains(query, F.lit("/")) | query.rlike(r"\.(py|ts|js)")


def confidence(scores: Column) -> Column:
    """Struct z, label, suggestion of ranked scores: how far the first stands out from the fifth, in gap deviations."""
    s = F.slice(scores, 1, 10)
    n = F.size(s)
    gaps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(s, i) - F.get(s, i + 1))
    count = (n - 1).cast("double")
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / count
    deviation = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / count)
    anchor = F.least(F.lit(4), n - 1)
    lead = F.get(s, F.lit(0)) - F.get(s, anchor)
    flat = F.forall(gaps, lambda x: x == 0)
    z = F.when(deviation > 1e-9, (lead - mean * anchor) / (deviation * F.sqrt(anchor.cast("double")))).when(lead <= mean * anchor + 1e-9, -1.0).otherwise(2.0)
    none = (F.size(scores) < 3) | (F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0)) <= 0)
    value = F.when(none, 0.0).when(flat, 0.0).otherwise(z)
    low = none | flat
    label = F.when(low, "low").when(value >= 1.0, "high").when(value >= 0.0, "medium").otherwise("low")
    hint = F.when(label == "high", "none").when(label == "medium", "try_keyword").otherwise("try_exhaustive")
    return F.struct(value.alias("z"), label.alias("label"), hint.alias("suggestion"))
