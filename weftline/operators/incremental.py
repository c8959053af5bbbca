"""Snapshots, keyed merges and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, modified, unchanged or deleted."""
    a, b = old.select(key, F.col(digest).alias("_a")), new.select(key, F.col(digest).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def upserted(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of new, and those of old whose key isn't in it."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def counted(old: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """Retry counters: those of failures go up by one from 0."""
    f = failures.select(key).distinct().withColumn("_hit", F.lit(1))
    return old.join(f, key, "full").select(key, (F.coalesce("retry_count", F.lit(0)) + F.coalesce("_hit", F.lit(0))).alias("retry_count"))


def cached_or(rows: DataFrame, cache: DataFrame, key: str, value: str, computed: Column) -> DataFrame:
    """The cached value of a key, or the computed one where there is none."""
    c = cache.select(key, F.col(value).alias("_cached")).dropDuplicates([key])
    return rows.join(c, key, "left").withColumn(value, F.coalesce("_cached", computed)).drop("_cached")


def git_status(line: Column) -> Column:
    """Struct change, path of a `git diff --name-status` line; a rename is its new path as added."""
    parts = F.split(line, "\t")
    code = F.substring(F.get(parts, F.lit(0)), 1, 1)
    kind = F.when(code == "A", "added").when(code == "M", "modified").when(code == "D", "deleted").when(code == "R", "added")
    return F.struct(kind.alias("change"), F.element_at(parts, -1).alias("path"))


def guarded(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(collection, n, allowed, refused) of collections, and of `all` of them, that have a limit (collection, allowed)."""
    counts = rows.groupBy("collection").agg(F.count("*").alias("n"))
    every = counts.unionByName(counts.agg(F.lit("all").alias("collection"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    return every.join(limits, "collection").select("collection", "n", "allowed", (F.col("n") > F.col("allowed")).alias("refused"))
