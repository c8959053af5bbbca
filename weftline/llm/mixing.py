"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks of documents.

Each source's documents fall into blocks by hash. A source whose target is r times its size is drawn floor(r) times whole and
once in part; a draw is one block (at its end a part of one, cut by hash). The tree hands the exact numbers of draws of all
sources down to output shards: each node gives its left half as many draws as it has room for, split over the sources by one
multivariate hypergeometric draw, so that every shard is a sample without replacement of the whole mix. A shard's draws of a
source are a run of that source's permuted blocks: runs are disjoint. shuffled() then brings each shard together, in slices of
bounded size, and shuffles within them.

Two passes gather sums per block and the third marks documents: for the plan no document is shuffled. The driver holds a few
numbers for each source; blocks are planned in tasks, a source in each group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, written

#: Weights by place of the source in code-point order, null last, repeating; no source is taken above so many times its size.
WEIGHTS, MOST = (5, 2, 1), 3
#: Blocks of a source, parts of the block at the end of a source's draws, output shards, words of a slice of a shard.
BLOCKS, PARTS, SHARDS, SLICE_WORDS = 256, 4096, 16, 4_000_000
#: The plan (a row per source and block) is broadcast up to so many rows; beyond it the same join shuffles. The result is the same.
BROADCAST_ROWS = 200_000
WORD_RUN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size: what is above is shared anew among the rest."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=16).digest(), "big"))


def split(draws: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """Rows: shards; columns: sources; exact numbers of draws. Column sums are draws; row sums differ by 1 at most."""
    out = np.zeros((shards, len(draws)), dtype=np.int64)
    room = np.diff(np.linspace(0, int(draws.sum()), shards + 1).astype(np.int64))

    def node(first: int, last: int, own: np.ndarray) -> None:
        if last - first == 1:
            out[first] = own
            return
        mid = (first + last) // 2
        left = _rng(seed, first, last).multivariate_hypergeometric(own, int(room[first:mid].sum()), method="marginals") if own.sum() else own * 0
        node(first, mid, left)
        node(mid, last, own - left)

    node(0, shards, draws.astype(np.int64))
    return out


def drawn_in_part(words: np.ndarray, order: np.ndarray, rest: float) -> tuple[list[int], int, float]:
    """Blocks of a draw of about `rest` words: in permuted order each that still fits; the smallest that doesn't (-1: none); what is left."""
    chosen, over = [], []
    for b in order if rest > 0 else ():
        if words[b] <= rest:
            chosen.append(int(b))
            rest -= words[b]
        else:
            over.append(int(b))
    return chosen, min(over, key=lambda b: words[b]) if over else -1, rest


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """One row per document: its columns, size, source_size, target (both of its source), taken (size x copies), shards.

    shards: the output shard of each copy. Null text: size 0; null source: a source of its own, the last; repeated rows are
    rows of their own, hashed alike, so all or none of a part are drawn; an empty table gives no rows. Columns of the same names
    as those added are replaced.
    """
    spark = docs.sparkSession
    size, block, part = (fresh(docs, x) for x in ("size", "block", "part"))
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.xxhash64(F.col(text)))
    cut = docs.withColumns({block: F.pmod(h, F.lit(BLOCKS)).cast("int"), part: F.pmod(F.shiftright(h, 20), F.lit(PARTS)).cast("int")})
    name = F.col(source).cast("string")
    sums = written(cut.groupBy(name.alias("src"), F.col(block).alias("block")).agg(F.sum(word_count(F.col(text))).alias("words")))
    totals = {r[0]: r[1] for r in sums.groupBy("src").agg(F.sum("words")).collect()}
    names = sorted((x for x in totals if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in totals)
    goal = targets([int(totals[x]) for x in names], [weights[i % len(weights)] for i in range(len(names))])
    whole = [int(g // totals[x]) if totals[x] else 0 for g, x in zip(goal, names, strict=True)]
    sources = spark.createDataFrame([(x, i, int(totals[x]), float(goal[i]), whole[i]) for i, x in enumerate(names)], "src_name string, i int, total long, goal double, whole int")

    def order(i: int, name: str | None) -> np.ndarray:
        return _rng(seed, "order", name).permutation(BLOCKS)

    def chosen(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words = np.zeros(BLOCKS, dtype=np.int64)
        words[rows["block"]] = rows["words"]
        turn = order(group[0], rows["src"].iat[0])
        got, edge, need = drawn_in_part(words, turn, rows["goal"].iat[0] - rows["whole"].iat[0] * rows["total"].iat[0])
        place, nth = np.argsort(turn), np.full(BLOCKS, -1)
        nth[got] = np.arange(len(got))
        kept = [b for b in range(BLOCKS) if words[b] or b == 0]
        return pd.DataFrame({"i": group[0], "block": kept, "place": place[kept], "nth": nth[kept], "edge": [b == edge for b in kept], "need": need, "drawn": len(got)})

    blocks = sums.join(sources, F.col("src").eqNullSafe(F.col("src_name"))).select("i", "src", "block", "words", "total", "goal", "whole")
    blocks = written(blocks.groupBy("i").applyInPandas(chosen, "i int, block int, place int, nth int, edge boolean, need double, drawn int"))

    # The block at the end of a part-draw: its documents up to a hashed bound, the one that comes nearest.
    def bounded(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = np.zeros(PARTS, dtype=np.int64)
        parts[rows["part"]] = rows["words"]
        upto = np.concatenate([[0], np.cumsum(parts)])
        return pd.DataFrame({"i": [group[0]], "bound": [int(np.abs(upto - rows["need"].iat[0]).argmin())]})

    small = len(names) * BLOCKS <= BROADCAST_ROWS
    edges = blocks.where("edge").join(sources, "i").select("i", F.col("block").alias("edge_block"), "need", "src_name")  # a row for each source
    slim = cut.select(name.alias("src"), F.col(block).alias("block"), F.col(part).alias("part"), F.col(text).alias("text"))
    if small:
        edges = F.broadcast(edges)
    else:  # texts stay where they are: their numbers of words are shuffled
        slim = slim.withColumn("words", word_count(F.col("text"))).drop("text")
    ends = slim.join(edges, F.col("src").eqNullSafe(F.col("src_name")) & (F.col("block") == F.col("edge_block")))
    ends = ends.groupBy("i", "part", "need").agg(F.sum(word_count(F.col("text")) if small else F.col("words")).alias("words"))
    bounds = written(ends.groupBy("i").applyInPandas(bounded, "i int, bound int"))
    counts = blocks.groupBy("i").agg(F.max("drawn").alias("drawn")).join(bounds, "i", "left").select("i", "drawn", F.coalesce("bound", F.lit(0)).alias("bound"))
    held = {r["i"]: r for r in counts.collect()}
    draws = np.array([whole[i] * BLOCKS + held[i]["drawn"] + (held[i]["bound"] > 0) for i in range(len(names))], dtype=np.int64)
    by_shard = split(draws, shards, seed) if len(names) else np.zeros((shards, 0), dtype=np.int64)
    given = spark.createDataFrame([(i, held[i]["bound"], [int(x) for x in by_shard[:, i]]) for i in range(len(names))], "i int, bound int, counts array<long>")

    def placed(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard_of = np.repeat(np.arange(shards), rows["counts"].iat[0])
        bound, times = int(rows["bound"].iat[0]), int(rows["whole"].iat[0])
        nth = np.where(rows["edge"] & (bound > 0), rows["drawn"], rows["nth"])
        out = rows[["i", "block", "total", "goal"]].copy()
        out["copies"] = [[int(shard_of[c * BLOCKS + p]) for c in range(times)] for p in rows["place"]]
        out["extra"] = pd.array([int(shard_of[times * BLOCKS + n]) if n >= 0 else None for n in nth], dtype="Int32")
        out["upto"] = np.where(nth < 0, 0, np.where(rows["edge"], bound, PARTS))
        return out

    plan = blocks.join(given, "i").join(sources.select("i", "total", "goal", "whole"), "i").groupBy("i").applyInPandas(placed, "i int, block int, total long, goal double, copies array<int>, extra int, upto int")
    fields = [fresh(docs, x) for x in ("plan_source", "plan_block", "plan_size", "plan_target", "plan_copies", "plan_extra", "plan_limit")]
    table = plan.join(sources.select("i", "src_name"), "i").select(*(F.col(c).alias(f) for c, f in zip(("src_name", "block", "total", "goal", "copies", "extra", "upto"), fields, strict=True)))
    table = written(table)
    s_, b_, size_, target_, copies_, extra_, limit_ = (F.col(f) for f in fields)
    if small:
        table = F.broadcast(table)
    # Blocks without words have no row of their own: they share that of block 0, as none of their documents has a size.
    rows = cut.withColumn(size, word_count(F.col(text))).withColumn(block, F.when(F.col(size) > 0, F.col(block)).otherwise(0))
    out = rows.join(table, name.eqNullSafe(s_) & (F.col(block) == b_), "left")
    none = F.array().cast("array<int>")
    drawn = F.concat(F.coalesce(copies_, none), F.when((F.col(part) < limit_) & extra_.isNotNull(), F.array(extra_)).otherwise(none))
    own = ("size", "source_size", "target", "taken", "shards")
    keep = [F.col(c) for c in docs.columns if c.lower() not in own]
    about = {"words": int(sum(goal)), "shards": shards}
    return out.select(*keep, F.col(size).alias("size"), size_.alias("source_size"), target_.alias("target"), (F.col(size) * F.size(drawn)).alias("taken"), drawn.alias("shards", metadata=about))


def shuffled(mixed: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The mix itself: a row for each copy of each document, with shard, slice and copy (columns of these names are replaced).

    A shard is dealt out by hash to as many slices as keep each at about slice_words words; a slice lies in one partition and
    its rows are in hashed order there, so partition p holds slice p % slices of shard p // slices, and nothing else.
    Repeated rows stay, in one slice.
    """
    about = mixed.schema["shards"].metadata
    slices = max(1, -(-about["words"] // (about["shards"] * slice_words)))
    own = ("shards", "shard", "slice", "copy")
    out = mixed.select(*[c for c in mixed.columns if c.lower() not in own], F.posexplode("shards").alias("copy", "shard"))
    h = F.xxhash64(F.lit(seed + 1), F.col(key).cast("string"), F.col("copy"), F.xxhash64(F.col(text)))
    out = out.withColumn("slice", F.pmod(h, F.lit(slices)).cast("int"))
    dealt = out.repartitionById(about["shards"] * slices, (F.col("shard") * slices + F.col("slice")).cast("int"))
    return dealt.sortWithinPartitions("shard", "slice", F.shiftrightunsigned(h, 7))
