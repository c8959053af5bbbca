"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: vectors scaled to length 1, turned by several rotations that iterative quantisation has fitted on a bounded sample, and cut
to signs. A code is split into two-byte substrings and each partition of vectors indexes every one of them by value. By the pigeonhole
principle a code within Hamming distance r of a query's lies within floor(r / m) of it in one of the m substrings at least: probing
all values so near in every index retrieves all codes within r, and these are ranked by exact cosines of the original vectors.
r is set from brute force over all rows for a bounded sample of queries, so that their true neighbours are within it.
Queries go to the partitions in blocks of bounded size, one block after another; each partition returns k ids a query.

How much the probes leave out depends on the vectors: among 3,000 in groups at cosines over 0.9 a query looks at a tenth of
the rows or less, among directions at random (neighbours near 0.5) at nearly all, of which the Hamming test leaves a hundredth to rerank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

#: Vectors that rotations are fitted on, rotations of as many bits as the vectors have numbers, steps of fitting.
SAMPLE, ROTATIONS, STEPS = 4096, 4, 20
#: Queries of one block; queries that r is set on, share of their neighbours that must lie within it; rows of one index.
BLOCK, TUNE, WITHIN, CHUNK = 20_000, 100, 0.985, 20_000
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: Bits of all two-byte values; these values by their number of bits, and how many have up to each number of them.
POPCOUNT16 = POPCOUNT[np.arange(65536) >> 8] + POPCOUNT[np.arange(65536) & 255]
NEARBY = np.argsort(POPCOUNT16, kind="stable").astype(np.uint16)
WITHIN_BITS = np.cumsum(np.bincount(POPCOUNT16))


def usable(vec: Column) -> Column:
    """Not null, nor holding null or non-finite numbers, and not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors by their largest component: cosines stay, and no square overflows or vanishes."""
    return v / np.abs(v).max(axis=1, keepdims=True)


def units(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def rotations(sample: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Rotations by iterative quantisation, each from another start."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    out = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(STEPS):
            u, _, v = np.linalg.svd(np.sign(sample @ r).T @ sample)
            r = (u @ v).T
        out.append(r)
    return out


def codes(unit: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    bits = np.concatenate([unit @ r > 0 for r in turns], axis=1)
    return np.packbits(bits, axis=1)


class MultiIndex:
    """Two-byte substring indexes of codes: for each substring the rows sorted by value and where each value begins."""

    def __init__(self, code: np.ndarray, ids: np.ndarray):
        self.code = code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
        self.parts = np.ascontiguousarray(code).view(np.uint16)
        self.m, self.ids = self.parts.shape[1], ids
        self.distinct = len(np.unique(ids))
        self.rows = [np.argsort(self.parts[:, j], kind="stable") for j in range(self.m)]
        self.begin = [np.searchsorted(self.parts[self.rows[j], j], np.arange(65537)) for j in range(self.m)]
        self.touched = 0

    def _probed(self, j: int, part: int, near: int) -> np.ndarray:
        """Rows whose substring j is within `near` bits of `part`."""
        values = NEARBY[: WITHIN_BITS[min(near, 16)]] ^ np.uint16(part)
        if 4 * len(values) > len(self.parts):  # reading every row's substring is quicker, and gives the same rows
            return np.flatnonzero(POPCOUNT16[self.parts[:, j] ^ np.uint16(part)] <= near)
        first, size = self.begin[j][values], self.begin[j][values.astype(np.int64) + 1] - self.begin[j][values]
        return self.rows[j][np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def within(self, query: np.ndarray, radius: int, at_least: int) -> np.ndarray:
        """All rows within the radius of the query's code; a larger radius where these have fewer than at_least distinct ids."""
        query = np.pad(query, (0, len(query) % 2))
        near, hit = radius // self.m, np.zeros(len(self.code), dtype=bool)
        for j, part in enumerate(np.ascontiguousarray(query).view(np.uint16).tolist()):
            hit[self._probed(j, part, near)] = True
            if hit.all():
                break
        rows = np.flatnonzero(hit)
        self.touched += len(rows)
        far = POPCOUNT[self.code[rows] ^ query].sum(axis=1, dtype=np.int64)
        found = rows[far <= radius]
        if self.distinct == len(self.ids):
            n = len(found)
        else:
            n = len(np.unique(self.ids[found]))
        if n >= min(at_least, self.distinct):
            return found
        return self.within(query, radius + 2 * self.m, at_least)


def _top(query_id: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    rows = rows[ids[rows] != query_id]
    score = (vectors[rows] * query).sum(axis=1) / (norms[rows] * np.sqrt((query * query).sum()))
    order = np.lexsort((ids[rows], -score))
    # The best row of each id; more rows only where ids repeat.
    best, n = order[:k], k
    while n < len(order) and len(np.unique(ids[rows[best]])) < k:
        n *= 4
        best = order[:n]
    _, first = np.unique(ids[rows[best]], return_index=True)
    best = best[np.sort(first)[:k]]
    return [(query_id, int(ids[rows[b]]), float(score[b])) for b in best]


def _searched(vectors: DataFrame, block: pd.DataFrame, k: int, turns: list[np.ndarray] | None, radius: int) -> DataFrame:
    """(query_id, vec_id, score): k distinct ids of each partition chunk for each query; by brute force if turns is None."""
    shared = vectors.sparkSession.sparkContext.broadcast((block["id"].to_numpy(), _matrix(block["v"]), turns, radius))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q, turn, r = shared.value
        q = scaled(q)
        for batch in chunks(batches):
            ids, v = batch["id"].to_numpy(), scaled(_matrix(batch["v"]))
            norms = np.sqrt((v * v).sum(axis=1))
            if turn is None:
                everything = np.arange(len(ids))
                pick = lambda n, everything=everything: everything
            else:
                index, qc = MultiIndex(codes(v / norms[:, None], turn), ids), codes(units(q), turn)
                pick = lambda n, index=index, qc=qc: index.within(qc[n], r, k + 1)
            out = [row for n in range(len(qid)) for row in _top(int(qid[n]), q[n], ids, v, norms, pick(n), k)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return vectors.mapInPandas(look, "query_id long, vec_id long, score double")


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined to about CHUNK rows."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= CHUNK:
            yield pd.concat(held)
            held = []
    if held and sum(map(len, held)):
        yield pd.concat(held)


def search(embeddings: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that the condition `queries` holds for.

    Candidates are all rows with another id and a vector of as many numbers: cosines of others aren't defined. Rows with a null id
    or a vector that is null, zero or holds null or non-finite numbers take no part. Repeated rows count once; of one id with
    several vectors the best counts, and as a query the one of the least hash; ties go to the smaller id; an empty table gives no
    rows. Vectors of each length are searched on their own, one length after another.
    """
    spark = embeddings.sparkSession
    base = embeddings.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).where("asked > 0").orderBy("d").collect()  # a row for each length
    found = [_of_length(base.where(F.size("v") == r["d"]), r["n"], k) for r in sizes]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _nearest(out, k)


def _of_length(base: DataFrame, n_rows: int, k: int) -> DataFrame | None:
    """(query_id, vec_id, score): k of each block's queries, among vectors of one length."""
    spark = base.sparkSession
    asked = base.where("q").groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    n_queries = asked.count()
    share = min(1.0, 1.3 * SAMPLE / n_rows)
    rank = F.shiftrightunsigned(F.xxhash64("id"), 1) / F.lit(float(2**63))
    sample = base.where(rank <= share).select("v").limit(2 * SAMPLE).toPandas()["v"]
    turns = rotations(units(_matrix(sample))) if len(sample) else rotations(np.eye(len(base.select("v").first()["v"])))
    vectors = base.select("id", "v")
    # The radius: brute force of a bounded sample of queries over all rows.
    trial = asked.where(rank <= min(1.0, 1.5 * TUNE / n_queries)).limit(2 * TUNE).toPandas()
    radius = 0
    if len(trial):
        true = _nearest(_searched(vectors, trial, k, None, 0), k).toPandas()
        if len(true):
            wanted = spark.createDataFrame(true[["vec_id"]].drop_duplicates().rename(columns={"vec_id": "id"}))
            near = vectors.join(F.broadcast(wanted), "id").dropDuplicates(["id"]).toPandas().set_index("id")["v"]
            own = trial.set_index("id")["v"]
            code = [codes(units(_matrix(x)), turns) for x in (own[true["query_id"]], near[true["vec_id"]])]
            far = np.sort(POPCOUNT[code[0] ^ code[1]].sum(axis=1, dtype=np.int64))
            radius = int(far[min(len(far) - 1, int(np.ceil(WITHIN * len(far))))])
    n_blocks = max(1, -(-n_queries // BLOCK))
    out = None
    for i in range(n_blocks):
        block = (asked.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(n_blocks)) == i) if n_blocks > 1 else asked).toPandas()
        if not len(block):
            continue
        part = _searched(vectors, block, k, turns, radius)
        if n_blocks > 1:  # each block ends before the next begins, so one is held at a time
            part = written(_nearest(part, k).drop("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def _nearest(found: DataFrame, k: int) -> DataFrame:
    found = found.where("score is not null")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
