"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts become sorted 32-bit hashes of five-word shingles. A shingle weighs (1 + ln tf) x idf, where document frequencies of all
documents are counted in a hashed table of fixed size. idf is damped into [1, 1 + IDF_PULL]: undamped, the shingles that a group
of thousands of copies shares weigh next to nothing against each copy's own few words, and copies at 0.9 of each other come out
below 0.8 (tests/llm shows it). Consistent weighted samples are banded. In each bucket all members are held against one
representative by weighted Jaccard similarity: the member that shares most buckets with others, so the hub of a group of copies.
Links are joined into components by alternating stars. What is left in buckets of several components goes through an exact
filter: the shingles of each text in one order of rarity, as many of the rarest as weigh more than a fifth of it; texts at 0.8
share one of these, so a text that shares none with another component has no link left to find. The others of a bucket that are
in different components are compared, block by block in tasks of bounded size, so no two texts that share a bucket are left out.
Exact copies (the same words) are one node from the start. Nothing about single documents reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import forget, fresh, mix64, slabs, sum_arrays, written

WORD = re.compile(r"\w+")
#: Words of a shingle, least similarity of a link, bands and samples of each (a link at 0.8 is missed once in 20,000).
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 14, 3
#: Rows of the hashed document-frequency table; the most that idf adds to a weight.
DF_BUCKETS, IDF_PULL = 1 << 18, 0.1
#: Members of a block; up to so many pairs are compared one by one; room for rounding before the exact comparison.
BLOCK, FEW, SLACK = 256, 16, 1e-3
#: Draws (r, ln c, beta) of consistent weighted sampling are taken from tables of this length by hash.
DRAWS = 1 << 16
MEMO_WORDS = 400_000


class Shingler:
    """Shingle hashes of texts; remembers hashes of words."""

    def __init__(self):
        self.at: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        words, at = WORD.findall(text.lower()), self.at
        if new := set(words).difference(at):
            if len(at) > MEMO_WORDS:
                at.clear()
                new = set(words)
            for w in new:
                at[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        return np.fromiter(map(at.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, text: str) -> tuple[int | None, np.ndarray, np.ndarray]:
        """Hash of all words in order (None without words), sorted distinct shingle hashes, how often each occurs.

        A text of fewer than five words is one shingle.
        """
        w = self.words(text)
        if not len(w):
            return None, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        key = xxhash.xxh3_64_intdigest(w.tobytes()) - (1 << 63)
        n = max(1, len(w) - SHINGLE + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(min(SHINGLE, len(w))):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
        found, times = np.unique((mix64(h) >> np.uint64(32)).astype(np.uint32), return_counts=True)
        return key, found, times


def shingled(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, key, shingles, times): times is null where every shingle occurs once; key is null without words."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            done = 0
            for run in slabs(batch[text], 500_000):
                ids, out = batch[id_].iloc[done : done + len(run)], []
                done += len(run)
                for i, t in zip(ids, run, strict=True):
                    key, found, times = shingler(t)
                    out.append((i, key, found.astype("<u4").tobytes(), times.astype("<u4").tobytes() if len(times) and times.max() > 1 else None))
                yield pd.DataFrame({"id": [r[0] for r in out], "key": pd.array([r[1] for r in out], dtype="Int64"), "shingles": [r[2] for r in out], "times": [r[3] for r in out]})

    return docs.select(id_, text).mapInPandas(rows, "id long, key long, shingles binary, times binary")


def idf_table(rows: DataFrame) -> np.ndarray:
    """Weights by hashed document frequency over all documents, in [1, 1 + IDF_PULL]."""

    def fold(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros(DF_BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for held in batch["shingles"]:
                if held:
                    np.add.at(total, np.unique(np.frombuffer(held, dtype="<u4") >> np.uint32(14)), 1)
                    total[-1] += 1
        return total

    df = sum_arrays(rows.select("shingles"), fold, DF_BUCKETS + 1)
    n = max(2, int(df[-1]))
    return (1 + IDF_PULL * np.clip(np.log((n + 1) / (df[:-1] + 1)) / np.log(n + 1), 0, 1)).astype(np.float32)


def weights(shingles: np.ndarray, times: bytes | None, idf: np.ndarray) -> np.ndarray:
    w = idf[shingles >> np.uint32(14)]
    return w * (1 + np.log(np.frombuffer(times, dtype="<u4").astype(np.float32))) if times else w


class Sampler:
    """Improved consistent weighted samples: of two sets, a sample agrees with the probability of their weighted Jaccard similarity."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, DRAWS).astype(np.float32)
        self.lnc = np.log(rng.gamma(2, 1, DRAWS)).astype(np.float32)
        self.beta = rng.random(DRAWS).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, shingles: list[np.ndarray], weight: list[np.ndarray]) -> np.ndarray:
        """A row of BANDS hashes for each (not empty) set."""
        size = np.array([len(s) for s in shingles])
        start = np.cumsum(size) - size
        x = mix64(np.concatenate(shingles).astype(np.uint64) + np.uint64(1))
        lnw = np.log(np.concatenate(weight))
        of = np.repeat(np.arange(len(size)), size)
        out = np.zeros((len(size), BANDS), dtype=np.uint64)
        for k in range(BANDS * ROWS):
            i = ((x * self.odd[k]) >> np.uint64(48)).astype(np.int64)
            r, beta = self.r[i], self.beta[i]
            t = np.floor(lnw / r + beta)
            a = self.lnc[i] - r * (t - beta + 1)
            low = np.minimum.reduceat(a, start)
            at = np.flatnonzero(a == low[of])
            _, first = np.unique(of[at], return_index=True)
            at = at[first]
            got = mix64(x[at] + mix64((t[at].astype(np.int64) + 1000).astype(np.uint64) * np.uint64(64) + np.uint64(k)))
            out[:, k // ROWS] = out[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + got
        return mix64(out)


def banded(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """Distinct (band, bucket, key) of all sets."""
    table = rows.sparkSession.sparkContext.broadcast(idf)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler()
        for batch in batches:
            batch = batch.drop_duplicates("key")
            run, held = [], 0
            for key, sh, times in zip(batch["key"], batch["shingles"], batch["times"], strict=True):
                s = np.frombuffer(sh, dtype="<u4")
                run.append((key, s, weights(s, times, table.value)))
                held += len(s)
                if held > 60_000:
                    yield table_of(run, sampler)
                    run, held = [], 0
            if run:
                yield table_of(run, sampler)

    def table_of(run: list, sampler: Sampler) -> pd.DataFrame:
        return pd.DataFrame({"key": [r[0] for r in run], "buckets": list(sampler.bands([r[1] for r in run], [r[2] for r in run]).astype(np.int64))})

    got = rows.where("key is not null").select("key", "shingles", "times").mapInPandas(make, "key long, buckets array<long>")
    return got.select("key", F.posexplode("buckets").alias("band", "bucket")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, idf: np.ndarray) -> DataFrame:
    """Pairs (key, rep) whose sets are similar enough."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, ta: pd.Series, b: pd.Series, tb: pd.Series) -> pd.Series:
        return pd.Series([similarity(w, x, y, z, table.value) for w, x, y, z in zip(a, ta, b, tb, strict=True)], dtype=float)

    left = nodes.select("key", F.col("shingles").alias("a"), F.col("times").alias("ta"))
    right = nodes.select(F.col("key").alias("rep"), F.col("shingles").alias("b"), F.col("times").alias("tb"))
    return pairs.join(left, "key").join(right, "rep").withColumn("similarity", jaccard("a", "ta", "b", "tb")).where(F.col("similarity") >= SIMILAR).select("key", "rep")


def similarity(a: bytes, ta: bytes | None, b: bytes, tb: bytes | None, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    x, y = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
    wx, wy = weights(x, ta, idf).astype(float), weights(y, tb, idf).astype(float)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(wx[i], wy[j]).sum()
    return float(both / max(wx.sum() + wy.sum() - both, 1e-12))


def components(links: DataFrame) -> DataFrame:
    """(key, comp): the least key of each linked key's component, by alternating large and small stars (a, b: the links)."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, edges = edges, written(small)
        forget(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(state) == before or state[0] == 0:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("comp"))
        before = tuple(state)


def _hubs(cells: DataFrame, nodes: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links of each cell's members to its hub, the member of the largest weight (cells: cell, key, weight)."""
    order = F.shiftleft(F.least("weight", F.lit(1 << 20)), 42).bitwiseOR(F.xxhash64("key", "cell").bitwiseAND(F.lit((1 << 42) - 1)))
    hubs = cells.withColumn("o", order).groupBy("cell").agg(F.max_by("key", "o").alias("rep"))
    return written(verified(cells.join(hubs, "cell").where("key <> rep").select("key", "rep").distinct(), nodes, idf))


def rarest(shingles: np.ndarray, weight: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The rarest shingles that weigh more than what a similar text may lack: a text at SIMILAR has one of them among its own rarest.

    Texts at s share at least s of either's weight. Were the rarest shingle that both have not among these, all they share would
    lie behind, and that weighs less than s.
    """
    order = np.lexsort((shingles, -idf[shingles >> np.uint32(14)]))
    behind = weight.sum(dtype=float) - np.cumsum(weight[order], dtype=float)
    return shingles[order[: int(np.argmax(behind < (SIMILAR - SLACK) * weight.sum(dtype=float))) + 1]]


def _open(members: DataFrame, nodes: DataFrame, idf: np.ndarray) -> DataFrame:
    """Of (key, own) the keys whose rarest shingles include one of another component's members."""
    table = members.sparkSession.sparkContext.broadcast(idf)

    def table_of(run: list) -> pd.DataFrame:
        n = [len(r[2]) for r in run]
        return pd.DataFrame({"shingle": np.concatenate([r[2] for r in run]).astype(np.int64), "key": np.repeat([r[0] for r in run], n), "own": np.repeat([r[1] for r in run], n)})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            run, held = [], 0
            for key, own, sh, times in zip(batch["key"], batch["own"], batch["shingles"], batch["times"], strict=True):
                s = np.frombuffer(sh, dtype="<u4")
                run.append((key, own, rarest(s, weights(s, times, table.value), table.value)))
                held += len(run[-1][2])
                if held > 60_000:
                    yield table_of(run)
                    run, held = [], 0
            if run:
                yield table_of(run)

    cuts = written(members.join(nodes, "key").select("key", "own", "shingles", "times").mapInPandas(cut, "shingle long, key long, own long"))
    several = cuts.groupBy("shingle").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("shingle")
    return written(cuts.join(several, "shingle", "left_semi").select("key").distinct())


def _rest(cells: DataFrame, comp: DataFrame, nodes: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links (key, rep) among all pairs of a cell whose members are in different components; each pair is compared once.

    A cell's largest component is cut into blocks, and so are its other members. Blocks of others are held against each other
    and against those of the largest component, each two of them in a group of its own; so no task has more than two blocks,
    and members of the largest component are never held against each other.
    """
    named = written(cells.join(comp, "key", "left").select("cell", "key", F.coalesce("comp", "key").alias("own")))
    mixed = named.groupBy("cell").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("cell")
    members = named.join(mixed, "cell", "left_semi").select("key", "own").distinct()
    named = named.join(_open(members, nodes, idf), "key", "left_semi")
    sizes = named.groupBy("cell", "own").count().groupBy("cell").agg(F.count("*").alias("several"), F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("own", F.struct("count", "own")).alias("main")).where("several > 1")
    small = F.col("n") <= BLOCK
    others = F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / BLOCK)).cast("int")
    mains = F.when(small, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("int")
    rows = named.join(sizes, "cell").withColumns({"others": others, "mains": mains, "in_main": ~small & (F.col("own") == F.col("main"))})
    slot = F.xxhash64("key", F.lit(3))
    at = F.when(F.col("in_main"), F.col("others") + F.pmod(slot, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(slot, "others")).cast("int")
    against = F.explode(F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1))
    rows = rows.withColumn("at", at).withColumn("against", against)
    rows = rows.select("cell", F.least("at", "against").alias("lo"), F.greatest("at", "against").alias("hi"), "at", "key", "own")
    own_cells = named.groupBy("key").agg(F.collect_list("cell").alias("cells"))
    rows = rows.join(nodes.join(own_cells, "key"), "key").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    table = cells.sparkSession.sparkContext.broadcast(idf)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["cell", "lo", "hi"]):
            found = block_links(group, table.value)
            if found:
                yield pd.DataFrame(found, columns=["key", "rep"])

    return written(rows.mapInPandas(look, "key long, rep long"))


def runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted rows, also where a group goes over several batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[by].to_numpy()
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(batch)]
        if held and (held[-1][by].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held)
            held = []
        for i, j in zip(cut, cut[1:]):
            if i:
                yield pd.concat(held)
                held = []
            held.append(batch.iloc[i:j])
    if held:
        yield pd.concat(held)


def block_links(group: pd.DataFrame, idf: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs of a block with itself or of two blocks, in different components, that share no cell before this one."""
    cell, lo, hi = (group[c].iat[0] for c in ("cell", "lo", "hi"))
    at, key, own = (group[c].to_numpy() for c in ("at", "key", "own"))
    a = np.flatnonzero(at == lo)
    b = a if lo == hi else np.flatnonzero(at == hi)
    sets, times = group["shingles"].to_list(), group["times"].to_list()
    weight = np.array([weights(np.frombuffer(s, dtype="<u4"), t, idf).sum(dtype=float) for s, t in zip(sets, times, strict=True)])
    wa, wb = weight[a][:, None], weight[b][None, :]
    # Similarity is at most the ratio of the weights.
    want = (own[a][:, None] != own[b][None, :]) & (np.minimum(wa, wb) >= (SIMILAR - SLACK) * np.maximum(wa, wb))
    if lo == hi:
        want &= a[:, None] < b[None, :]
    if not want.any():
        return []
    before = [c[c < cell] for c in map(np.asarray, group["cells"])]
    want &= shared([before[i] for i in a], [before[i] for i in b], lambda x: np.ones(len(x), dtype=np.float32)) == 0
    i, j = np.nonzero(want)
    if len(i) > FEW:
        ra, rb = np.unique(i), np.unique(j)
        parts = {n: layers(sets[n], times[n]) for n in {*a[ra], *b[rb]}}
        both = np.zeros(want.shape)
        both[np.ix_(ra, rb)] = shared([parts[n] for n in a[ra]], [parts[n] for n in b[rb]], lambda x: layer_weights(x, idf))
        i, j = np.nonzero(want & (both >= (SIMILAR - SLACK) * (wa + wb - both)))
    return [(int(key[x]), int(key[y])) for x, y in zip(a[i], b[j], strict=True) if similarity(sets[x], times[x], sets[y], times[y], idf) >= SIMILAR]


def layers(held: bytes, times: bytes | None) -> np.ndarray:
    """A number for each shingle and each of its occurrences: shingle, and in the low 31 bits which occurrence."""
    s = np.frombuffer(held, dtype="<u4").astype(np.int64) << 31
    if not times:
        return s
    n = np.frombuffer(times, dtype="<u4").astype(np.int64)
    return np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def layer_weights(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """What an occurrence adds to the shingle's weight."""
    k = (x & 0x7FFFFFFF).astype(float)
    return (idf[x >> 45] * np.where(k > 0, np.log1p(k) - np.log(np.maximum(k, 1)), 1)).astype(np.float32)


def shared(a: list[np.ndarray], b: list[np.ndarray], weight: Callable[[np.ndarray], np.ndarray], step: int = 8192) -> np.ndarray:
    """Weight of the numbers that each array of a has in common with each array of b."""
    x, y = np.concatenate(a), np.concatenate(b)
    rx, ry = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))
    both = np.intersect1d(x, y)
    w = weight(both)
    out = np.zeros((len(a), len(b)))
    if not len(both):
        return out
    px, py = np.minimum(np.searchsorted(both, x), len(both) - 1), np.minimum(np.searchsorted(both, y), len(both) - 1)
    kx, ky = both[px] == x, both[py] == y
    px, rx, py, ry = px[kx], rx[kx], py[ky], ry[ky]
    for i in range(0, len(both), step):
        n = min(step, len(both) - i)
        p, q = np.zeros((len(a), n), dtype=np.float32), np.zeros((len(b), n), dtype=np.float32)
        kx, ky = (px >= i) & (px < i + n), (py >= i) & (py < i + n)
        p[rx[kx], px[kx] - i] = w[px[kx]]
        q[ry[ky], py[ky] - i] = 1
        out += p @ q.T
    return out


def classes(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id): for each row its id and the least id of its class.

    Null and wordless texts are classes of their own; a null id is replaced by a negative hash of the text. Repeated rows are
    in one class. An empty table gives no rows.
    """
    own = fresh(docs, "id")
    rows = docs.select(identity(F.col(id_), F.col(text)).alias(own), F.col(text))
    base = written(shingled(rows, own, text))
    idf = idf_table(base)
    bands = written(banded(base, idf).select("key", F.xxhash64("band", "bucket").alias("cell")))
    least = written(base.where("key is not null").groupBy("key").agg(F.min("id").alias("first")))
    crowded = bands.groupBy("cell").count().where("count > 1")
    cells = written(bands.join(crowded, "cell"))
    weight = written(cells.groupBy("key").agg(F.sum("count").alias("weight")))
    cells = written(cells.join(weight, "key").select("cell", "key", "weight"))
    wanted = weight.select("key").join(least, "key").select("key", F.col("first").alias("id"))
    nodes = written(base.join(wanted, ["key", "id"]).select("key", "shingles", "times"))
    links = _hubs(cells, nodes, idf)
    links = links.unionByName(_rest(cells, components(links.select(F.col("key").alias("a"), F.col("rep").alias("b"))), nodes, idf))
    comp = components(links.select(F.col("key").alias("a"), F.col("rep").alias("b")))
    named = least.join(comp, "key", "left").select("key", "first", F.coalesce("comp", "key").alias("comp"))
    first = named.groupBy("comp").agg(F.min("first").alias("class_id"))
    least = named.join(first, "comp").select("key", "class_id")
    lone = base.where("key is null").select("id", F.col("id").alias("class_id"))
    return base.where("key is not null").select("id", "key").join(least, "key").select("id", "class_id").unionByName(lone)


def identity(id_, text):
    """The row's id; for a null id a negative hash of the text."""
    return F.coalesce(id_.cast("long"), -1 - F.pmod(F.xxhash64(text), F.lit(1 << 62)))


def kept(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that of the least id; of repeated rows of an id, one."""
    from pyspark.sql import Window

    own, n = fresh(docs, "id"), fresh(docs, "n")
    first = classes(docs, id_, text).select(F.col("class_id").alias(own)).distinct()
    rows = docs.withColumn(own, identity(F.col(id_), F.col(text))).join(first, own, "left_semi")
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(own).orderBy(F.xxhash64(F.col(text))))).where(F.col(n) == 1).select(*docs.columns)
