"""Benchmark decontamination by greedy string tiling: how much of a test item reappears in a document, in any order.

Runs of MIN_MATCH tokens of the items are seeds. A document is joined to the items whose seeds it has, in each task with an index
of the items; the items that its seeds can cover most come first, and those that cannot beat the best found are not tiled. Tiling
marks the longest common run that lies outside earlier tiles on both sides, again and again, down to MIN_MATCH tokens. The length
of the longest run is searched by halving, with Karp-Rabin hashes of all runs of a length; no pair of places is listed. The share
of the item's tokens under tiles decides, so reordered passages count like unbroken ones.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, slabs, written

WORD = re.compile(r"\w+")
#: Tokens of the shortest tile (whole items that are shorter tile as a whole), least covered share of an item.
MIN_MATCH, COVERED = 4, 0.5
#: Items are broadcast in blocks of at most so many characters and seeds; more blocks mean more passes over the documents.
BLOCK_CHARS = 4_000_000
BASE = 0x9E3779B97F4A7C15


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Runs:
    """Karp-Rabin hashes of all runs of any length of an array of ids, from running sums."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        base = np.full(n + 1, np.uint64(BASE))
        base[0] = 1
        self.power = np.cumprod(base)
        # sums[i] is the sum of ids[j] * BASE^(n - 1 - j) over j < i; a run's part of it is scaled to BASE^n alike for all places.
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(ids * self.power[n - 1 :: -1])]) if n else np.zeros(1, dtype=np.uint64)

    def of(self, size: int) -> np.ndarray:
        n = len(self.ids) - size + 1
        return (self.sums[size:] - self.sums[:-size]) * self.power[:n] if n > 0 else np.zeros(0, dtype=np.uint64)


def _left(free: np.ndarray) -> np.ndarray:
    """For each place, how many free places follow from it on."""
    marked = np.flatnonzero(~free)
    ends = np.append(marked, len(free))
    return ends[np.searchsorted(marked, np.arange(len(free)))] - np.arange(len(free))


def tile(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length), longest first; of equal ones the first in the item, then in the document.

    Arrays hold token ids other than 0. Each round halves its way to the longest length of which both sides have an equal free
    run; lengths fall from round to round, so there are at most as many rounds as different lengths fit into the item.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    # Only runs of the item's own tokens can match: the rest of the document is left out, with a 0 between what stays.
    known = np.isin(doc, item)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])))
    spans = [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]
    if not spans:
        return []
    place = np.concatenate([x for a, b in spans for x in (np.arange(a, b), [-1])])
    d = np.where(place >= 0, doc[place], 0).astype(np.uint64)
    # Powers must be the same on both sides: both are hashed as one array.
    runs = Runs(np.concatenate([d, item.astype(np.uint64)]))
    free_d, free_t = place >= 0, np.ones(len(item), dtype=bool)
    out: list[tuple[int, int, int]] = []
    most = len(item)
    while most >= least:
        left_d, left_t = _left(free_d), _left(free_t)

        def shared(size: int, left_d: np.ndarray = left_d, left_t: np.ndarray = left_t) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
            """Hashes of runs of this length; free places in the item and in the document with a hash that the other side has."""
            p, q = np.flatnonzero(left_d >= size), np.flatnonzero(left_t >= size)
            if not len(p) or not len(q):
                return None
            h = runs.of(size)
            q = q[np.isin(h[len(d) + q], h[p])]
            return (h, p[np.isin(h[p], h[len(d) + q])], q) if len(q) else None

        low, high, found = least - 1, min(most, int(left_t.max()), int(left_d.max())), None
        while low < high:
            half = (low + high + 1) // 2
            if got := shared(half):
                low, found = half, got
            else:
                high = half - 1
        if found is None:
            break
        h, p, q = found
        at: dict[int, list[int]] = defaultdict(list)
        for x in p[::-1].tolist():
            at[int(h[x])].append(x)
        for y in q.tolist():
            if not (free_t[y] and free_t[y + low - 1]):
                continue
            places = at[int(h[len(d) + y])]
            # Marks are at least as long as this run, so its ends tell whether it is free; a marked place never becomes free.
            while places and not (free_d[places[-1]] and free_d[places[-1] + low - 1]):
                places.pop()
            if places and (d[places[-1] : places[-1] + low] == item[y : y + low]).all():
                x = places.pop()
                free_d[x : x + low] = free_t[y : y + low] = False
                out.append((int(place[x]), y, low))
        most = low - 1
    return out


class Tiler:
    """The items of one block, with an index of their seeds: sorted hashes, and for each the items and places that have it."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.at = least, {}
        split = [(i, ids) for i, t in sorted(items, key=lambda x: x[0]) if len(ids := self._ids(tokens(t)))]
        self.names = np.array([i for i, _ in split], dtype=np.int64)
        self.items = [ids for _, ids in split]
        self.sizes = np.array([len(ids) for ids in self.items], dtype=np.int64)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {min(least, len(ids)) for ids in self.items}:
            own = [(n, ids) for n, ids in enumerate(self.items) if min(least, len(ids)) == size]
            h = np.concatenate([_hashes(ids, size) for _, ids in own])
            n = np.concatenate([np.full(len(ids) - size + 1, k) for k, ids in own])
            p = np.concatenate([np.arange(len(ids) - size + 1) for _, ids in own])
            order = np.lexsort((p, n, h))
            self.seeds[size] = (h[order], n[order], p[order])

    def _ids(self, words: list[str]) -> np.ndarray:
        for w in words:
            if w not in self.at:
                self.at[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) | 1
        return np.array([self.at[w] for w in words], dtype=np.uint64)

    def best(self, text: str) -> tuple[int | None, float]:
        """The item that the text covers most (ties: the smaller id) and its share; None and 0 without a shared seed."""
        words = tokens(text)
        # Words of no item get 0, which no item has.
        doc = np.fromiter(map(self.at.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        known = doc != 0
        items, most = [], []
        for size, (h, n, p) in self.seeds.items():
            # Only runs of words that items have can be seeds.
            run = known[: max(len(doc) - size + 1, 0)]
            for j in range(1, size):
                run = run & known[j : j + len(run)]
            start = np.flatnonzero(run)
            if not len(start):
                continue
            own = np.zeros(len(start), dtype=np.uint64)
            for j in range(size):
                own = own * np.uint64(BASE) + doc[start + j]
            own = np.unique(own)
            a, b = np.searchsorted(h, own), np.searchsorted(h, own, side="right")
            if not (b > a).any():
                continue
            places = np.concatenate([np.arange(x, y) for x, y in zip(a[b > a], b[b > a], strict=True)])
            # Tokens of each item under any of the seeds: no tiling covers more.
            places = places[np.lexsort((p[places], n[places]))]
            whose, where = n[places], p[places]
            same = np.append(whose[1:] == whose[:-1], False)
            under = np.where(same, np.minimum(np.append(where[1:], 0) - where, size), size)
            ids, first = np.unique(whose, return_index=True)
            items.append(ids)
            most.append(np.add.reduceat(under, first) / self.sizes[ids])
        top: tuple[int | None, float] = (None, 0.0)
        if not items:
            return top
        ids, bound = np.concatenate(items), np.concatenate(most)
        for k in np.lexsort((self.names[ids], -bound)):
            n = int(ids[k])
            if top[0] is not None and (bound[k] < top[1] or bound[k] == top[1] and self.names[n] > top[0]):
                break  # by order, none that follows can be better
            share = sum(x for _, _, x in tile(doc, self.items[n], self.least)) / int(self.sizes[n])
            if share > top[1] or share == top[1] and share > 0 and self.names[n] < top[0]:
                top = (int(self.names[n]), share)
        return top


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of one length."""
    n = len(ids) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(BASE) + ids[j : j + n]
    return h


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one after another. Null ids and texts without tokens hold nothing to find."""
    run, held = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        run.append((r["i"], r["t"]))
        held += len(r["t"]) + 50
        if held >= BLOCK_CHARS:
            yield run
            run, held = [], 0
    if run:
        yield run


def _judge(shared: Broadcast, least: int):
    @F.pandas_udf("coverage double, neg long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tiler = Tiler(shared.value, least)
        for texts in batches:
            found = [tiler.best(t) for run in slabs(texts) for t in run]
            yield pd.DataFrame({"coverage": [x for _, x in found], "neg": pd.array([None if i is None else -i for i, _ in found], dtype="Int64")})

    return judge.asNondeterministic()


def covered(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = MIN_MATCH, share: float = COVERED) -> DataFrame:
    """Adds item_id (the item covered most, null if none), coverage (its covered share) and contaminated (share reached).

    Nothing is shuffled: one pass for each block of items. Of several passes each reads what the one before has written, so one
    block is held at a time. Null and empty texts cover nothing; an empty benchmark contaminates nothing; of items covered alike
    the smallest id is named, and items of one id count as several; repeated rows get the same answer each; an empty table gives
    no rows. Same-named columns are replaced.
    """
    sc = docs.sparkSession.sparkContext
    best, name = fresh(docs, "best"), None
    out, shared = docs, None
    for block in blocks(benchmark):
        if shared is not None:
            out = written(out)
            shared.destroy()
        shared = sc.broadcast(block)
        # Largest coverage, then the smaller item.
        now = _judge(shared, least)(F.col(text))
        out = out.withColumn(best, now if name is None else F.greatest(F.col(best), now))
        name = best
    keep = [F.col(c) for c in docs.columns if c.lower() not in ("item_id", "coverage", "contaminated")]
    if name is None:
        return out.select(*keep, F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(False).alias("contaminated"))
    return out.select(*keep, (-F.col(f"{best}.neg")).alias("item_id"), F.col(f"{best}.coverage"), (F.col(f"{best}.coverage") >= share).alias("contaminated"))
