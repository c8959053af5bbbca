"""URL filters: host and path rules, and for the rest the ratio of two character language models.

Accepted and rejected URLs each train a smoothed variable-order Markov model: the chance of a byte after its last k bytes is
drawn towards that after its last k - 1, down to a uniform one, so each context is used as far as it has been seen. Counts are
kept exactly, in grouped tables over all labelled URLs. The mean log-likelihood difference per byte is cut at the place that
best separates a fifth of the labelled URLs, by hash, under models of the other four fifths, which have not seen them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, written

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Longest context in bytes, pull towards the shorter context, bins of the calibration and its range.
ORDER, PULL, BINS, RANGE = 4, 2.0, 4000, 10.0
#: Bits of a byte or of the start in a packed window; URLs and bytes of a chunk, bytes that are taken apart at once.
BITS, CHUNK, CHUNK_BYTES, PIECE = 9, 4000, 1 << 20, 1 << 18
#: Every so manieth labelled URL, by hash, sets the cut.
HELD_OUT = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    tail = url.substr(F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    tail = url.substr(F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path together; ties in code-point order) and its verdict; nulls without one."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _pieces(urls: Sequence[str]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """The lower-cased urls in runs of about PIECE bytes: index of the url, bytes, how many of them are only there as context."""
    run: tuple[list[int], list[bytes], list[int]] = ([], [], [])
    held = 0
    for i, u in enumerate(urls):
        data = u.lower().encode("utf-8", "replace")
        for at in range(0, len(data), PIECE):
            before = min(at, ORDER)
            for part, x in zip(run, (i, data[at - before : at + PIECE], before), strict=True):
                part.append(x)
            held += len(run[1][-1])
            if held >= PIECE:
                yield run
                run, held = ([], [], []), 0
    if run[0]:
        yield run


def _windows(urls: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each byte of the lower-cased urls: index of its url, and the byte with the ORDER before it, packed exactly. Run by run.

    Nine bits a byte, the oldest first: 0 before the url's start, otherwise the byte plus one.
    """
    for index, data, before in _pieces(urls):
        size = np.array([len(d) for d in data], dtype=np.int64)
        of = np.repeat(np.arange(len(data)), size)
        joined = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64) + 1
        place = np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)
        out = joined.copy()
        for k in range(1, ORDER + 1):
            earlier = np.zeros(len(joined), dtype=np.int64)
            earlier[k:] = joined[: len(joined) - k]
            out |= np.where(place >= k, earlier, 0) << (BITS * k)
        own = place >= np.array(before)[of]
        yield np.array(index)[of[own]], out[own]


def _scores(windows: DataFrame, good: str, bad: str) -> DataFrame:
    """(window, score): log-likelihood difference of a window's byte, accepted less rejected (columns with counts of each).

    Counts are exact for every context of every order: grouped tables, joined from the shortest context to the longest.
    """
    chances = None
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    # Each order's counts come from the next longer one's.
    tables = [windows.select("window", F.col(good).alias("good"), F.col(bad).alias("bad")).groupBy("window").agg(*sums)]
    for k in range(ORDER - 1, -1, -1):
        tables.insert(0, tables[0].groupBy(F.col("window").bitwiseAND((1 << BITS * (k + 1)) - 1).alias("window")).agg(*sums))
    for k, table in enumerate(tables):
        pairs = table.withColumn("context", F.shiftright("window", BITS))
        contexts = pairs.groupBy("context").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        # All windows of the two shortest orders are fewer than 2^17, whatever the input.
        near = F.broadcast if k < 2 else lambda x: x
        rows = pairs.join(near(contexts), "context")
        if chances is None:
            rows = rows.withColumns({"p": F.lit(1 / 256), "q": F.lit(1 / 256)})
        else:
            short = F.broadcast(chances) if k < 3 else chances
            rows = rows.withColumn("shorter", F.col("window").bitwiseAND((1 << BITS * k) - 1)).join(short.withColumnRenamed("window", "shorter"), "shorter")
        p = (F.col("good") + PULL * F.col("p")) / (F.col("all_good") + PULL)
        q = (F.col("bad") + PULL * F.col("q")) / (F.col("all_bad") + PULL)
        chances = written(rows.select("window", p.alias("p"), q.alias("q")))
    return chances.select("window", F.ln(F.col("p") / F.col("q")).alias("score"))


def held_out(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(31)), F.lit(HELD_OUT)) == 0


def learn(parsed: DataFrame, url: str, verdict: str) -> tuple[DataFrame, float]:
    """(url, ratio) of all distinct URLs, and the calibrated cut. All labelled rows count, repeated ones as often as they occur.

    ratio: mean log-likelihood difference per byte. URLs are taken in chunks of bounded numbers and bytes, and of a chunk each
    distinct window is one row, so that no common host weighs on one task. Where the held-out URLs lack a label, all labelled
    ones set the cut.
    """
    bad = F.sum((F.col(verdict) == "block").cast("long"))
    good = F.sum((F.col(verdict) == "allow").cast("long"))
    rows = parsed.where(F.length(F.col(url)) > 0).groupBy(F.col(url).alias("url")).agg(F.coalesce(good, F.lit(0)).alias("good"), F.coalesce(bad, F.lit(0)).alias("bad"))
    rows = written(rows)
    total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("url")), F.lit(0))).first()
    chunks = max(1, -(-total[0] // CHUNK), -(-total[1] // CHUNK_BYTES))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("url"), F.lit(chunks))).withColumn("teaches", (~held_out(F.col("url"))).cast("long"))

    kinds = ("good", "bad", "good_taught", "bad_taught")

    def count(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        weigh = [held["good"].to_numpy(), held["bad"].to_numpy()]
        weigh += [w * held["teaches"].to_numpy() for w in weigh]
        found, sums = [np.zeros(0, dtype=np.int64)], [[np.zeros(0)] for _ in kinds]
        for of, windows in _windows(list(held["url"])):
            own, at = np.unique(windows, return_inverse=True)
            found.append(own)
            for total, w in zip(sums, weigh, strict=True):
                total.append(np.bincount(at, w[of], minlength=len(own)))
        own, at = np.unique(np.concatenate(found), return_inverse=True)
        added = {k: np.bincount(at, np.concatenate(x), minlength=len(own)).astype(np.int64) for k, x in zip(kinds, sums, strict=True)}
        return pd.DataFrame({"chunk": key[0], "window": own} | added)

    def score(key: tuple, held: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("window")
        known, names = table["window"].to_numpy(), ("score", "trial")
        size, total = np.zeros(len(held)), {n: np.zeros(len(held)) for n in names}
        for of, windows in _windows(list(held["url"])):
            size += np.bincount(of, minlength=len(held))
            place = np.searchsorted(known, windows)
            for n in names:
                total[n] += np.bincount(of, table[n].to_numpy()[place], minlength=len(held))
        ratio, trial = (total[n] / np.maximum(size, 1) for n in names)
        return pd.DataFrame({"url": held["url"], "good": held["good"], "bad": held["bad"], "teaches": held["teaches"], "ratio": ratio, "trial": trial})

    windows = written(rows.groupBy("chunk").applyInPandas(count, "chunk long, window long, " + ", ".join(f"{k} long" for k in kinds)))
    final, trial = _scores(windows, "good", "bad"), _scores(windows, "good_taught", "bad_taught").withColumnRenamed("score", "trial")
    scored = windows.select("chunk", "window").join(final, "window").join(trial, "window")
    ratios = written(rows.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInPandas(score, "url string, good long, bad long, teaches long, ratio double, trial double"))
    # Held-out URLs as the models that haven't seen them judge them.
    shown = F.when(F.col("teaches") == 0, F.col("trial")).otherwise(F.col("ratio"))
    at = F.least(F.greatest((shown + RANGE) / (2 * RANGE) * BINS, F.lit(0)), F.lit(BINS - 1)).cast("int")
    bins = np.zeros((2, 2, BINS), dtype=np.int64)  # held out or not, label, bin
    for r in ratios.groupBy("teaches", at.alias("at")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
        bins[r["teaches"], :, r["at"]] = r["good"], r["bad"]
    good, bad = bins[0] if bins[0].any(axis=1).all() else bins.sum(axis=0)
    ratios = ratios.select("url", "ratio")
    if not good.any() or not bad.any():
        return ratios, 0.0 if good.any() or not bad.any() else float("inf")
    # Cut before bin i: blocked below, allowed from it on. The middle of the best places.
    right = np.concatenate([[0], np.cumsum(bad)]) / max(1, bad.sum()) + 1 - np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum())
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return ratios, float(best[len(best) // 2] / BINS * 2 * RANGE - RANGE)


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and ratio. Same-named columns are replaced.

    Rules label the URLs they fit; the models learned from these judge the others. Without blocked examples the rest is
    allowed, without allowed ones (but blocked) it is blocked. Null and empty URLs have the ratio 0. Repeated rows get the same
    answer each; of rules that fit alike the first in code-point order holds; an empty table gives no rows.
    """
    h, p, r, v, s = (fresh(pages, x) for x in ("host", "path", "rule", "verdict", "ratio"))
    parsed = pages.withColumn(h, F.coalesce(host_of(F.col(url)), F.lit(""))).withColumn(p, F.coalesce(path_of(F.col(url)), F.lit("")))
    name, verdict = rule_of(F.col(h), F.col(p), rules)
    parsed = parsed.withColumns({r: name, v: verdict})
    ratios, cut = learn(parsed, url, v)
    u = fresh(parsed, "url")
    out = parsed.join(ratios.select(F.col("url").alias(u), F.col("ratio").alias(s)), F.col(url) == F.col(u), "left").withColumn(s, F.coalesce(s, F.lit(0.0)))
    keep = [F.col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "ratio")]
    final = F.coalesce(F.col(v), F.when(F.col(s) >= cut, "allow").otherwise("block"))
    return out.select(*keep, F.col(h).alias("host"), F.col(p).alias("path"), F.col(r).alias("rule"), final.alias("verdict"), F.col(s).alias("ratio"))
