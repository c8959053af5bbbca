"""Toxicity scores of whole texts by a small convolutional classifier, trained in numpy on a bounded sample, in one task.

A word is embedded by four hashed rows side by side: two hashes of the word (a collision in one is told apart by the other)
and one each of its first five and seven letters. Filters of several widths run over the word sequence; each keeps its largest
response over the whole text, and a linear layer turns these into a score. Cut-offs are calibrated by language and mapped to 0.7.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, fresh, slabs

WORD = re.compile(r"[^\W\d_]+")
#: Rows of each hashed table, numbers a row, filter widths, filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 6, (1, 2, 3), 12
#: At most so many documents of each label, and bytes of them, are learned from (a text of over 1/64 of the bytes is passed over);
#: a third is calibrated with, and there clean rows weigh more, as they are more.
SAMPLE_ROWS, SAMPLE_BYTES, CLEAN_WEIGHT = 2400, 1 << 24, 9
CUT, EPOCHS, RATE = 0.7, 5, 0.01
#: A word of a text belongs to the language in which it is most frequent among so many common words.
COMMON = 200
#: Words known to a worker; letters scored at once.
MEMO_WORDS, SLAB = 120_000, 300_000


@dataclass
class Model:
    """Fixed-size parameters: hashed rows that training has touched, filters, output layer, per-language cut-offs."""

    rows: list[tuple[np.ndarray, np.ndarray]]
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    common: dict[str, int]
    langs: list[str]
    cuts: np.ndarray


def hashed_rows(words: list[str], heads: dict[str, int] | None = None) -> np.ndarray:
    """The four table rows of each word. heads: a memo of the rows of first letters."""
    heads = {} if heads is None else heads
    out = np.empty((len(words), 4), dtype=np.int64)
    whole = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    out[:, 0], out[:, 1] = whole % np.uint64(BUCKETS), (whole >> np.uint64(32)) % np.uint64(BUCKETS)
    for column, letters in ((2, 5), (3, 7)):
        for i, w in enumerate(words):
            key = w[:letters] + str(letters)
            h = heads.get(key)
            if h is None:
                h = heads[key] = xxhash.xxh3_64_intdigest(key) % BUCKETS
            out[i, column] = h
    return out


def _responses(emb: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Max over positions of each filter's ReLU response, and where it was. Texts are padded with zero words."""
    top, where = [], []
    for f, b in zip(filters, bias, strict=True):
        w = len(f) // emb.shape[1]
        padded = np.vstack([emb, np.zeros((w, emb.shape[1]), dtype=emb.dtype)])
        n = len(emb)
        wide = np.concatenate([padded[j : j + n] for j in range(w)], axis=1) if w > 1 else padded[:n]
        r = wide @ f + b
        at = r.argmax(axis=0)
        where.append(at)
        top.append(np.maximum(r[at, np.arange(r.shape[1])], 0))
    return np.concatenate(top), where


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = 11) -> Model:
    """Stochastic gradient descent on texts and 0/1 labels; every third text is kept for the cut-offs."""
    rng, index = np.random.default_rng(seed), {}
    ids = [np.array([index.setdefault(w, len(index)) for w in WORD.findall(t.lower())], dtype=np.int32) for t in texts]
    keys = hashed_rows(list(index))
    local = [np.unique(keys[:, j], return_inverse=True) for j in range(4)]
    emb = [rng.normal(0, 0.1, (len(u), DIM)).astype(np.float32) for u, _ in local]
    row = np.stack([inv for _, inv in local], axis=1) if len(keys) else np.zeros((0, 4), dtype=int)
    width = 4 * DIM
    filters = [rng.normal(0, 1 / np.sqrt(w * width), (w * width, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    out, out_bias = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), np.float32(0)
    grads = [np.zeros_like(e) + 1e-6 for e in emb]
    second = [np.zeros_like(f) + 1e-6 for f in filters] + [np.zeros_like(b) + 1e-6 for b in bias] + [np.zeros_like(out) + 1e-6]
    vectors = lambda d: np.concatenate([emb[j][row[d, j]] for j in range(4)], axis=1) if len(d) else np.zeros((1, width), dtype=np.float32)
    learn = [i for i in range(len(texts)) if i % 3]
    rate = RATE
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for i in learn:
            d = ids[i]
            x = vectors(d)
            h, where = _responses(x, filters, bias)
            p = 1 / (1 + np.exp(-np.clip(out @ h + out_bias, -30, 30)))
            e = np.float32(p - labels[i])
            if abs(e) < 0.01:
                continue
            gh = e * out * (h > 0)
            g_out = e * h
            for k, f in enumerate(filters):
                w, gk = WIDTHS[k], gh[k * FILTERS : (k + 1) * FILTERS]
                hot = np.flatnonzero(gk)
                for c in hot:
                    at = where[k][c]
                    span = range(at, min(at + w, len(x)))
                    patch = np.zeros(w * width, dtype=np.float32)
                    patch[: len(span) * width] = x[span.start : span.stop].ravel()
                    gf = gk[c] * patch
                    second[k][:, c] += gf * gf
                    gx = (gk[c] * f[:, c])[: len(span) * width].reshape(len(span), 4, DIM)
                    f[:, c] -= rate * gf / np.sqrt(second[k][:, c])
                    second[len(WIDTHS) + k][c] += gk[c] ** 2
                    bias[k][c] -= rate * gk[c] / np.sqrt(second[len(WIDTHS) + k][c])
                    if len(d):
                        for j in range(4):
                            r = row[d[span.start : span.stop], j]
                            grads[j][r] += gx[:, j] ** 2
                            emb[j][r] -= 4 * rate * gx[:, j] / np.sqrt(grads[j][r])
            second[-1] += g_out * g_out
            out -= rate * g_out / np.sqrt(second[-1])
            out_bias -= np.float32(rate * 0.3 * e)
    # Rows that no gradient has moved carry no evidence: they count as zero, like those of unseen words.
    rows = []
    for (u, _), e, g in zip(local, emb, grads, strict=True):
        moved = (g > 2e-6).any(axis=1)
        rows.append((u[moved].astype(np.int32), e[moved]))
    del emb, grads, row, keys, local
    known = sorted({x for x in langs if x})
    seen = np.zeros((len(index), len(known)), dtype=np.int32)
    for d, lang in zip(ids, langs, strict=True):
        if lang:
            seen[np.unique(d), known.index(lang)] += 1
    share = seen / np.array([max(1, sum(x == k for x in langs)) for k in known], dtype=float)
    words = np.array(list(index), dtype=object)
    by_name = np.empty(len(words), dtype=np.int64)
    by_name[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    common: dict[str, int] = {}
    for k in range(len(known)):
        for w in np.lexsort((by_name, -share[:, k]))[:COMMON]:
            if share[w, k] > 0 and share[w].argmax() == k:
                common[words[w]] = k
    del seen, share, ids, index, words, by_name
    model = Model(rows, filters, bias, out, float(out_bias), common, known, np.full(len(known) + 1, 0.0))
    held = [i for i in range(len(texts)) if i % 3 == 0]
    scorer = Scorer(model)
    parts = [scorer.logits(run) for run in slabs((texts[i] for i in held), SLAB)]
    logits, guess = (np.concatenate([np.zeros(0, dtype=t), *(x[j] for x in parts)]) for j, t in ((0, float), (1, int)))
    everywhere = _cut(logits, labels[held])
    model.cuts[:] = everywhere
    for k in range(len(known)):
        own = guess == k
        if own.sum() >= 40 and labels[held][own].sum() >= 10 and (labels[held][own] == 0).sum() >= 10:
            model.cuts[k] = _cut(logits[own], labels[held][own])
    return model


def _cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut-off with the best F1 on these rows, in the middle of the gap that gives it; above or below all where one label is missing."""
    if not len(logits) or labels.min() == labels.max():
        return -40.0 if len(logits) and labels.min() == 1 else 40.0
    order = np.argsort(-logits, kind="stable")
    hit = np.cumsum(labels[order])
    miss = np.cumsum(1 - labels[order]) * CLEAN_WEIGHT
    f1 = 2 * hit / (hit + miss + labels.sum())
    k = int(f1.argmax())
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + below) / 2)


class Scorer:
    """Scores slabs of texts at once. What each filter makes of a word at each place of its window is kept for known words."""

    def __init__(self, model: Model):
        self.model = model
        self.emb = []
        for u, e in model.rows:
            full = np.zeros((BUCKETS, DIM), dtype=np.float32)
            full[u] = e
            self.emb.append(full)
        #: One matrix for all places of all widths: place j of a filter of width w sees rows j * 4 * DIM and following.
        width = 4 * DIM
        self.places = np.concatenate([f[j * width : (j + 1) * width] for f, w in zip(model.filters, WIDTHS, strict=True) for j in range(w)], axis=1)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.heads: dict[str, int] = {}
        self.parts = np.zeros((1024, self.places.shape[1]), dtype=np.float32)
        self.votes = np.full(1024, -1, dtype=np.int32)

    def _ids(self, words: list[str]) -> np.ndarray:
        at = self.at
        if new := list(set(words).difference(at)):
            first = len(at)
            n = first + len(new)
            at.update(zip(new, range(first, n), strict=True))
            while n > len(self.parts):
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
                self.votes = np.concatenate([self.votes, np.full_like(self.votes, -1)])
            keys = hashed_rows(new, self.heads)
            self.parts[first:n] = np.concatenate([self.emb[j][keys[:, j]] for j in range(4)], axis=1) @ self.places
            common = self.model.common
            self.votes[first:n] = [common.get(w, -1) for w in new]
        return np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language of each text: that of most of its common words; the last index without any."""
        model, gap = self.model, max(WIDTHS) - 1
        if not texts:
            return np.zeros(0), np.zeros(0, dtype=int)
        if len(self.at) > MEMO_WORDS:
            self._forget()
        words: list[str] = []
        start, length = [], []
        for t in texts:
            own = WORD.findall(t.lower()) or [""]
            start.append(len(words))
            length.append(len(own))
            words += own
            words += [""] * gap
        ids = self._ids(words)
        start, length = np.array(start), np.array(length)
        of = np.repeat(np.arange(len(texts)), length + gap)
        here = np.arange(len(ids)) - start[of] < length[of]
        parts = self.parts[ids]
        tops, col = [], 0
        for w, b in zip(WIDTHS, model.bias, strict=True):
            r = np.full((len(ids), FILTERS), b, dtype=np.float32)
            for j in range(w):
                r[: len(ids) - j] += parts[j:, col : col + FILTERS]
                col += FILTERS
            r[~here] = 0
            tops.append(np.maximum(np.maximum.reduceat(r, start, axis=0), 0))
        out = np.concatenate(tops, axis=1) @ model.out + model.out_bias
        n = len(model.langs)
        v = self.votes[ids]
        count = np.bincount(of[v >= 0] * (n + 1) + v[v >= 0], minlength=len(texts) * (n + 1)).reshape(len(texts), n + 1)
        return out.astype(float), np.where(count.any(axis=1), count.argmax(axis=1), n)

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1; 0.7 exactly at the cut-off of a text's guessed language; 0 for a text without words, which can't be toxic."""
        z, lang = self.logits(texts)
        out = 1 / (1 + np.exp(-np.clip(z - self.model.cuts[lang], -30, 30) - np.log(CUT / (1 - CUT))))
        out[[not WORD.search(t) for t in texts]] = 0
        return out


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most sample_rows labelled documents of each label. labels: doc_id, toxic (0 or 1; other rows are passed over).

    usable: a condition on the label rows that may be learned from. The ids of the sample are bounded by sample_rows, so they are
    broadcast; the texts are bounded by sample_bytes a label and go to one task, which trains; the driver gets the model alone.
    Repeated ids count once for each label, with the text of the least hash; null texts count as empty; without rows the
    model knows nothing and calls nothing toxic.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if usable is not None:
        marked = marked.where(usable)
    name = F.col("doc_id").cast("string")
    ids = bounded_sample(marked, F.col("toxic").cast("int"), sample_rows, name, name).select(F.col("payload").cast("long").alias("_id"), "cls", "rank")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang")).where(F.octet_length("text") <= sample_bytes // 64)
    one = text.join(F.broadcast(ids), "_id").groupBy("_id", "cls", "rank").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text")).alias("x"))
    held = F.sum(F.octet_length("x.text")).over(Window.partitionBy("cls").orderBy("rank", "_id"))
    rows = one.withColumn("held", held).where(F.col("held") <= sample_bytes).select("_id", "cls", "rank", "x.text", "x.lang")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([*batches, pd.DataFrame({"_id": [], "cls": [], "rank": [], "text": [], "lang": []})]).sort_values(["rank", "_id", "cls"], kind="stable")
        model = train(list(got["text"]), got["cls"].to_numpy(float), [x if isinstance(x, str) else None for x in got["lang"]])
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    fitted = rows.repartition(1).mapInPandas(fit, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else train([], np.zeros(0), [])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.7 on) for whole texts; null scores as the empty text. Map-only. Repeated rows
    get the same score each; an empty table gives no rows.

    Only the text is an input: the language that picks the cut-off is guessed from its words. Same-named columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(scorer.scores(run) for run in slabs(texts, SLAB))]))

    got = fresh(docs, "score")
    out = docs.withColumn(got, judge.asNondeterministic()(F.col(text)))
    keep = [F.col(c) for c in docs.columns if c.lower() not in ("score", "predicted")]
    return out.select(*keep, F.col(got).alias("score"), (F.col(got) >= CUT).cast("int").alias("predicted"))
