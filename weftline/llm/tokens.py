"""Token counts of every prefix of a text under a byte-level BPE vocabulary, by dynamic programming.

A BPE encoding is the only way to cut a word so that each two neighbouring tokens stay apart when encoded together. So the
encoding of a prefix is that of a shorter prefix and one more token: `count[i] = count[i - len(t)] + 1`, where `t` is the one
token that ends at byte i and stays apart from the last token before it. One sweep over a word gives all its prefixes, and
one sweep over a text's words gives the table from which totals, truncation points and budgets are read without encoding again.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, slabs

#: The public pattern that cuts text into words before merges, and the same for ASCII text alone.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
ASCII_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
RUNS = re.compile(r"\s\s")
#: Words and characters of words kept with their tables per worker; beyond them the memo is emptied, which costs time and changes no result.
MEMO_WORDS, MEMO_CHARS = 600_000, 8_000_000
#: Sweeps over words that begin with the same bytes start behind so many of them.
HEAD, ONE = 5, (1,)


def _byte_letters() -> dict[int, str]:
    """The printable letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of all prefixes of texts; vocab is the content of a byte-level BPE tokenizers file."""

    def __init__(self, vocab: str):
        spec = json.loads(vocab)
        letters = {c: b for b, c in _byte_letters().items()}
        raw = lambda s: bytes(letters[c] for c in s)
        self.rank = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = i
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        special = set(self.special)
        self.names = [raw(t) for t in spec["model"]["vocab"] if t not in special]
        self.tokens = {t: i for i, t in enumerate(self.names)}
        # The lengths that tokens with the same last three bytes have, longest first; shorter tokens end in any of them.
        ends: dict[bytes, set[int]] = {}
        for t in self.tokens:
            ends.setdefault(t[-3:], set()).add(len(t))
        pairs = {t for t in self.tokens if len(t) == 2}
        for k in [*ends, *(bytes([c]) + p for p in pairs for c in range(256))]:
            ends.setdefault(k, set()).update({1} | ({2} if k[-2:] in pairs else set()))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.made = {a + b: r for (a, b), r in reversed(self.rank.items())}
        self.parts = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.right: dict[bytes, list] = {}
        self.left: dict[bytes, list] = {}
        self.apart: dict[int, bool] = {}
        self.wide, self.ascii = regex.compile(WORDS), re.compile(ASCII_WORDS, re.ASCII)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}
        self.total, self.length, self.start, self.flat = (array("q") for _ in range(4))

    def _spine(self, t: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The pieces that stand at one end of t while it is merged: each with the ranks of the merges that made and took it."""
        out, taken = [], 1 << 60
        while True:
            made = self.made.get(t, -1)
            out.append((t, made, taken))
            if made < 0:
                return out
            taken, t = made, self.parts[t][side]

    def _stay(self, first: int, then: int) -> bool:
        """Whether two tokens stay apart: no merge over their border comes before those that take its two pieces."""
        a, b = self.names[first], self.names[then]
        if a not in self.right:
            self.right[a] = self._spine(a, 1)
        if b not in self.left:
            self.left[b] = self._spine(b, 0)
        ok = True
        for x, made_x, taken_x in self.right[a]:
            for y, made_y, taken_y in self.left[b]:
                r = self.rank.get((x, y))
                if r is not None and r < taken_x and r <= taken_y and made_x < taken_y and made_y < taken_x:
                    ok = False
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        self.apart[first * len(self.names) + then] = ok
        return ok

    def word(self, text: str) -> list[int]:
        """Tokens of each prefix of one word, by characters, from the empty one on."""
        data = text.encode("utf-8", "surrogatepass")
        n, known, apart, ends, heads, base = len(data), self.tokens.get, self.apart.get, self.ends.get, self.heads, len(self.names)
        head = heads.get(data[:HEAD]) if n > HEAD else None
        last, count = (head[0].copy(), head[1].copy()) if head else ([-1], [0])
        for i in range(len(last), n + 1):
            for size in ends(data[i - 3 : i] if i > 2 else data[:i], ONE):
                j = i - size
                if j < 0:
                    continue
                t = known(data[j:i])
                if t is None:
                    continue
                if j:
                    ok = apart(last[j] * base + t)
                    if ok is None:
                        ok = self._stay(last[j], t)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[j] + 1)
                break
            if i == HEAD and n > HEAD:
                heads[data[:HEAD]] = (last.copy(), count.copy())
        if n != len(text):
            count = [0] + [c for i, c in enumerate(count) if i and (i == n or data[i] & 0xC0 != 0x80)]
        if text in ("'re", "'ve", "'ll"):  # a shorter prefix of these is cut as two words
            count[2] = 2
        return count

    def _known(self, word: str) -> int:
        counts = self.word(word)
        k = self.at[word] = len(self.total)
        self.total.append(counts[-1])
        self.length.append(len(word))
        self.start.append(len(self.flat))
        self.flat.extend(counts[1:])
        return k

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... characters of a text without special strings."""
        words = (self.ascii if text.isascii() else self.wide).findall(text)
        at = self.at
        ids = np.array([at[w] if w in at else self._known(w) for w in words], dtype=np.int64)
        total, length, start, flat = (np.frombuffer(x, dtype=np.int64) for x in (self.total, self.length, self.start, self.flat))
        n = length[ids]
        base = np.cumsum(total[ids]) - total[ids]
        first = np.cumsum(n) - n
        out = np.repeat(base, n) + flat[np.repeat(start[ids] - first, n) + np.arange(int(n.sum()))]
        # Where a prefix ends with a run of white space, the run is one word; before more text its last character isn't in it.
        for j in range(1, len(words)) if RUNS.search(text) else ():
            if words[j - 1][-1:].isspace() and words[j][0].isspace():
                run = words[j - 1] + words[j][0]
                out[first[j]] = base[j - 1] + self.word(run)[-1]
        return out

    def prefixes(self, text: str | None) -> np.ndarray:
        """counts[i]: tokens of the first i characters, as encoding just these would give; special strings are one token."""
        text = text or ""
        if len(self.at) > MEMO_WORDS or len(self.flat) > MEMO_CHARS:
            self._forget()
        if not (self.cut and any(s in text for s in self.special)):
            return np.concatenate([[0], self._ordinary(text)]) if text else np.zeros(1, dtype=np.int64)
        out, base, before = [np.zeros(1, dtype=np.int64)], 0, ""
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                inside = self._ordinary(before + part[:-1])[len(before) :]
                out.append(base + inside)
                base = base + (int(self._ordinary(before)[-1]) if before else 0) + 1
                out.append(np.array([base]))
            else:
                before = part
                if part:
                    out.append(base + self._ordinary(part))
        return np.concatenate(out)


#: The counter of a worker's last vocabulary, with its memo: tasks that follow in the same worker find words known.
_LAST: dict[str, PrefixCounter] = {}


def counter_of(vocab: str) -> PrefixCounter:
    if vocab not in _LAST:
        _LAST.clear()
        _LAST[vocab] = PrefixCounter(vocab)
    return _LAST[vocab]


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 512, text: str = "text", tables: bool = False) -> DataFrame:
    """Adds to each row n_bytes, n_tokens, over_limit, fit_chars (length of the longest prefix of at most `limit` tokens).

    With tables=True also prefix_tokens, the array of counts of all prefixes. Null text counts as empty; a column of the same
    name is replaced; repeated rows get the same counts each; an empty table gives no rows. Map-only: nothing is shuffled, and a
    worker holds one slab of texts at a time.
    """
    with open(vocab_path, encoding="utf-8") as f:
        vocab = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = "n_tokens long, fit_chars long" + ", prefix_tokens array<int>" * tables

    @F.pandas_udf(kind)
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = counter_of(vocab.value)
        for texts in batches:
            rows = []
            for run in slabs(texts):
                for t in run:
                    table = counter.prefixes(t)
                    fits = len(t) if table[-1] <= limit else int(np.flatnonzero(table <= limit)[-1])
                    rows.append((int(table[-1]), fits, *([table.astype(np.int32)] if tables else [])))
            yield pd.DataFrame(rows, columns=["n_tokens", "fit_chars", *["prefix_tokens"] * tables])

    got = fresh(docs, "tokens")
    own = ["n_bytes", "n_tokens", "over_limit", "fit_chars", *["prefix_tokens"] * tables]
    out = docs.withColumn(got, counts.asNondeterministic()(F.col(text)))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    keep = [F.col(c) for c in docs.columns if c.lower() not in own]
    return out.select(*keep, size.alias("n_bytes"), F.col(f"{got}.n_tokens"), (F.col(f"{got}.n_tokens") > limit).alias("over_limit"), F.col(f"{got}.fit_chars"), *[F.col(f"{got}.prefix_tokens")] * tables)
