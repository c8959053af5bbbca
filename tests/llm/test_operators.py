"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import ann, chat, decontaminate, langid, licenses, mixing, neardup, tokens, toxicity, urls
from weftline.llm.common import bounded_sample

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, "a"), (2, "", "en", "a"), (2, "", "en", "a"), (3, "x" * 50_000, "en", None), (4, "one two three", "de", "b"), (None, "one two three", None, "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


def odd(spark, rows=ODD):
    """Odd rows with extra columns whose names clash with those that operators add or use."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("score", "shards", "i", "s", "b", "_size", "id", "key", "n", "coverage", "margin")})


def docs(spark, n=None):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1. Mixing


def test_targets_stop_at_the_most_and_share_the_rest():
    assert mixing.targets([10, 100, 1000], [5, 2, 1]) == [30.0, 300.0, 780.0]
    assert mixing.targets([0, 8], [5, 2]) == [0.0, 8.0]
    assert mixing.targets([], []) == []


def test_splitting_tree_keeps_quotas():
    draws = np.array([100, 0, 37, 900])
    out = mixing.split(draws, 16)
    assert (out.sum(axis=0) == draws).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1
    assert (out == mixing.split(draws, 16)).all()


def test_mix_meets_targets(spark, monkeypatch):
    d = docs(spark)
    out = mixing.mix(d).toPandas()
    assert len(out) == d.count()
    g = out.groupby("source").agg(size=("size", "sum"), own=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"), most=("size", "max"))
    assert (g["size"] == g["own"]).all() and abs(g["target"].sum() - g["size"].sum()) < 1e-6
    assert ((g["taken"] - g["target"]).abs() <= np.maximum(0.03 * g["target"], g["most"])).all()
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] == out["size"] * out["shards"].str.len()).all()
    again = mixing.mix(d.repartition(7)).toPandas().set_index("doc_id")["taken"].sort_index()
    assert (again == out.set_index("doc_id")["taken"].sort_index()).all()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    shuffled = mixing.mix(d).toPandas().set_index("doc_id")["taken"].sort_index()
    assert (shuffled == again).all()
    bad = mixing.mix(d.withColumns({c: F.lit("own") for c in ("block", "part", "src", "i", "Size", "plan_block")})).toPandas().set_index("doc_id")["taken"].sort_index()
    assert (bad == again).all()


def test_shards_are_brought_together_and_shuffled(spark):
    d = docs(spark)
    mixed = mixing.mix(d, shards=4)
    want = sorted((r["doc_id"], s) for r in mixed.collect() for s in r["shards"])
    for words in (1 << 40, 2000):
        out = mixing.shuffled(mixed.withColumn("copy", F.lit("own")), slice_words=words).withColumn("p", F.spark_partition_id()).toPandas()
        assert sorted(zip(out["doc_id"], out["shard"], strict=True)) == want
        assert (out.groupby(["shard", "slice"])["p"].nunique() == 1).all() and (out.groupby("p")[["shard", "slice"]].nunique().max() == 1).all()
        assert out["slice"].max() == 0 if words > 1e9 else out["slice"].max() > 0
        first = out[out["p"] == out["p"].iloc[0]]["doc_id"].tolist()
        assert first != sorted(first)


def test_mix_as_by_brute_force(spark):
    """Every document is drawn floor(target / size of source) times or once more; documents of a block are drawn alike; tree sums hold."""
    rows = [(i, " ".join(["w"] * (i % 37)), "en", "abcd"[min(i % 11, 3)]) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    goal = mixing.targets([int(x) for x in out.groupby("source")["size"].sum()], [5, 2, 1, 5])
    for (_, own), g in zip(out.groupby("source"), goal, strict=True):
        total = own["size"].sum()
        assert (own["source_size"] == total).all() and own["target"].to_numpy() == pytest.approx(g)
        copies = own["shards"].str.len()[own["size"] > 0]
        assert set(copies) <= {int(g // total), int(g // total) + 1} and max(copies) <= 3
        assert abs(own["taken"].sum() - g) <= own["size"].max() * 2
    per_shard = np.bincount([s for x in out["shards"] for s in x], weights=[n for n, x in zip(out["size"], out["shards"], strict=True) for _ in x])
    assert per_shard.min() > 0.5 * per_shard.mean()  # shards have equal numbers of blocks, whose words differ


def test_mix_odd_rows(spark):
    out = mixing.mix(odd(spark)).toPandas()
    assert len(out) == len(ODD) and sorted(out["size"]) == [0, 0, 0, 1, 3, 3]
    assert mixing.mix(odd(spark, [])).count() == 0


# 2. Token counts


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        return tokens.PrefixCounter(f.read())


def test_every_prefix_is_counted_as_encoded(counter):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    parts = [" ", "  ", "\n", "\t", "'", "'re", "'ll", "a", "the", "é", "ß", "漢", "1", "23", "!", "<|endoftext|>", "<|end", "İ", "😀", "ing", "s", "\r\n", "_"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        table = counter.prefixes(text)
        assert [int(x) for x in table] == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text


def test_totals_and_fits(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = tokens.token_counts(docs(spark), path, tables=True).toPandas()
    library = Tokenizer.from_file(path)
    assert list(out["n_tokens"]) == [len(e.ids) for e in library.encode_batch(list(out["text"]), add_special_tokens=False)]
    assert (out["over_limit"] == (out["n_tokens"] > 512)).all()
    for r in out.head(20).itertuples():
        assert r.prefix_tokens[-1] == r.n_tokens and r.prefix_tokens[r.fit_chars] <= 512
    odd_out = tokens.token_counts(odd(spark), path).toPandas()
    assert list(odd_out["n_tokens"])[:3] == [0, 0, 0] and list(odd_out["n_bytes"])[3] == 50_000


# 3. Quotation links

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "Hello there my friend\nHow does the engine work?"), (1, 1, "assistant", "It reads and writes."), (1, 2, "user", "Something else entirely here"),
        (1, 3, "assistant", "On Monday A wrote:\n> Hello there   my FRIEND\n> how does the engine work?\nBy plans."), (1, 4, "user", ">> It reads and writes.\n> By plans.\nThanks"),
        (1, 5, "user", "> reads and\n> writes.  It reads\n> and writes.\nwrapped"), (1, 6, "user", "> hello there my friend how does\n> the engine work?\nacross lines"),
        (2, 0, "user", "> Hello there my friend\nunknown"), (None, None, None, None), (3, 0, "user", ""),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in chat.linked(spark.createDataFrame(rows, CONVERSATIONS).withColumn("anchor", F.lit(1))).collect()}
    assert (out[1, 3]["reply_to"], out[1, 3]["text"], out[1, 3]["quotes"], out[1, 3]["linked"]) == (0, "By plans.", 1, 1)
    assert (out[1, 4]["reply_to"], out[1, 4]["text"], out[1, 4]["linked"]) == (3, "Thanks", 2)
    assert out[1, 5]["reply_to"] == 1 and out[1, 6]["reply_to"] == 0
    assert out[2, 0]["reply_to"] is None and out[2, 0]["text"] == "unknown" and out[None, None]["text"] == "" and out[3, 0]["quotes"] == 0
    order = [r["turn"] for r in chat.ordered(chat.linked(spark.createDataFrame(rows, CONVERSATIONS))).collect() if r["conv_id"] == 1]
    assert order.index(3) > order.index(0) and order.index(4) > order.index(3) and order[0] == 0
    assert chat.linked(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_rows_of_one_turn_keep_their_own_links(spark):
    rows = [(1, 0, "a", "first words of all"), (1, 1, "a", "plain words"), (1, 1, "b", "> first words of all\nyes"), (1, 1, "b", "> first words of all\nyes"), (1, 1, "c", "> never said by anyone\nno")]
    out = sorted((r["role"], r["quotes"], r["linked"], r["reply_to"]) for r in chat.linked(spark.createDataFrame(rows, CONVERSATIONS)).collect() if r["turn"] == 1)
    assert out == [("a", 0, 0, None), ("b", 1, 1, 0), ("b", 1, 1, 0), ("c", 1, 0, None)]


def test_links_as_by_sql(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(12)
    say = lambda: "\n".join(rng.choice(["", "\n"]) + " ".join(rng.choice("alpha Beta gamma, delta. Eps! zeta? eta Theta".split()) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 4)))
    rows = []
    for conv in range(60):
        said: list[str] = []
        for turn in range(rng.randint(1, 8)):
            parts = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.7:
                    mark = rng.choice([">", "> ", ">> ", " > > ", ">>> "])
                    lines = rng.choice(said).split("\n")
                    k = rng.randrange(len(lines))
                    if rng.random() < 0.3:
                        parts.append(rng.choice(["On Friday X wrote:", "Am Montag schrieb:"]))
                    parts.append("\n".join(mark + x for x in lines[k : k + rng.randint(1, 3)]))
                parts.append(rng.choice([say(), "", " \t", "a > b"]))
            text = rng.choice(["\n", "\r\n"]).join(parts)
            said.append(say() if not parts else text)
            rows.append((conv if rng.random() < 0.97 else None, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant", None]), text if rng.random() < 0.97 else None))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows.append((99, 0, "user", ">" * 30_000 + " deep"))
    got = chat.linked(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    cursor = duckdb.sql(chat.SQL)
    fields = cursor.columns
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(key(r[f] for f in fields) for r in got) == sorted(map(key, cursor.fetchall()))
    assert sum(r["linked"] for r in got) > 50 and any(r["quotes"] > r["linked"] for r in got)


# 4. Licenses

FILES = "key long, path string, text string"
GPL_NOTICE = """/*
 * Copyright (C) 2021  Jane Doe <jane@example.org>
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
int main() { return 0; }
"""


def test_headers_and_inheritance(spark):
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/q/a.py", "x = 1"), (3, "p/q/b.py", "y\nLicensed under the Apache License, Version 2.0.\nz"), (4, "p/r/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "p/r/s/c.py", None), (6, "other/d.py", ""), (7, None, "Licensed under CC BY-NC 4.0."), (8, "e.py", "our license is nice and long and says nothing that a template says"), (2, "p/q/a.py", "x = 1"),
        (2, "p/q/a.py", "SPDX-License-Identifier: ISC"), (None, None, None),
    ]
    given = spark.createDataFrame(rows, FILES).withColumns({c: F.lit("own") for c in ("h", "unit", "license", "th", "at", "name", "score")})
    got = [tuple(r[c] for c in ("key", "own_license", "license", "inherited_from")) for r in licenses.scan(given).collect()]
    assert len(got) == len(rows) and got.count((2, None, "MIT", "p")) == 2 and got.count((2, "ISC", "ISC", None)) == 1
    out = {k: (a, b, c) for k, a, b, c in got}
    assert out[1] == ("MIT", "MIT", None) and out[3] == ("Apache-2.0", "Apache-2.0", None) and out[None] == (None, None, None)
    assert out[4][0] == "GPL-3.0" and out[5] == (None, "GPL-3.0", "p/r") and out[6] == (None, None, None) and out[8] == (None, None, None)
    assert licenses.scan(spark.createDataFrame([], FILES)).count() == 0


def test_headers_as_they_are_written(spark):
    heads = [
        ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("Copyright 2020 Jane Doe. Licensed under the MIT license.", "MIT"),
        (GPL_NOTICE, "GPL-3.0"), (GPL_NOTICE.replace("GNU General", "GNU Affero General"), "AGPL-3.0"), ("Some prose. Licensed under CC BY-SA 4.0. More prose of many words.", "CC-BY-SA-4.0"),
        ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal", "MIT"),
        ("the free software in our garden grows without copyright", None), ("\n" * 50_000 + "license " * 50_000, None),
    ]
    rows = [(i, f"d{i}/a.py", t) for i, (t, _) in enumerate(heads)] + [(100 + i, f"e{i}/b.py", f"prose of words number {i} and the like of it") for i in range(200)]
    out = {r["key"]: r["own_license"] for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert [out[i] for i in range(len(heads))] == [want for _, want in heads]


def test_cosines_as_by_brute_force(spark):
    import math
    import re
    from collections import Counter

    rng = random.Random(9)
    lines = ["Released under the MIT license", "licensed under GNU General Public License version 3 or so", "all the prose, v. 2.0.", "copyright notice of the software", "CC BY 4.0 is the license..", "under apache license 2.0 terms", "nothing here"]
    rows = [(i, f"d{i}/a.py", "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 4)))) for i in range(80)]
    out = {r["key"]: (r["own_license"], r["own_score"]) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    terms = lambda t: [w for w in (x.strip(".") for x in re.split(r"[^a-z0-9.]+", t.lower())) if w]
    seen = Counter(t for _, _, text in rows for t in set(terms(text)))
    idf = lambda t: math.log((len(rows) + 1) / (1 + seen[t])) + 1
    vector = lambda text: {t: c * idf(t) for t, c in Counter(terms(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    models = [(name, vector(s)) for name, s in licenses.templates()]
    for i, _, text in rows:
        units = [text, *text.split("\n")]
        units += [s for u in text.split("\n") for s in re.sub(licenses.STOP, r"\1\n", u).split("\n")]
        scores = []
        for u in {u for u in units if re.search(licenses.ANCHOR, u)}:
            v = vector(u)
            scores += [(-round(sum(w * m.get(t, 0) for t, w in v.items()) / norm(v) / norm(m), 6), name) for name, m in models]
        best = min([x for x in scores if -x[0] >= licenses.SIMILAR], default=(None, None))
        assert out[i][0] == best[1] and (best[0] is None or out[i][1] == pytest.approx(-best[0], abs=2e-6)), text


def test_every_term_of_a_header_has_its_document_frequency(spark):
    header = "This project is released under the MIT license"
    rows = [(i, f"d{i}/a.py", "this project is here" + (f"\n{header}" if i % 50 == 0 else "")) for i in range(400)]
    out = {r["key"]: r["own_score"] for r in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    n, seen = len(rows), {}
    for _, _, text in rows:
        for t in set(text.lower().split()):
            seen[t] = seen.get(t, 0) + 1
    idf = lambda t: np.log((n + 1) / (1 + seen.get(t, 0))) + 1
    words, template = header.lower().split(), "released under the mit license".split()
    size, norm = (sum(idf(t) ** 2 for t in x) ** 0.5 for x in (words, template))
    assert out[0] == pytest.approx(sum(idf(t) ** 2 for t in template) / size / norm, abs=2e-6)
    assert out[1] is None


# Samples


def test_samples_hold_distinct_keys(spark):
    rows = [("hot text", "a")] * 4000 + [(f"text {i}", "a") for i in range(60)] + [("x" * 5000, "b"), (None, "b"), ("y", None), ("z", "b"), ("z", "b")]
    d = spark.createDataFrame(rows, "t string, c string").repartition(5)
    got = bounded_sample(d, F.col("c"), 20, F.col("t"), F.col("t"), max_bytes=1 << 16).toPandas()
    a = got[got["cls"] == "a"]
    assert len(a) == 20 == a["payload"].nunique() and set(got[got["cls"] == "b"]["payload"]) == {"z"}
    everything = bounded_sample(d, F.col("c"), 1000, F.col("t"), F.col("t"), max_bytes=1 << 20).toPandas()
    assert sorted(everything[everything["cls"] == "a"]["payload"]) == sorted({t for t, c in rows if c == "a"})
    again = bounded_sample(d.repartition(3), F.col("c"), 20, F.col("t"), F.col("t"), max_bytes=1 << 16).toPandas()
    assert sorted(again["payload"]) == sorted(got["payload"])
    tight = bounded_sample(d, F.col("c"), 1000, F.col("t"), F.col("t"), max_bytes=640).toPandas()
    assert tight[tight["cls"] == "a"]["payload"].str.len().sum() <= 640
    assert bounded_sample(d.limit(0), F.col("c"), 20, F.col("t"), F.col("t")).count() == 0


# 5. Language


def test_pieces_hold_the_whole_text():
    text = "Ab cd " * 200 + "x" * 1000 + " end"
    assert b"".join(langid.cut_up(text)).decode() == text.lower() and max(map(len, langid.cut_up(text))) <= langid.PIECE


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = langid.learn(d, usable=part != 2)
    out = langid.identify(d.where(part == 2), model).toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() >= 0.98 and out["score"].between(0, 1).all() and out["rejected"].mean() <= 0.05
    rng = random.Random(4)
    noise = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)),) for n in (60, 300, 2000) for _ in range(10)], "text string")
    assert langid.identify(noise, model).where("rejected").count() >= 27
    o = langid.identify(odd(spark), model).toPandas()
    assert list(o["lang_pred"])[:3] == ["und"] * 3 and list(o["rejected"])[:3] == [True] * 3
    assert o["lang_pred"][4] == o["lang_pred"][5] and o["score"][4] == o["score"][5]
    assert langid.identify(odd(spark), langid.Model({})).where("lang_pred <> 'und'").count() == 0


def test_language_by_plain_compression():
    import zstandard

    model = langid.Model({"a": b"the cat sat on the mat and the dog " * 40, "b": b"der hund und die katze sind im haus " * 40})
    how = langid.Classifier(model.dicts)
    for text in ("The dog and the cat", "die katze und der hund", "x" * 9000 + " the cat"):
        sizes = []
        for data in model.dicts.values():
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.BLOCK, dict_size=len(data), min_match=langid.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            raw = text.lower().encode()
            sizes.append(sum(len(coder.compress(raw[i : i + langid.BLOCK])) for i in range(0, len(raw), langid.BLOCK)))
        lang, score, margin = how.predict(text)
        assert lang == "ab"[int(np.argmin(sizes))] and margin == pytest.approx(abs(sizes[0] - sizes[1]) / min(sizes) ** 0.5) and 0 < score <= 1
    tie = langid.Classifier({"b": b"same", "a": b"same"})
    assert tie.predict("some words")[0] == "b"


# 6. Toxicity


def _toxic_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(500):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vilething", "badword"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "s", int(i % 4 == 0)))
    return spark.createDataFrame(rows, SCHEMA + ", toxic int")


def test_toxicity_learns_words(spark):
    d = _toxic_rows(spark)
    model = toxicity.learn(d, d.select("doc_id", "toxic").where("doc_id < 400"))
    out = toxicity.score(d.where("doc_id >= 400"), model).toPandas()
    assert (out["predicted"] == out["toxic"]).mean() >= 0.95 and ((out["score"] >= 0.7).astype(int) == out["predicted"]).all()
    o = toxicity.score(odd(spark), model).toPandas()
    assert len(o) == len(ODD) and o["score"].between(0, 1).all() and o["score"][4] == o["score"][5] and o["score"][0] == o["score"][1]
    assert toxicity.score(odd(spark), toxicity.learn(d, d.select("doc_id", "toxic").limit(0))).where("predicted = 0").count() == len(ODD)
    again = toxicity.learn(d.unionByName(d).repartition(3), d.select("doc_id", "toxic").where("doc_id < 400").repartition(5))
    assert (again.out == model.out).all() and (again.cuts == model.cuts).all()


def test_scores_as_by_plain_convolution(spark):
    d = _toxic_rows(spark).toPandas()
    model = toxicity.train(list(d["text"][:200]), d["toxic"][:200].to_numpy(float), list(d["lang"][:200]))
    tables = []
    for rows, values in model.rows:
        tables.append(dict(zip(rows.tolist(), values, strict=True)))
    zero = np.zeros(toxicity.DIM)
    texts = [*d["text"][200:240], "", "one", "badword " * 3000]
    got, _ = toxicity.Scorer(model).logits(texts)
    for t, z in zip(texts, got, strict=True):
        words = t.split() or [""]
        keys = toxicity.hashed_rows(words)
        vec = [np.concatenate([tables[j].get(int(keys[i, j]), zero) for j in range(4)]) for i in range(len(words))]
        tops = []
        for f, b, w in zip(model.filters, model.bias, toxicity.WIDTHS, strict=True):
            best = np.zeros(toxicity.FILTERS)
            for i in range(len(vec)):
                window = np.concatenate([vec[i + j] if i + j < len(vec) else np.zeros(4 * toxicity.DIM) for j in range(w)])
                best = np.maximum(best, window @ f + b)
            tops.append(best)
        assert z == pytest.approx(float(np.concatenate(tops) @ model.out + model.out_bias), abs=1e-3)


# 7. Near duplicates


def test_classes_as_by_brute_force(spark):
    d = docs(spark)
    mine = {r["id"]: r["class_id"] for r in neardup.classes(d).collect()}
    shingler = neardup.Shingler()
    sets = {r["doc_id"]: set(shingler(r["text"])[1].tolist()) for r in d.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and len(sets[i] & sets[j]) >= 0.82 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for i in ids:
        assert mine[i] == mine[find(i)] <= i
    for i in ids:  # what is joined is similar to a member of its class
        if mine[i] != i:
            assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in ids if j != i and mine[j] == mine[i]) >= 0.75


def test_chains_odd_rows_and_kept(spark):
    words = [f"w{i}" for i in range(200)]
    chain = [(100 + k, " ".join([f"c{j}" for j in range(k)] + words[k:]), "en", "a") for k in range(0, 40, 8)]
    rows = ODD + chain + [(500, chain[0][1].upper() + "!", "en", "b")]
    out = {r["id"]: r["class_id"] for r in neardup.classes(odd(spark, rows)).collect()}
    assert all(out[c[0]] == 100 for c in chain) and out[500] == 100 and out[1] == 1 and out[2] == 2
    assert neardup.kept(odd(spark, rows)).where("doc_id >= 100").count() == 1
    assert neardup.kept(odd(spark, rows)).columns == odd(spark).columns
    assert neardup.kept(odd(spark, [])).count() == 0


def _family(n, pairs, seed=6):
    """Texts that share a passage, at 0.75 of each other by shingles; of each of the first pairs, two are at 0.83."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    passage, out = [word() for _ in range(124)], []
    for i in range(n - pairs):
        own = [word() for _ in range(20)]
        out.append((i, " ".join(passage + own)))
        if i < pairs:
            out.append((n - pairs + i, " ".join(passage + own[:8] + [word() for _ in range(12)])))
    return out


def test_no_link_of_a_template_family_is_lost(spark):
    n, pairs = 1000, 100
    rows = _family(n, pairs)
    out = {r["id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingler = neardup.Shingler()
    sets = {i: set(shingler(t)[1].tolist()) for i, t in rows}
    for i in range(pairs):
        a, b, other = sets[i], sets[n - pairs + i], sets[pairs + i]
        assert len(a & b) / len(a | b) > 0.82 and len(a & other) / len(a | other) < 0.77
    assert [i for i in range(pairs) if out[n - pairs + i] != i] == []
    assert len(set(out.values())) == n - pairs


def test_texts_at_the_least_similarity_share_one_of_their_rarest():
    rng = np.random.default_rng(4)
    idf = (1 + 0.1 * rng.random(neardup.DF_BUCKETS)).astype(np.float32)
    for _ in range(300):
        base = rng.choice(1 << 32, 60, replace=False).astype(np.uint32)
        a, b = (np.sort(np.unique(np.concatenate([base[: rng.integers(45, 61)], rng.integers(0, 1 << 32, rng.integers(0, 8), dtype=np.uint32)]))) for _ in range(2))
        ta, tb = (rng.integers(1, 4, len(x)).astype("<u4").tobytes() for x in (a, b))
        if neardup.similarity(a.tobytes(), ta, b.tobytes(), tb, idf) >= neardup.SIMILAR:
            assert len(np.intersect1d(neardup.rarest(a, neardup.weights(a, ta, idf), idf), neardup.rarest(b, neardup.weights(b, tb, idf), idf)))


def test_texts_that_share_no_rare_shingle_are_not_compared(spark):
    rows = _family(300, 0)
    long = [(i, t + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i, t in rows]
    for texts, left in ((long, 0), (rows, 300)):
        base = neardup.shingled(spark.createDataFrame(texts, "id long, text string"), "id", "text")
        members = base.select("key", F.col("key").alias("own"))
        assert neardup._open(members, base.select("key", "shingles", "times"), neardup.idf_table(base)).count() == left


def test_undamped_idf_would_split_a_group_of_copies(spark):
    """300 texts at 0.87 of each other by plain shingles: one class. By undamped idf they are below 0.8 of each other."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    passage = [word() for _ in range(130)]
    rows = [(i, " ".join([*passage, word(), word(), word(), word(), *[word() for _ in range(5)]])) for i in range(300)] + [(1000 + i, " ".join(word() for _ in range(100))) for i in range(300)]
    base = neardup.shingled(spark.createDataFrame(rows, "id long, text string"), "id", "text").toPandas().set_index("id")
    sets = {i: np.frombuffer(s, dtype="<u4") for i, s in base["shingles"].items()}
    df = {}
    for s in sets.values():
        for x in s.tolist():
            df[x] = df.get(x, 0) + 1
    weigh = lambda s: sum(np.log((len(rows) + 1) / (df[x] + 1)) + 1 for x in s)
    both, either = set(sets[0].tolist()) & set(sets[1].tolist()), set(sets[0].tolist()) | set(sets[1].tolist())
    assert len(both) / len(either) > 0.86 and weigh(both) / weigh(either) < 0.8
    out = {r["id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert {out[i] for i in range(300)} == {0} and len({out[1000 + i] for i in range(300)}) == 300


def test_links_of_a_large_group_as_by_weighted_brute_force(spark):
    """Classes of 700 texts, most of them near copies of a few originals with one to many words changed, and exact copies."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows, originals = [], [[word() for _ in range(rng.randint(40, 150))] for _ in range(6)]
    for i in range(700):
        t = list(originals[0] if i % 2 else rng.choice(originals))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t + t[: rng.choice([0, 0, 30])])))
    d = spark.createDataFrame(rows, "id long, text string")
    mine = {r["id"]: r["class_id"] for r in neardup.classes(d, "id").collect()}
    base = neardup.shingled(d, "id", "text")
    idf, held = neardup.idf_table(base), base.toPandas()
    root = {i: i for i in held["id"]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for x in range(len(held)):
        for y in range(x + 1, len(held)):
            a, b = held.iloc[x], held.iloc[y]
            if 0.7 < len(a["shingles"]) / len(b["shingles"]) < 1.43 and neardup.similarity(a["shingles"], a["times"], b["shingles"], b["times"], idf) >= neardup.SIMILAR:
                links += mine[a["id"]] != mine[b["id"]]
                low, high = sorted((find(a["id"]), find(b["id"])))
                root[high] = low
    assert links == 0 and {i: find(i) for i in mine} == mine


def test_consistent_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    b = np.concatenate([a[:320], rng.integers(0, 1 << 32, 80, dtype=np.uint32)])
    s, w = neardup.Sampler(), np.ones(400, dtype=np.float32)
    hits = [np.mean(np.equal(*s.bands([np.sort(a ^ np.uint32(x)), np.sort(b ^ np.uint32(x))], [w, w]))) for x in rng.integers(0, 1 << 32, 100)]
    assert abs(np.mean(hits) - (320 / 480) ** 3) < 0.06


# 8. URLs


def test_url_rules_and_model(spark):
    rows = [(1, "http://A.Example.ORG/es/1?x"), (2, "https://example.org/en/12"), (3, "https://x.org/en/2#t"), (4, "http://a.com/fr/x"), (5, "http://a.com/de/"), (6, "http://b.net/fr/good"), (7, None), (8, "no scheme"), (9, ""), (10, "http://notorg"), (11, "https://org")]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("x"))).collect()}
    assert [out[i]["rule"] for i in range(1, 12)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None]
    assert [out[i]["verdict"] for i in range(1, 6)] == ["block", "block", "allow", "allow", "block"]
    assert (out[1]["host"], out[1]["path"], out[7]["host"], out[8]["path"], out[11]["path"]) == ("a.example.org", "/es/1", "", "", "")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    judged = urls.judge(pages).toPandas()
    assert set(judged["verdict"]) <= {"allow", "block"} and judged["verdict"].notna().all()
    known = judged[judged["rule"].notna()]
    assert ((known["ratio"] > 0) == (known["verdict"] == "allow")).mean() > 0.9
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_counts_are_exact_for_many_contexts(spark):
    rng = random.Random(5)
    rows = [(i, f"http://{'a.org/' if i % 2 else 'a.com/de/'}" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))) for i in range(3000)] + [(3000, "http://b.net/some/page"), (3001, "ÄB")]
    counts = [{}, {}]

    def grams(url):
        data = url.lower().encode()
        for i, byte in enumerate(data):
            for k in range(5):
                yield (k, i if i < k else k, data[max(0, i - k) : i]), byte

    for i, url in rows[:3000]:
        for context, byte in grams(url):
            for x in (context, (context, byte)):
                counts[i % 2 == 0][x] = counts[i % 2 == 0].get(x, 0) + 1
    assert len({x for c in counts for x in c}) > 1 << 17
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(out) == len(rows)
    for i in (0, 1, 2, 1501, 3000, 3001):
        total, p = 0.0, [1 / 256, 1 / 256]
        for context, byte in grams(rows[i][1]):
            if context[0] == 0:
                p = [1 / 256, 1 / 256]
            p = [(c.get((context, byte), 0) + 2 * x) / (c.get(context, 0) + 2) for c, x in zip(counts, p)]
            if context[0] == 4:
                total += np.log(p[0] / p[1])
        assert out[i]["ratio"] == pytest.approx(total / len(rows[i][1].lower().encode()), abs=1e-9)


def test_verdicts_of_urls_without_a_rule(spark):
    """Held out: allowed and blocked paths differ in their words; on hosts without a rule they are told apart."""
    rng = random.Random(7)
    good, bad = (["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)] for _ in range(2))
    path = lambda words: "/".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(4))
    rows = [(f"http://h{i % 50}.org/{path(good)}", None) for i in range(1500)] + [(f"http://h{i % 50}.com/de/{path(bad)}", None) for i in range(1500)]
    rows += [(f"http://h{i % 50}.net/{path(good)}", "allow") for i in range(300)] + [(f"http://h{i % 50}.net/{path(bad)}", "block") for i in range(300)]
    out = urls.judge(spark.createDataFrame(rows * 2, "url string, want string")).toPandas()
    rest = out[out["want"].notna()]
    assert len(out) == 2 * len(rows) and rest["rule"].isna().all() and (rest["verdict"] == rest["want"]).mean() > 0.9


def test_long_urls_are_taken_apart_piece_by_piece(monkeypatch):
    rng = random.Random(1)
    long = ["http://a.org/" + "".join(rng.choice("abcé/") for _ in range(n)) for n in (0, 3, 700, 40, 5000)]
    whole = [np.concatenate(x) for x in zip(*urls._windows(long))]
    monkeypatch.setattr(urls, "PIECE", 64)
    pieces = list(urls._windows(long))
    assert len(pieces) > 20 and all((np.concatenate(x) == w).all() for x, w in zip(zip(*pieces), whole))


# 9. Nearest neighbours


def test_recall_and_exact_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e, F.col("vec_id") % 50 == 0).toPandas()
    p = e.toPandas().sort_values("vec_id")
    ids, x = p["vec_id"].to_numpy(), np.stack(p["embedding"]).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = unit @ unit[ids == q][0]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]])
        hits += len(best & set(own["vec_id"]))
        assert list(own.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(own["score"], [s[ids == v][0] for v in own["vec_id"]], atol=1e-12)
    assert hits / len(got) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 1.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in out] == [(0, 1), (0, 6), (0, 50), (50, 1), (50, 6), (50, 0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_extreme_and_unequal_vectors(spark):
    big, small = 1e200, 1e-200
    rows = [(0, [big, 0.0]), (1, [big, big]), (2, [small, small * 2]), (3, [0.0, 5e-324]), (50, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 1.0]), (5, [2.0, 1.0, 0.0]), (6, [1.0]), (100, [3.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], round(r["score"], 6)) for r in out] == [(0, 1, 0.707107), (0, 2, 0.447214), (0, 3, 0.0), (50, 5, 0.894427), (50, 4, 0.0), (100, 6, 1.0)]


def test_blocks_of_queries_and_pruning(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    x = (centres[:, None, :] + 0.12 * rng.normal(size=(60, 50, 32))).reshape(-1, 32)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, ann.search(e, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(ann, "BLOCK", 13)
    assert sorted(map(tuple, ann.search(e, F.col("vec_id") % 50 == 0).collect())) == one
    unit = ann.units(x)
    index = ann.MultiIndex(ann.codes(unit, ann.rotations(unit)), np.arange(len(x)))
    hits = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        rows = index.within(index.code[q], 24, 6)
        hits += len(set(np.argsort(-s)[:5]) & set(rows.tolist()))
    assert hits / 300 > 0.9 and index.touched / 60 < 0.1 * len(x)


def test_within_a_radius_as_by_brute_force():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 256, (2000, 8)).astype(np.uint8)
    index = ann.MultiIndex(code, np.arange(2000))
    for radius in (5, 15, 24, 30, 40):
        q = rng.integers(0, 256, 8).astype(np.uint8)
        far = ann.POPCOUNT[code ^ q].sum(axis=1, dtype=int)
        assert index.within(q, radius, 0).tolist() == np.flatnonzero(far <= radius).tolist()


def test_an_id_repeated_more_than_k_times_takes_one_place(spark):
    rows = [(0, [1.0, 0.0]), *[(1, [1.0, 0.01])] * 30, *[(i, [1.0, 0.1 * i]) for i in range(2, 9)]]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    out = ann.search(e, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in out] == [(i, i) for i in range(1, 6)]


# 10. Decontamination


def _tiles(doc, item, least):
    """Greedy string tiling without hashes."""
    used_d, used_t, out = set(), set(), []
    while True:
        best, found = least, []
        for q in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while q + k < len(item) and p + k < len(doc) and item[q + k] == doc[p + k] and q + k not in used_t and p + k not in used_d:
                    k += 1
                if k > best:
                    best, found = k, [(p, q)]
                elif k == best:
                    found.append((p, q))
        if not found:
            return out
        for p, q in found:
            if not (used_d & set(range(p, p + best)) or used_t & set(range(q, q + best))):
                used_d |= set(range(p, p + best))
                used_t |= set(range(q, q + best))
                out.append((p, q, best))


def test_tiles_as_by_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        few = rng.choice([1, 2, 3, 6])
        item = [rng.randint(1, few) for _ in range(rng.randint(1, 14))]
        doc = [rng.randint(1, few + 1) for _ in range(rng.randint(0, 40))]
        got = decontaminate.tile(np.array(doc, dtype=np.uint64), np.array(item, dtype=np.uint64), 3)
        assert got == _tiles(doc, item, min(3, len(item))), (doc, item)


def test_repeated_tokens_are_tiled_without_listing_pairs():
    import time

    one = np.array([5], dtype=np.uint64)
    began = time.time()
    assert [x[2] for x in decontaminate.tile(np.repeat(one, 200_000), np.repeat(one, 2000), 4)] == [2000]
    two = np.tile(np.array([5, 5, 5, 5, 7], dtype=np.uint64), 2000)
    assert sum(x[2] for x in decontaminate.tile(np.tile(np.array([5, 5, 5, 5, 9], dtype=np.uint64), 20_000), two, 4)) == 8000
    assert time.time() - began < 5


def test_best_item_as_by_tiling_all():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i * 7 % 101, " ".join(["what", "is", "the", "name", "of"] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))])) for i in range(60)] + [(500, "w1 w2"), (501, "w1 w2")]
    tiler = decontaminate.Tiler(items, 4)
    ids = {w: i + 1 for i, w in enumerate(sorted({w for _, t in items for w in t.split()}))}
    for _ in range(40):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(items)[1].split()[: rng.randint(1, 15)] + [rng.choice([*vocabulary, "other"])]
        best = (None, 0.0)
        for i, t in sorted(items):
            item = [ids[w] for w in t.split()]
            share = sum(x[2] for x in _tiles([ids.get(w, 0) for w in words], item, min(4, len(item)))) / len(item)
            if share > best[1]:
                best = (i, share)
        got = tiler.best(" ".join(words))
        assert got[0] == best[0] and got[1] == pytest.approx(best[1])


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    d, bench = docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.covered(odd(spark).unionByName(d.limit(100).select("doc_id", "text", "lang", "source"), allowMissingColumns=True), bench).select("doc_id", "item_id", "contaminated").collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 4000)
    assert len(list(decontaminate.blocks(bench))) > 2
    got = sorted(map(tuple, decontaminate.covered(odd(spark).unionByName(d.limit(100).select("doc_id", "text", "lang", "source"), allowMissingColumns=True), bench).select("doc_id", "item_id", "contaminated").collect()), key=str)
    assert got == want


def test_planted_and_reordered_passages(spark):
    item = " ".join(f"q{i}" for i in range(30))
    w = item.split()
    rows = [(11, f"before {item} after", "en", "a"), (12, " ".join(w[20:] + ["x"] + w[10:20] + ["y"] + w[:10]), "en", "a"), (13, " ".join(w[:10]), "en", "a"), (14, "clean text of many words", "en", "a"), (15, "A b!", "en", "a"), *ODD]
    bench = spark.createDataFrame([(7, item), (8, "a B"), (9, None), (10, ""), (None, "clean text")], "item_id long, text string")
    out = {r["doc_id"]: (r["item_id"], round(r["coverage"], 3), r["contaminated"]) for r in decontaminate.covered(odd(spark, rows), bench).collect()}
    assert out[11] == (7, 1.0, True) and out[12] == (7, 1.0, True) and out[13] == (7, 0.333, False) and out[14][2] is False and out[15] == (8, 1.0, True)
    assert decontaminate.covered(odd(spark), bench.limit(0)).where("contaminated").count() == 0


# All


def test_empty_tables_and_columns(spark):
    none = odd(spark, [])
    assert langid.identify(none, langid.learn(none)).count() == 0
    assert neardup.classes(none).count() == 0


def test_every_operator_takes_an_empty_table(spark):
    import public_tokenizers

    none = odd(spark, [])
    assert tokens.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert toxicity.score(none, toxicity.learn(none, none.select("doc_id", F.lit(1).alias("toxic")))).count() == 0
    assert decontaminate.covered(none, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    assert mixing.shuffled(mixing.mix(none)).count() == 0 and neardup.kept(none).count() == 0


def test_long_texts_and_many_repeats_are_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    long = " ".join(f"word{i % 977}" for i in range(150_000)) + " é漢" + "x" * 20_000
    rows = [(1, long, "en", "a")] * 3
    got = tokens.token_counts(odd(spark, rows), path).toPandas()
    assert set(got["n_tokens"]) == {len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)}
    item = " ".join(f"q{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.covered(odd(spark, [(1, long + " " + item, "en", "a")] * 2), bench).toPandas()
    assert list(out["contaminated"]) == [True, True] and set(out["coverage"]) == {1.0}
