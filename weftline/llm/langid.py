"""Language identification by compression: the language whose raw-content dictionary shortens a text most."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, fresh, slabs, written

#: Distinct texts per language that are learned from, bytes of a dictionary, bytes of a piece of it.
SAMPLE_DOCS, DICT_BYTES, PIECE = 1200, 64 * 1024, 256
#: Of those texts, every so manieth is kept out of the dictionary to set the margin on; share of rightly named ones that may go;
#: the least margin, as few texts tell little.
CALIBRATE, LOST, LEAST = 4, 0.003, 0.5
#: Bytes coded at once. Long texts are coded block by block, so that the dictionary and not the text itself decides to the end.
BLOCK, LEVEL, MIN_MATCH = 4096, 6, 3


@dataclass
class Model:
    """A dictionary for each language; the least margin, in bytes to the root of the compressed bytes, of a text that is kept."""

    dicts: dict[str, bytes]
    margin: float = 0.0


def cut_up(text: str) -> list[bytes]:
    """A lower-cased text in pieces of about PIECE bytes, cut at blanks: all of it."""
    data, out, at = text.lower().encode("utf-8", "replace"), [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            blank = data.rfind(b" ", at + 1, end)
            end = blank if blank > 0 else end
        out.append(data[at:end])
        at = end
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", usable: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Dictionaries of all non-null languages, from at most sample_docs distinct whole texts of each (see bounded_sample).

    Texts are cut into pieces, and the pieces of the least hashes make a dictionary: so every part of every text has the same
    chance. Each fourth text is left out; on these the margin is set below which LOST of the rightly named texts fall.
    Null and blank texts and null languages are passed over; repeated texts count once; an empty table gives no dictionary.
    """
    rows = docs.where(F.length(F.trim(F.col(text))) > 0)
    if usable is not None:
        rows = rows.where(usable)
    sample = written(bounded_sample(rows, F.col(lang).cast("string"), sample_docs, F.col(text), F.col(text)))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(c, p, xxhash.xxh3_64_intdigest(p) >> 1) for c, t in zip(batch["cls"], batch["payload"], strict=True) for p in set(cut_up(t))]
            yield pd.DataFrame(found, columns=["cls", "piece", "h"])

    kept_out = F.pmod(F.col("rank"), F.lit(CALIBRATE)) == 0
    first = F.row_number().over(Window.partitionBy("cls").orderBy("h"))
    cut = sample.where(~kept_out).mapInPandas(pieces, "cls string, piece binary, h long").dropDuplicates(["cls", "h"])
    got = cut.withColumn("n", first).where(F.col("n") <= DICT_BYTES // PIECE * 3 // 2).select("cls", "n", "piece").toPandas().sort_values(["cls", "n"])
    model = Model({str(name): b"".join(own["piece"])[:DICT_BYTES] for name, own in got.groupby("cls")})
    if len(model.dicts) < 2:
        return model
    # The margins of the texts that were kept out, judged as any others.
    tried = identify(sample.where(kept_out).select("cls", "payload"), model, "payload")
    right = np.sort(tried.where("lang_pred = cls").select("margin").toPandas()["margin"].to_numpy())
    if len(right):
        model.margin = max(LEAST, float(right[int(LOST * len(right))]))
    return model


class Classifier:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, dicts: dict[str, bytes]):
        self.langs = list(dicts)
        self.coders = []
        for data in dicts.values():
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(data), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, text: str) -> np.ndarray:
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders], dtype=float)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; `und`, 0, 0 without letters or without languages. Ties go to the first name.

        The margin is the lead over the next language in compressed bytes, to the root of the text's compressed bytes: by chance
        alone a lead grows with that root, so it says the same for short and long texts.
        """
        if not self.langs or not text or not any(c.isalpha() for c in text):
            return "und", 0.0, 0.0
        n = self.sizes(text)
        k = int(n.argmin())
        rest = np.delete(n, k)
        margin = float((rest.min() - n[k]) / np.sqrt(max(n[k], 1))) if len(rest) else float("inf")
        odds = np.exp(-(n - n[k]) / max(n[k], 1) * 20)
        return self.langs[k], float(odds[k] / odds.sum()), margin


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred (`und` for null, empty or letterless texts), score (0 to 1), margin and rejected (und, or margin too narrow).

    Map-only over whole texts; the dictionaries are of fixed size. Columns of the same names are replaced. Repeated rows get
    the same answer each; ties go to the first language by name; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.dicts)

    @F.pandas_udf("lang_pred string, score double, margin double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(t) for run in slabs(texts) for t in run], columns=["lang_pred", "score", "margin"])

    got = fresh(docs, "lang")
    out = docs.withColumn(got, judge.asNondeterministic()(F.col(text)))
    keep = [F.col(c) for c in docs.columns if c.lower() not in ("lang_pred", "score", "margin", "rejected")]
    rejected = (F.col(f"{got}.lang_pred") == "und") | (F.col(f"{got}.margin") < model.margin)
    return out.select(*keep, F.col(f"{got}.lang_pred"), F.col(f"{got}.score"), F.col(f"{got}.margin"), rejected.alias("rejected"))
