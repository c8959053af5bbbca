"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import ann, chat, decontaminate, langid, licenses, mixing, neardup, tokens, toxicity, urls
from weftline.llm.common import crc_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.ordered(chat.linked(table(spark, sf_dir, "conversations")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in for files: source/lang/d0-6/doc_id.txt; each hundredth is the license file of one of these levels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    place = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), (i % 7).cast("string")))
    level = F.when(i % 300 == 0, F.col("source")).when(i % 300 == 100, F.concat_ws("/", "source", "lang")).otherwise(place)
    path = F.when(i % 100 == 0, F.concat(level, F.lit("/LICENSE-"), i.cast("string"))).otherwise(F.concat(place, F.lit("/"), i.cast("string"), F.lit(".txt")))
    found = licenses.scan(docs.select("doc_id", path.alias("path"), "text"), key="doc_id")
    return found.withColumnRenamed("key", "doc_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs, usable=F.pmod(crc_of(F.col("doc_id")), F.lit(4)) != 2)
    held = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), usable=F.pmod(crc_of(F.col("doc_id")), F.lit(3)) != 1)
    held = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.covered(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_token_counts, op3_quotation_links, op4_license_scan, op5_language, op6_toxicity, op7_near_duplicates, op8_url_filter, op9_nearest, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quotation_links": chat.SQL}
