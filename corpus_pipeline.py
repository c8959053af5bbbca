"""The corpus pipeline: language ID, toxicity, near-dedup, decontamination, mixing; each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, langid, mixing, neardup, toxicity
from weftline.llm.common import crc_of, fresh, written


def beside(docs: DataFrame, *needed: str) -> tuple[DataFrame, str]:
    """docs as one column, next to what a stage judges by: so no column that an operator adds can take the place of one of docs."""
    own = fresh(docs, "own")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own), *[c for c in needed if c in docs.columns]), f"{own}.*"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: narrow margins, and null, empty or letterless texts, which have no language.

    Repeated rows stay or go together; ties go to the first language by name; columns of any names stay as they are; an empty table
    gives an empty one.
    """
    model = langid.learn(docs, usable=F.pmod(crc_of(F.col("doc_id")), F.lit(4)) != 2)
    rows, own = beside(docs, "text")
    return langid.identify(rows, model).where(~F.col("rejected")).select(own)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and empty texts are scored as empty ones.

    Repeated rows stay or go together; a document without a label counts as any other; without labels none is toxic; an empty table
    gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, usable=F.pmod(crc_of(F.col("doc_id")), F.lit(3)) != 1)
    rows, own = beside(docs, "text")
    return toxicity.score(rows, model).where(F.col("predicted") == 0).select(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the least id, of repeated rows of it one.

    Null and wordless texts are classes of their own, so all of them stay; a null id stands behind all others; an empty table
    gives an empty one.
    """
    return neardup.kept(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go; null and empty texts cover none.

    Repeated rows stay or go together; an empty benchmark contaminates nothing; an empty table gives an empty one.
    """
    rows, own = beside(docs, "text")
    return decontaminate.covered(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")).select(own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy drawn, with its shard, shard by shard in shuffled order.

    Null texts have size 0, a null source is a source of its own; repeated rows are drawn alike; an empty table gives no rows.
    """
    return mixing.shuffled(mixing.mix(docs))


STAGES = [("language", language), ("toxicity", toxic), ("near-duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mix)]
#: SQL expresses neither the compression nor the trained models; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out) if i + 1 < len(STAGES) else out
    return docs
