"""The pipeline's stages against plain Python over the same rows."""

import __spark_entry__
import corpus_pipeline
from weftline.llm import decontaminate, neardup

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        assert 0 < after.count() <= before.count()
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            tiler = decontaminate.Tiler(items, decontaminate.MIN_MATCH)
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if tiler.best(r["text"])[1] < decontaminate.COVERED}
        if name == "near-duplicates":
            classes = {r["id"]: r["class_id"] for r in neardup.classes(before).collect()}
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(classes.values()))
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert mixed.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert {"shard", "copy", "text"} <= set(mixed.columns)
    assert "pipeline" in __spark_entry__.queries()


def _odd(spark, n):
    """Odd rows: null, empty and long texts, repeated rows, null ids and sources, columns whose names clash with those that stages add."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, "one two three four five six", "en", None), (-1, None, None, "a"), (-2, "", "en", "a"), (-3, "word " * 200_000, "en", "a"), (-4, "... 123", None, "b")]
    some = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string, lang string, source string")
    out = docs.select("doc_id", "text", "lang", "source").unionByName(some).limit(n)
    return out.withColumns({c: F.lit("own") for c in ("score", "margin", "rejected", "predicted", "id", "key", "coverage", "item_id", "contaminated", "_size", "block")})


def test_stages_take_odd_rows_and_empty_tables(spark):
    for n in (10_000, 0):
        odd = _odd(spark, n).cache()
        before = odd.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, odd, SF)
            assert after.columns == odd.columns, name
            kept = [r["doc_id"] for r in after.select("doc_id").collect()]
            assert len(kept) <= before and bool(kept) == bool(before), name
            assert all(x["score"] == "own" for x in after.select("score").limit(5).collect())
            if before and name == "language":
                assert not {-1, -2, -4} & set(kept) and kept.count(-3) in (0, 2)
            if before and name == "near-duplicates":
                assert kept.count(-3) == 1 and kept.count(-1) == 1 and kept.count(-2) == 1
            if before and name in ("toxicity", "decontamination"):
                assert kept.count(-1) == kept.count(-2) == 2
        mixed = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
        assert bool(mixed.count()) == bool(before) and {"shard", "slice", "copy"} <= set(mixed.columns)
