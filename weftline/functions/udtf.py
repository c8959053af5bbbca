"""Chunks and relationships as SQL table functions: SELECT f.file_path, c.* FROM files f, LATERAL code_chunks(f.file_path, f.content) c."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from weftline.operators import chunking, extract


class Chunks:
    def eval(self, path: str, content: str):
        if path and content and content.strip():
            for i, x in enumerate(chunking.pieces(path, content, chunking.MOST, chunking.OVERLAP, chunking.count_words)):
                yield (i, *x)


class Edges:
    def eval(self, path: str, content: str):
        if path and content:
            yield from extract.edges_of(path, content)


def register(spark: SparkSession) -> None:
    """Makes code_chunks and code_edges known to SQL; own extractors are registered alike."""
    spark.udtf.register("code_chunks", udtf(Chunks, returnType="part int, kind string, name string, docstring string, line_start int, line_end int, content string"))
    spark.udtf.register("code_edges", udtf(Edges, returnType="source_entity string, relationship string, target_entity string, confidence string"))
