"""Keyed Parquet tables: the stores of chunks, edges, hashes, caches and telemetry, with generations and a version."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import incremental as I

VERSION = 4
#: Keys of the tables.
KEYS = {
    "chunks": ["chunk_id"], "edges": ["source_entity", "relationship", "target_entity"], "file_hashes": ["file_path"], "descriptions": ["content_hash", "model"],
    "enrichments": ["chunk_id"], "embeddings": ["content_hash", "model"], "failed_files": ["file_path"], "checkpoints": ["job", "batch_index"], "index_state": ["collection"],
}
#: Tables that survive a clearing: they are addressed by content.
CACHES = ("descriptions", "enrichments", "embeddings")
#: Tables kept by file: buckets of the hashed path, of which a change rewrites only those that it touches.
BY_FILE, BUCKETS = ("chunks", "edges", "files", "postings"), 256


class DimensionMismatchError(ValueError):
    pass


class VersionError(RuntimeError):
    """A store of a later version, or a migration that failed."""


class Store:
    """Tables under one folder. A write makes a new generation and then switches a marker, so readers see the old or the new one.

    Tables by file have a manifest for each generation that names the generation of every bucket; the others are whole folders.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Small files

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _put(self, path: str, text: str) -> None:
        """Written beside and renamed, so that no reader sees a part."""
        beside = self._path(path + ".tmp")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._path(path), False)
        self._fs.rename(beside, self._path(path))

    def _get(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    # Whole tables

    def _generations(self, name: str) -> list[int]:
        if name in BY_FILE:
            return sorted(int(n[1:-5]) for n in self._names(f"{self.root}/{name}") if n[:1] == "m" and n.endswith(".json"))
        return sorted(int(n[1:]) for n in self._names(f"{self.root}/{name}") if n[:1] == "g" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.root}/{name}/{n}/_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._generations(name))

    def read(self, name: str) -> DataFrame:
        own = self._generations(name)
        if not own:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return self._buckets(name, self._manifest(name, own[-1])) if name in BY_FILE else self.spark.read.parquet(f"{self.root}/{name}/g{own[-1]}")

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Writes a generation; the one before last is removed, the last stays for its readers."""
        if name in BY_FILE:
            self.drop(name)
            self.replace(name, rows, None)
            return
        own = self._generations(name)
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/g{(own or [0])[-1] + 1}")
        for g in own[:-1]:
            self._fs.delete(self._path(f"{self.root}/{name}/g{g}"), True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to the last generation; for caches by content, whose rows never change."""
        own = self._generations(name)
        rows.write.mode("append").parquet(f"{self.root}/{name}/g{(own or [1])[-1]}")

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.overwrite(name, I.upserted(self.read(name), rows, KEYS[name]) if self.exists(name) else rows.dropDuplicates(KEYS[name]))

    def delete(self, name: str, keys: DataFrame, key: str) -> None:
        if not self.exists(name):
            return
        if name in BY_FILE and key == "file_path":
            self.replace(name, self.read(name).limit(0), keys)
        else:
            self.overwrite(name, I.deleted(self.read(name), keys, key))

    # Tables by file

    def _manifest(self, name: str, generation: int) -> dict:
        return json.loads(self._get(f"{self.root}/{name}/m{generation}.json"))

    def _buckets(self, name: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/{name}/g{g}/_b={b}" for b, g in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, name: str, rows: DataFrame, files: DataFrame | None, order: str = "file_path") -> None:
        """Puts rows in place of all that the table holds of `files` (file_path); only buckets of these files are read and written.

        files: None stands for a new table. Rows of a bucket lie in order of the column `order`, so that filters on it skip most.
        """
        own = self._generations(name)
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
        old = self._manifest(name, own[-1]) if own else {"buckets": {}, "schema": None}
        generation = (own or [0])[-1] + 1
        out = rows
        touched: set[int] = set(range(BUCKETS))
        if own and files is not None:
            touched = {r[0] for r in files.select(bucket("file_path")).distinct().collect()}  # BUCKETS at most
            held = self._buckets(name, old, touched)
            out = held.join(files.select("file_path").distinct(), "file_path", "left_anti").unionByName(rows.select(*held.columns))
        folder = f"{self.root}/{name}/g{generation}"
        out.withColumn("_b", bucket(F.col("file_path"))).repartition("_b").sortWithinPartitions("_b", order).write.mode("overwrite").partitionBy("_b").parquet(folder)
        now = {int(n[3:]) for n in self._names(folder) if n.startswith("_b=")}
        buckets = {b: g for b, g in old["buckets"].items() if int(b) not in touched} | {str(b): generation for b in now}
        self._put(f"{self.root}/{name}/m{generation}.json", json.dumps({"buckets": buckets, "schema": out.schema.jsonValue()}))
        # What neither this generation nor the last one names goes.
        named = {(int(b), g) for m in (buckets, old["buckets"]) for b, g in m.items()}
        for g in {int(n[1:]) for n in self._names(f"{self.root}/{name}") if n[:1] == "g" and n[1:].isdigit()}:
            for n in self._names(f"{self.root}/{name}/g{g}"):
                if n.startswith("_b=") and (int(n[3:]), g) not in named:
                    self._fs.delete(self._path(f"{self.root}/{name}/g{g}/{n}"), True)
        for g in own[:-1]:
            self._fs.delete(self._path(f"{self.root}/{name}/m{g}.json"), False)

    # All

    def count(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def clear(self) -> None:
        """Drops state; content-addressed caches stay."""
        for name in {*KEYS, *BY_FILE}:
            if name not in CACHES:
                self.drop(name)

    def check_dimension(self, vectors: DataFrame, column: str, expected: int) -> None:
        odd = vectors.where(F.size(column) != expected).limit(1).count()
        if odd:
            raise DimensionMismatchError(f"{column} has vectors of another length than {expected}; index anew")

    # Bookkeeping

    def last_checkpoint(self, job: str) -> int:
        if not self.exists("checkpoints"):
            return -1
        return self.read("checkpoints").where(F.col("job") == job).agg(F.coalesce(F.max("batch_index"), F.lit(-1))).first()[0]

    def record_failures(self, failures: DataFrame, at: str | None = None) -> None:
        """Counts a failure more for each file_path (with its error), and notes when."""
        now = failures.groupBy("file_path").agg(F.max("error").alias("error")).withColumn("last_attempt", F.lit(at or datetime.now(UTC).isoformat()))
        old = self.read("failed_files") if self.exists("failed_files") else now.withColumn("retry_count", F.lit(0)).limit(0)
        counts = I.counted(old.select("file_path", "retry_count"), now, "file_path")
        latest = I.upserted(old.select("file_path", "error", "last_attempt"), now, "file_path")
        self.overwrite("failed_files", counts.join(latest, "file_path"))

    def failed_files(self) -> DataFrame:
        """(file_path, retry_count, error, last_attempt), the last attempt first."""
        if not self.exists("failed_files"):
            return self.spark.createDataFrame([], "file_path string, retry_count int, error string, last_attempt string")
        return self.read("failed_files").orderBy(F.desc("last_attempt"), "file_path")

    def version(self) -> int:
        path = f"{self.root}/version.json"
        return json.loads(self._get(path))["version"] if self._fs.exists(self._path(path)) else 0

    def migrate(self, steps: dict[int, Callable[[Store], None]] | None = None, to: int = VERSION) -> int:
        """Runs the steps above the store's version in order, noting each, up to `to`; a new or empty store starts there."""
        have = self.version() or (to if not any(self.exists(n) for n in {*KEYS, *BY_FILE}) else 1)
        if have > to:
            raise VersionError(f"the store has version {have}, this code {to}: use a later one")
        for n in sorted(k for k in steps or {} if have < k <= to):
            try:
                steps[n](self)
            except Exception as e:
                raise VersionError(f"migration to {n} failed: {e}; index anew") from e
            self._put(f"{self.root}/version.json", json.dumps({"version": n}))
        self._put(f"{self.root}/version.json", json.dumps({"version": to}))
        return to


def telemetry_row(spark: SparkSession, query: str, intent: str, mode: str, results: int, top_score: float, z: float, label: str, reranked: bool) -> DataFrame:
    """One event: the query only as its SHA-256, scores to four digits."""
    row = [(datetime.now(UTC).isoformat(), query, intent, mode, results, top_score, z, label, reranked)]
    raw = spark.createDataFrame(row, "timestamp string, query string, intent string, mode_used string, result_count int, top_score double, z_score double, confidence_label string, reranked boolean")
    return raw.select("timestamp", F.sha2("query", 256).alias("query_hash"), "intent", "mode_used", "result_count", F.round("top_score", 4).alias("top_score"), F.round("z_score", 4).alias("z_score"), "confidence_label", "reranked")


def record(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines."""
    events.write.mode("append").json(path)


def report(rows: DataFrame, title: str) -> Iterator[str]:
    """Lines of a Markdown table of all rows, fetched partition by partition."""
    head = rows.columns
    yield from [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in rows.toLocalIterator():
        yield "| " + " | ".join(str(v) for v in r) + " |"


def report_json(rows: DataFrame) -> Iterator[str]:
    """All rows as JSON lines, fetched partition by partition."""
    for r in rows.toLocalIterator():
        yield json.dumps(r.asDict(recursive=True), default=str)
