"""Helpers shared by the training-data operators: scratch tables, fresh names, array sums, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Multipliers of the 64-bit mixers: odd constants of the splitmix64 finaliser.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Unset, a temporary folder serves a local session only: other machines couldn't read it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/weftline/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Removes the files of a table that written() made and nothing reads any more."""
    spark = table.sparkSession
    for f in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def crc_of(col: Column) -> Column:
    """crc32 of a value as text; null for null."""
    return F.crc32(col.cast("string").cast("binary"))


def slabs(texts: Iterable[str | None], chars: int = 1_500_000) -> Iterator[list[str]]:
    """Runs of whole texts (null as empty) of about so many characters: bounds what one numpy step holds."""
    run: list[str] = []
    held = 0
    for t in texts:
        t = t or ""
        run.append(t)
        held += len(t) + 50
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def sum_arrays(df: DataFrame, fold: Callable[[Iterator[pd.DataFrame]], np.ndarray], size: int, piece: int = 1 << 14) -> np.ndarray:
    """Sum over partitions of the int64 array of a fixed length that fold makes of each partition.

    What meets in a task is one piece of each partition's array, so neither memory nor the result grows with rows.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = fold(batches)
        at = [i for i in range(0, size, piece) if total[i : i + piece].any()]
        if at:
            yield pd.DataFrame({"piece": [i // piece for i in at], "held": [zstandard.compress(total[i : i + piece].astype("<i8").tobytes(), 1) for i in at]})

    def added(key: tuple, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        out = np.zeros(min(piece, size - key[0] * piece), dtype=np.int64)
        for held in batches["held"]:
            out += np.frombuffer(zstandard.decompress(held), dtype="<i8")
        return pd.DataFrame({"piece": [key[0]], "held": [zstandard.compress(out.astype("<i8").tobytes(), 1)]})

    rows = df.mapInPandas(parts, "piece int, held binary").groupBy("piece").applyInPandas(added, "piece int, held binary").collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(zstandard.decompress(bytes(r["held"])), dtype="<i8")
    return out


def bounded_sample(df: DataFrame, by: Column, per_class: int, key: Column, payload: Column, max_classes: int = 1000, max_bytes: int = 1 << 25) -> DataFrame:
    """(cls, rank, payload): of each class (column by) the per_class distinct keys of the smallest hash, the same on each run.

    Used to fit models only. Repeated keys count once, with the payload (a string) of the least hash; null classes, keys and
    payloads are left out. A payload of more than 1/64 of max_bytes is passed over, and a class ends where its payloads come to
    max_bytes: so both rows and bytes are bounded. One pass counts distinct keys, approximately; the next takes those below a hash.
    """
    rank = F.shiftrightunsigned(F.xxhash64(key, F.lit(41)), 2)
    tagged = df.select(by.alias("cls"), rank.alias("rank"), payload.alias("payload"), key.isNotNull().alias("known"))
    tagged = tagged.where(F.col("cls").isNotNull() & F.col("known") & (F.octet_length("payload") <= max_bytes // 64)).drop("known")
    counts = tagged.groupBy("cls").agg(F.approx_count_distinct("rank", 0.02).alias("n")).limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} classes to learn")
    want = F.lit(False)
    for cls, n in counts:
        share = (1.3 * per_class + 60) / max(n, 1)
        want = want | (F.col("cls") == F.lit(cls)) & (F.col("rank") < F.lit(int(min(1.0, share) * (1 << 62))))
    one = tagged.where(want).groupBy("cls", "rank").agg(F.min_by("payload", F.xxhash64("payload")).alias("payload"))
    first = Window.partitionBy("cls").orderBy("rank")
    one = one.withColumns({"n": F.row_number().over(first), "held": F.sum(F.octet_length("payload")).over(first)})
    return one.where((F.col("n") <= per_class) & (F.col("held") <= max_bytes)).select("cls", "rank", "payload")
