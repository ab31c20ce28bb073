"""Helpers that the corpus operators share: columns, hashes, and tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text of a row; a null text counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a session of one machine gets a folder of its own; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='genmeta-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/genmeta/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = path or new_table(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Lets Spark delete shuffle files of finished rounds now: it does so when their plans are collected as garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


class WordHashes(dict):
    """64-bit hash of each word, remembered; call trim() between batches so that it stays bounded."""

    LIMIT = 1 << 20

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random permutation of 64-bit values for each seed (splitmix finaliser)."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of a row of hashes, sensitive to their order."""
    out = np.full(len(parts[0]), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
    for p in parts:
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + p, 7)
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text is one run of all its words."""
    if len(hashes) == 0:
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    return combined([hashes[i : i + n] for i in range(k)])


def text_rows(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows and few bytes (one row at least), so that a task holds little text at once."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        if n <= rows and (n <= 1 or batch.nbytes <= size):
            yield batch
        else:
            half = n // 2 if n <= 2 * rows else (n // rows + 1) // 2 * rows
            yield from cut(batch.slice(0, half))
            yield from cut(batch.slice(half))

    for batch in batches:
        if batch.num_rows:
            yield from cut(batch)
