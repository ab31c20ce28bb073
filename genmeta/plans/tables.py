"""Tables in the shared folder, to cut the lineage of iterative joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time.
SLICE = 2 << 30


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a session of one machine gets a folder of its own; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='genmeta-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by key over as many tasks as the session's shuffles have: one small file of rows may stand for hours of decoding."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Plain, uncompressed values: Spark takes the size of the files for that of the rows when it chooses what to broadcast, and
    repeated names of nodes and classes shrink a hundredfold otherwise, so that the driver would build tables of millions of rows."""
    df.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps start from files that outlive executors."""
    return stored(df, f"{shared_folder(df.sparkSession)}/genmeta/{name}-{uuid.uuid4().hex}")


class Scratch:
    """The tables of one run, in a folder of their own; drop() deletes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.places = spark, f"{shared_folder(spark)}/genmeta/run-{uuid.uuid4().hex}", {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.places) + 1:03}-{name}"
        out = stored(df, path)
        self.places[out] = path
        return out

    def closed(self, df: DataFrame, name: str) -> DataFrame:
        """A table that no later step joins, so its size tells Spark nothing: it is compressed."""
        path = f"{self.folder}/{len(self.places) + 1:03}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.places[out] = path
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """The rows of tables of this run that have the same columns, by one scan: a plan that doesn't grow with the number of rounds, as that of a union does."""
        return self.spark.read.schema(tables[0].schema).parquet(*(self.places[t] for t in tables))

    def combined(self, parts: list[DataFrame]) -> DataFrame:
        """Tables of at most one row a file_id, side by side: one shuffle of all of them instead of a join for each."""
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return rows.groupBy("file_id").agg(*(F.any_value(c, True).alias(c) for c in rows.columns if c != "file_id"))

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        # shuffles leave the disks of executors once the driver's collector finds that no plan needs them
        self.spark._jvm.System.gc()


def sliced(chunks: DataFrame, name: str, run: Callable[[Scratch, DataFrame], DataFrame]) -> DataFrame:
    """The rows of run(scratch, chunks), in tables that stay. Files are dealt by a hash over slices of about SLICE bytes of text, and
    the tables of a slice go before the next one starts: what a run holds on disk grows with a slice, only its result with the input."""
    out = Scratch(chunks.sparkSession)
    n = (chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE + 1
    done = []
    for k in range(n):
        scratch = Scratch(chunks.sparkSession)
        files = chunks if n == 1 else chunks.filter(F.pmod(F.xxhash64("file_id"), F.lit(n)) == k)
        done.append(out.closed(run(scratch, files), name))
        scratch.drop()
    return out.together(done)
