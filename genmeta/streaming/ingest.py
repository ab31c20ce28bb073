"""The scan as a stream; picks and joins run in foreachBatch, on each batch's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import dispatch
from ..plans.tables import Scratch
from ..sources import images


def stream(spark: SparkSession, source: str, catalog: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """New image files to the catalog; each micro-batch appends the rows of its files under batch=<id>, so a replayed batch replaces its own rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(source).filter(F.lower("path").rlike(rf"\.({images.ENDINGS})$") & (F.col("length") >= 12))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = images.chunks(images.split_frames(batch)).withColumnRenamed("path", "file_id")
        scratch = Scratch(rows.sparkSession)
        dispatch.image_info(scratch.closed(rows, "chunks")).write.mode("overwrite").parquet(f"{catalog}/batch={batch_id}")
        scratch.drop()

    out = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def latest_rows(info: DataFrame) -> DataFrame:
    """The row of the newest batch for each file."""
    rest = [c for c in info.columns if c not in ("file_id", "batch")]
    return info.groupBy("file_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("file_id", "r.*")
