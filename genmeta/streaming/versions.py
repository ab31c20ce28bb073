"""The newest version of each file in a stream of stamps, with one stamp a path as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time in microseconds: state and rows hand times over with and without a zone.
STAMP = "at long, length long"


class NewestStamp(StatefulProcessor):
    """Hands on a path's newest stamp when it is newer than the one kept; equal and older ones, so also those of a replayed batch, change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("stamp", STAMP)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest = max(((r["at"], r["length"], r["path"]) for r in rows), default=None)
        if newest and (not self.kept.exists() or newest[:2] > tuple(self.kept.get())):
            self.kept.update(newest[:2])
            yield Row(path_key=key[0], path=newest[2], at=newest[0], length=newest[1])

    def close(self) -> None:
        pass


def changed(stamps: DataFrame) -> DataFrame:
    """(path_key, path, modification_time, length): of a stream of (path, modification_time, length), stamps newer than all before them of their path, case-free. Rows with a null path or time are left out. The session needs STATE_STORE as its state store."""
    known = stamps.filter("path IS NOT NULL AND modification_time IS NOT NULL").select(F.lower("path").alias("path_key"), "path", F.unix_micros("modification_time").alias("at"), F.coalesce("length", F.lit(0)).alias("length"))
    newest = known.groupBy("path_key").transformWithState(NewestStamp(), f"path_key string, path string, {STAMP}", "Update", "none")
    return newest.select("path_key", "path", F.timestamp_micros("at").alias("modification_time"), "length")
