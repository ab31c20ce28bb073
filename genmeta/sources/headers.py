"""S6 by ranges: a data source that reads only the headers and metadata of image files, never their pixels.

For folders that executors can open as files. Stores that only Spark's readers reach are read with images.scan, which loads whole
files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import images

SIGNATURES = [(b"\x89PNG", 0, "png"), (b"\xff\xd8", 0, "jpeg"), (b"WEBP", 8, "webp"), (b"ftyp", 4, "avif"), (b"II*\0", 0, "tiff"), (b"MM\0*", 0, "tiff")]
LEAST_BYTES, FILES_EACH = 12, 64


class Ranges(images.Bytes):
    """Ranges of an open file; counts the bytes that were read."""

    def __init__(self, path: str):
        self.file, self.size, self.count = open(path, "rb", buffering=0), os.path.getsize(path), 0  # noqa: SIM115

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        self.count += len(data)
        return data

    def kind(self) -> str | None:
        head = self.read(0, LEAST_BYTES)
        return next((kind for sign, at, kind in SIGNATURES if head[at : at + len(sign)] == sign), None)


@dataclass
class Files(InputPartition):
    paths: list[str]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = re.sub("^file:/*", "/", options["path"])

    def partitions(self) -> list[Files]:
        found = sorted(os.path.join(folder, name) for folder, _, names in os.walk(self.folder) for name in names if re.search(rf"\.({images.ENDINGS})$", name.lower()))
        return [Files(found[i : i + FILES_EACH]) for i in range(0, len(found), FILES_EACH)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            file = Ranges(path)
            kind = file.kind() if file.size >= LEAST_BYTES else None
            frames = list(images.walked(file, kind)) if kind else []
            for n, frame, key, payload in frames:
                yield path, n, kind, frame, key, None if payload is None else bytes(payload), file.count, file.size
            file.file.close()


class HeaderSource(DataSource):
    """(path, ord, container, frame_type, key, payload, bytes_read, length): as images.tagged_frames, and how much of each file was read."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return f"{images.FRAMES}, bytes_read long, length long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(HeaderSource)
    return spark.read.format("image_headers").option("path", folder).load()
