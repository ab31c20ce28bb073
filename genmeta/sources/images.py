"""Image files to metadata chunks. One Python stage (split_frames) walks containers; the rest is native."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ENDINGS = "png|jpg|jpeg|webp|avif|tiff|tif"
TEXT_LIMIT, INFLATE_LIMIT, BUFFER = 16 << 20, 32 << 20, 16 << 20
CHUNK_LIMIT = 2 << 20
REJECT = "rejected"
#: Chunks of WebP that hold no text, and the head of a JPEG segment with XMP.
PIXEL_CHUNKS = [b"VP8 ", b"VP8L", b"VP8X", b"ICCP", b"ANIM", b"ANMF", b"ALPH"]
XMP_HEADER = b"http://ns.adobe.com/xap/1.0/\0"
FRAMES = "path string, ord int, container string, frame_type string, key string, payload binary"
#: EXIF tags, the key of the chunk that each fills, and XMP tags.
EXIF_TAGS = {0x9286: "exif:UserComment", 0x010E: "exif:ImageDescription", 0x927C: "exif:MakerNote", 0x013B: "exif:Artist", 0x013C: "exif:HostComputer"}
XMP_TAGS = ["exif:UserComment", "dc:description", "dc:title", "xmp:CreatorTool", "tiff:Software", "parameters", "prompt"]
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Image files by ending, 12 bytes or more. Content is read only if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.lower("path").rlike(rf"\.({ENDINGS})$") & (F.col("length") >= 12))


def container(content: Column) -> Column:
    """By signature."""
    starts = lambda hexed: F.hex(F.substring(content, 1, len(hexed) // 2)) == hexed
    return (
        F.when(starts("89504E47"), "png").when(starts("FFD8"), "jpeg").when(starts("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
        .when(F.hex(F.substring(content, 5, 4)) == "66747970", "avif").when(starts("49492A00") | starts("4D4D002A"), "tiff")
    )


class Bytes:
    """Ranges of a file's bytes, from memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, size: int) -> bytes:
        return self.data[at : at + size]


Frame = tuple[str, str | None, bytes | None]


def rejected(reason: str) -> Frame:
    return REJECT, reason, None


def _inflated(data: bytes) -> bytes | None:
    """None where the text is longer than the limit."""
    reader = zlib.decompressobj()
    text = reader.decompress(data, INFLATE_LIMIT)
    return None if reader.unconsumed_tail else text


def _png(file: Bytes) -> Iterator[Frame]:
    at = 8
    while at + 8 <= file.size:
        (size,), kind = struct.unpack(">I", file.read(at, 4)), file.read(at + 4, 4)
        if kind == b"IEND" or at + 8 + size > file.size:
            return
        if kind in (b"tEXt", b"zTXt", b"iTXt") and size > TEXT_LIMIT:
            yield rejected("text chunk too long")
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            body = file.read(at + 8, size)
            if b"\0" in body:
                key, rest = body.split(b"\0", 1)
                packed = kind == b"zTXt"
                if packed:
                    rest = rest[1:]
                elif kind == b"iTXt":
                    packed, rest = rest[:1] == b"\1", rest[2:].split(b"\0", 2)[-1]
                text = _inflated(rest) if packed else rest
                yield rejected("inflated text too long") if text is None else (kind.decode(), key.decode("latin-1"), text)
        elif kind == b"eXIf":
            yield "exif", None, file.read(at + 8, size)
        at += 12 + size


def _jpeg(file: Bytes) -> Iterator[Frame]:
    at = 2
    while at + 4 <= file.size:
        head = file.read(at, 4)
        mark = head[1]
        if head[0] != 0xFF or mark in (0xDA, 0xD9):
            return
        if mark == 0xFF:
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
        else:
            (size,) = struct.unpack(">H", head[2:])
            if mark in (0xE1, 0xFE):
                body = file.read(at + 4, size - 2)
                if mark == 0xFE:
                    yield "comment", "Comment", body
                elif body.startswith(b"Exif\0\0"):
                    yield "exif", None, body[6:]
                elif body.startswith(XMP_HEADER):
                    yield "xmp", None, body.split(b"\0", 1)[1]
            at += 2 + size


def _webp(file: Bytes) -> Iterator[Frame]:
    at, total = 12, min(file.size, BUFFER)
    while at + 8 <= total:
        kind, (size,) = file.read(at, 4), struct.unpack("<I", file.read(at + 4, 4))
        if at + 8 + size > total:
            return
        if kind == b"EXIF":
            yield "exif", None, file.read(at + 8, size).removeprefix(b"Exif\0\0")
        elif kind == b"XMP ":
            yield "xmp", None, file.read(at + 8, size)
        elif kind not in PIXEL_CHUNKS:
            if 4 < size < CHUNK_LIMIT:
                yield "chunk", kind.decode("latin-1"), file.read(at + 8, size)
            elif size >= CHUNK_LIMIT:
                yield rejected("unknown chunk too long")
        at += 8 + size + size % 2


def _boxes(file: Bytes, at: int, end: int, wide: bool) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the body, end) of each box; wide: sizes may take 64 bits."""
    while at + 8 <= end:
        (size,), kind, head = struct.unpack(">I", file.read(at, 4)), file.read(at + 4, 4), 8
        if wide and size == 1:
            if at + 16 > end:
                return
            (size,), head = struct.unpack(">Q", file.read(at + 8, 8)), 16
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _avif(file: Bytes) -> Iterator[Frame]:
    for kind, body, end in _boxes(file, 0, min(file.size, BUFFER), True):
        if kind == b"meta":  # version and flags come first
            for inner, start, stop in _boxes(file, body + 4, end, False):
                if inner == b"Exif":
                    yield "exif", None, file.read(start, stop - start)
                elif inner == b"xml ":
                    yield "xmp", None, file.read(start, stop - start)


WALKERS = {"png": _png, "jpeg": _jpeg, "webp": _webp, "avif": _avif, "tiff": lambda file: iter([("exif", None, file.read(0, BUFFER))])}


def walked(file: Bytes, kind: str) -> Iterator[tuple[int, str, str | None, bytes | None]]:
    """(ord, frame_type, key, payload); a damaged tail leaves the frames before it."""
    n = 0
    try:
        for frame in WALKERS[kind](file):
            yield n, *frame
            n += 1
    except (struct.error, zlib.error, ValueError, IndexError):
        return


def tagged_frames(files: DataFrame) -> DataFrame:
    """What the containers of (path, content) hold: metadata frames, and a row of type REJECT with its reason in key for each frame beyond a limit."""
    rows = files.select("path", container(F.col("content")).alias("container"), "content").filter("container IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, kind, content in zip(*(batch.column(c) for c in ("path", "container", "content")), strict=True):
                out += [(path.as_py(), n, kind.as_py(), *frame) for n, *frame in walked(Bytes(content.as_py()), kind.as_py())]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "ord", "container", "frame_type", "key", "payload"])

    return rows.mapInArrow(run, FRAMES)


def split_frames(files: DataFrame) -> DataFrame:
    """Metadata frames of (path, content)."""
    return tagged_frames(files).filter(F.col("frame_type") != REJECT)


def frame_rejects(tagged: DataFrame) -> DataFrame:
    """(path, ord, container, reason) of frames beyond a limit."""
    return tagged.filter(F.col("frame_type") == REJECT).select("path", "ord", "container", F.col("key").alias("reason"))


def stored_frames(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames and rejects of one pass over the files: one write, split by a partition."""
    tagged_frames(files).withColumn("kept", F.col("frame_type") != REJECT).write.mode("overwrite").partitionBy("kept").parquet(path)
    stored = files.sparkSession.read.schema(f"{FRAMES}, kept boolean").parquet(path)
    return stored.filter("kept").drop("kept"), frame_rejects(stored.filter("NOT kept"))


def exif_entries(frames: DataFrame) -> DataFrame:
    """(path, ord, tag, type, cnt, is_le, value) of the first directory and the EXIF directory; bad entries are skipped."""

    def entries(data: bytes) -> Iterator[tuple[int, int, int, bool, bytes]]:
        base = next((i for i in range(min(64, len(data))) if data[i : i + 4] in (b"II*\0", b"MM\0*")), None)
        if base is None:
            return
        data = data[base:]
        little = data[:2] == b"II"
        e = "<" if little else ">"
        todo = [struct.unpack_from(e + "I", data, 4)[0]]
        for place in todo:
            if len(todo) > 8 or place + 2 > len(data):
                continue
            (n,) = struct.unpack_from(e + "H", data, place)
            for i in range(n):
                at = place + 2 + 12 * i
                if at + 12 > len(data):
                    break
                tag, kind, cnt, offset = struct.unpack_from(e + "HHII", data, at)
                size = TYPE_SIZE.get(kind, 0) * cnt
                value = data[at + 8 : at + 8 + size] if size <= 4 else data[offset : offset + size]
                if tag == 0x8769:
                    todo.append(offset)
                elif size and len(value) == size:
                    yield tag, kind, cnt, little, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, number, data in zip(*(batch.column(c).to_pylist() for c in ("path", "ord", "payload")), strict=True):
                try:
                    out += [(path, number, *x) for x in entries(data)]
                except struct.error:
                    continue
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "ord", "tag", "type", "cnt", "is_le", "value"])

    return frames.filter("frame_type = 'exif'").select("path", "ord", "payload").mapInArrow(run, "path string, ord int, tag int, type int, cnt long, is_le boolean, value binary")


def user_comment(value: Column, is_le: Column) -> Column:
    """Without a known 8-byte designator; UNICODE text is UTF-16 in the order that zero bytes show, else in the header's."""
    head, body = F.hex(F.substring(value, 1, 8)), F.substr(value, F.lit(9), F.octet_length(value))
    units = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(512), (F.octet_length(body) / 2).cast("int"))))
    zeros = lambda first: F.size(F.filter(units, lambda i: F.hex(F.substr(body, i * 2 - (1 if first else 0), F.lit(1))) == "00"))
    little = F.when(zeros(False) == zeros(True), is_le).otherwise(zeros(False) > zeros(True))
    wide = F.when(little, F.decode(body, "UTF-16LE")).otherwise(F.decode(body, "UTF-16BE"))
    return F.when(head == "554E49434F444500", wide).when(head.isin("4153434949000000", "4A49530000000000", "0000000000000000"), T.decode_text(body)).otherwise(T.decode_text(value))


def routed(entries: DataFrame) -> DataFrame:
    """EXIF entries as chunks; Make and Model may hold graphs."""
    tags = entries.sparkSession.createDataFrame(list(EXIF_TAGS.items()), "tag int, chunk_key string")
    named = entries.join(F.broadcast(tags), "tag").withColumn("text", F.when(F.col("tag") == 0x9286, user_comment(F.col("value"), F.col("is_le"))).otherwise(T.decode_text(F.col("value"))))
    plain = F.rtrim(F.btrim(T.decode_text(F.col("value")), F.lit("\0")))
    held = entries.filter("tag IN (271, 272) AND type = 2").withColumn("s", plain).filter(F.col("s").rlike(r"^(prompt|workflow):\{"))
    graphs = held.select("path", F.lit(-1).alias("ord"), F.substring_index("s", ":", 1).alias("chunk_key"), F.substr("s", F.locate(":", F.col("s")) + 1, F.length("s")).alias("text"))
    return named.select("path", "ord", "chunk_key", "text").union(graphs)


def xmp_chunks(packets: DataFrame) -> DataFrame:
    """Chunks of (path, ord, packet): the packet and the first occurrence of each tag."""
    tags = F.array(*(F.struct(F.lit(f"xmp:{t}").alias("chunk_key"), T.unescape_xml(T.first_list_item(T.first_tag(F.col("packet"), t))).alias("text")) for t in XMP_TAGS))
    found = packets.select("path", "ord", F.inline(F.filter(tags, lambda x: x["text"].isNotNull())))
    return found.union(packets.select("path", "ord", F.lit("xmp"), "packet"))


def chunks(frames: DataFrame) -> DataFrame:
    """(path, ord, chunk_key, text) of all frames."""
    text = F.when(F.col("frame_type") == "iTXt", F.col("payload").cast("string")).otherwise(T.decode_text(F.col("payload")))
    is_xmp = (F.col("frame_type") == "xmp") | (F.col("key") == "XML:com.adobe.xmp")
    direct = frames.filter(F.col("key").isNotNull() & ~is_xmp).select("path", "ord", F.col("key").alias("chunk_key"), text.alias("text"))
    packets = frames.filter(is_xmp).select("path", "ord", T.decode_text(F.col("payload")).alias("packet"))
    return direct.union(xmp_chunks(packets)).union(routed(exif_entries(frames)))


def write_catalog(info: DataFrame, path: str) -> None:
    """Parquet by generator; partitions in info replace those in the catalog."""
    info.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generator").parquet(path)
