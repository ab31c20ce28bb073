"""Containers frame by frame: boxes, limits, damaged tails, ranges; stamps in a stream."""

import struct
import zlib
from datetime import datetime

import pytest

from genmeta.sources import headers, images
from genmeta.streaming import versions


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + b"".join(chunks) + chunk(b"IEND", b"")


def box(kind, body, wide=False):
    return (struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) if wide else struct.pack(">I", len(body) + 8) + kind) + body


def riff(*chunks):
    body = b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


META = b"\0\0\0\0" + box(b"hdlr", b"\0" * 20) + box(b"Exif", b"II*\0exif") + box(b"xml ", b"<x/>")
PIXELS = b"\x55" * 300_000
FILES = {
    "a.avif": box(b"ftyp", b"avif" * 2) + box(b"meta", META) + box(b"mdat", PIXELS), "wide.avif": box(b"ftyp", b"avif" * 2) + box(b"free", b"x" * 9, True) + box(b"meta", META, True) + box(b"mdat", PIXELS, True),
    "cut.avif": (box(b"ftyp", b"avif" * 2) + box(b"meta", META))[:-3], "late.avif": box(b"ftyp", b"avif" * 2) + box(b"mdat", b"Exif\0\0II*\0 <x:xmpmeta></x:xmpmeta>"),
    "b.webp": riff((b"VP8 ", PIXELS), (b"NOTE", b"a red fox"), (b"tiny", b"1234"), (b"ALPH", b"x" * 50), (b"XMP ", b"<x/>"), (b"LONG", b"y" * images.CHUNK_LIMIT)),
    "c.png": png(chunk(b"IDAT", PIXELS), chunk(b"tEXt", b"k\0v"), chunk(b"zTXt", b"big\0\0" + zlib.compress(b"z" * (images.INFLATE_LIMIT + 1))), chunk(b"iTXt", b"i\0\1\0\0\0" + zlib.compress(b"text"))),
    "d.jpg": b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 12) + b"Exif\0\0II*\0" + b"\xff\xfe" + struct.pack(">H", 5) + b"abc" + b"\xff\xda" + PIXELS,
}
FRAMES = {
    "a.avif": [("exif", None, b"II*\0exif"), ("xmp", None, b"<x/>")], "wide.avif": [("exif", None, b"II*\0exif"), ("xmp", None, b"<x/>")], "b.webp": [("chunk", "NOTE", b"a red fox"), ("xmp", None, b"<x/>"), ("rejected", "unknown chunk too long", None)],
    "c.png": [("tEXt", "k", b"v"), ("rejected", "inflated text too long", None), ("iTXt", "i", b"text")], "d.jpg": [("exif", None, b"II*\0"), ("comment", "Comment", b"abc")],
}


@pytest.fixture()
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "note.txt").write_bytes(b"no image at all")
    return tmp_path


def by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["ord"])):
        out.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["frame_type"], r["key"], None if r["payload"] is None else bytes(r["payload"])))
    return out


def test_frames_and_rejects(spark, folder, tmp_path_factory):
    files = images.scan(spark, str(folder))
    assert by_file(images.tagged_frames(files).collect()) == FRAMES
    frames, rejects = images.stored_frames(files, str(tmp_path_factory.mktemp("frames")))
    assert by_file(frames.collect()) == {k: [f for f in v if f[0] != "rejected"] for k, v in FRAMES.items()}
    assert sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in rejects.collect()) == [("b.webp", "unknown chunk too long"), ("c.png", "inflated text too long")]


def test_ranges_skip_pixels(spark, folder):
    rows = headers.scan(spark, f"file://{folder}").collect()
    assert by_file(rows) == FRAMES
    read = {r["path"].rsplit("/", 1)[1]: r["bytes_read"] for r in rows}
    assert all(read[name] < len(FILES[name]) / 5 for name in FRAMES)
    assert headers.scan(spark, f"{folder}/none").collect() == []


def test_newest_stamps(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", versions.STATE_STORE)
    schema = "path string, modification_time timestamp, length long"
    at = lambda d: datetime(2024, 1, d)

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = versions.changed(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        got = []
        query.foreachBatch(lambda df, i: got.extend((r["path_key"], r["length"]) for r in df.collect())).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(got)

    assert run([("A.png", at(1), 5), ("a.PNG", at(2), 7), ("b.png", at(1), 1), (None, at(1), 1)], "one") == [("a.png", 7), ("b.png", 1)]
    assert run([("a.png", at(2), 7), ("b.png", at(3), 9), ("c.png", at(1), None)], "two") == [("b.png", 9), ("c.png", 0)]
    assert run([("a.png", at(1), 99)], "three") == []
