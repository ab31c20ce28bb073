"""Token-ID output with directly addressable codes.

A store is a Parquet table of segments in the shared folder, so that any reader of the cluster opens it and task retries
leave no partial files. A segment holds whole documents, in ascending doc_id order, and its ids as directly addressable
codes: level 0 has the low byte of every id, level 1 the next byte of those ids that need one, and so on. Each level has a
bitmap saying which of its ids continue, and a directory of the number of continuing ids before each block of 512 bits.
The place of id i in the next level is its rank among the continuing ids, so one id is found without decoding others.

Layout of a code: ``u32 n`` ids, ``u8`` levels, then for each level: ``u32 m`` entries, m bytes, and unless it is the last
level ceil(m / 8) bytes of bitmap (bit i % 8 of byte i / 8) and ceil(m / 512) ``u32`` of directory. Little-endian.

Rows: (shard, segment, first, n_tokens, doc_ids, doc_tokens, code); first counts the ids of the shard before the segment.
Shards are ranges of doc_id. Nulls: a null text is empty (only the end id), a null doc_id sorts first. Rows that share a
doc_id are kept, ordered by a hash of their text. An empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_table, text_rows, whole_text

SEGMENT_TOKENS = 1 << 16
BLOCK_BITS = 512


# --- directly addressable codes -----------------------------------------------------------------------------------------
def pack(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint32)
    levels = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    out, rest = [struct.pack("<IB", len(ids), levels)], ids
    for level in range(levels):
        out += [struct.pack("<I", len(rest)), (rest & 255).astype(np.uint8).tobytes()]
        if level < levels - 1:
            goes_on = rest > 255
            counts = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK_BITS), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
            directory = (np.cumsum(counts) - counts).astype("<u4")
            out += [np.packbits(goes_on, bitorder="little").tobytes(), directory.tobytes()]
            rest = rest[goes_on] >> 8
    return b"".join(out)


class Code:
    """Reads ids out of a packed code."""

    def __init__(self, code: bytes):
        self.n, levels = struct.unpack_from("<IB", code)
        at, self.chunks, self.bits, self.ranks = 5, [], [], []
        for level in range(levels):
            (m,) = struct.unpack_from("<I", code, at)
            self.chunks.append(np.frombuffer(code, np.uint8, m, at + 4))
            at += 4 + m
            if level < levels - 1:
                self.bits.append(np.frombuffer(code, np.uint8, -(-m // 8), at))
                at += -(-m // 8)
                self.ranks.append(np.frombuffer(code, "<u4", -(-m // BLOCK_BITS), at))
                at += 4 * -(-m // BLOCK_BITS)

    def __getitem__(self, i: int) -> int:
        """One id; reads at most one block of bits a level."""
        value = 0
        for level, chunk in enumerate(self.chunks):
            value |= int(chunk[i]) << (8 * level)
            if level == len(self.bits) or not self.bits[level][i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK_BITS * BLOCK_BITS
            before = np.unpackbits(self.bits[level][start >> 3 : (i >> 3) + 1], count=i - start, bitorder="little")
            i = int(self.ranks[level][i // BLOCK_BITS]) + int(before.sum())
        return value

    def all(self) -> np.ndarray:
        value = self.chunks[-1].astype(np.uint32)
        for level in range(len(self.bits) - 1, -1, -1):
            low = self.chunks[level].astype(np.uint32)
            goes_on = np.unpackbits(self.bits[level], count=len(low), bitorder="little").astype(bool)
            low[goes_on] |= value << 8
            value = low
        return value


# --- tokens of texts -----------------------------------------------------------------------------------------------------
#: The code points that the tokenizer takes as white space.
WHITE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def uncertain() -> np.ndarray:
    """True for code points whose kind Python and the tokenizer may see differently: numbers that are neither letters nor
    decimal digits, those that Python's version of Unicode doesn't assign, and a letter whose lower form has two signs."""
    signs = map(chr, range(0x110000))
    return np.array([c == "İ" or (c.isalnum() and not c.isalpha() and not c.isdecimal()) or unicodedata.category(c) == "Cn" for c in signs])


class PieceTokens(dict):
    """Ids of the pieces that a tokenizer of the word-BPE kind merges within; they never depend on neighbouring pieces.

    Texts are cut into such pieces (letters, one number, or other signs; contractions first) and new pieces of a batch are
    encoded many at a time: the ids that close a piece tell the pieces apart. Words where the cut is not certain (not in
    composed form, uncertain() code points, a special token) are encoded on their own. Ids are kept as the
    bytes of 32-bit numbers, so that those of a text are one join. The memory stays within about LIMIT bytes: it is emptied
    between batches once it holds more.
    """

    LIMIT, AT_ONCE = 128 << 20, 400
    CONTRACTION = r"'(?:[sStTmMdD]|[rRvV][eE]|[lL]{2})"
    ASCII_PIECE = re.compile(CONTRACTION + r"|[A-Za-z]+|[0-9]|[^\t\n\v\f\r A-Za-z0-9]+")
    PIECE = re.compile(rf"{CONTRACTION}|[^\W\d_]+|\d|(?:[^\w{WHITE}]|_)+")
    WORD = re.compile(f"[^{WHITE}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        closing = [i for s, i in self.tokenizer.get_vocab().items() if s.endswith("</w>")]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[closing] = True
        self.held = 0
        self.rare = uncertain()

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def odd(self, text: str) -> bool:
        if text.isascii() or "<|" in text:
            return "<|" in text
        return bool(self.rare[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].any()) or not unicodedata.is_normalized("NFC", text)

    def cut(self, text: str) -> list[str]:
        return (self.ASCII_PIECE if text.isascii() else self.PIECE).findall(text)

    def learn(self, pieces: set[str]) -> None:
        if self.held > self.LIMIT:
            self.clear()
            self.held = 0
        new = list(pieces.difference(self))
        groups = [new[i : i + self.AT_ONCE] for i in range(0, len(new), self.AT_ONCE)]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, np.uint32)
            ends, raw = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist(), ids.tobytes()
            if len(ends) == len(group):
                self.update(zip(group, (raw[a:b] for a, b in pairwise([0, *ends])), strict=True))
            else:
                self.update((p, self.alone(p)) for p in group)
            self.held += len(raw) + sum(map(len, group)) + 220 * len(group)

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; texts that are held at once should be few."""
        cuts = [None if self.odd(t) else self.cut(t) for t in texts]
        words = {t: self.WORD.findall(t) for t, c in zip(texts, cuts, strict=True) if c is None}
        plain = {w: self.cut(w) for ws in words.values() for w in ws if not self.odd(w)}
        self.learn(set().union(*(c for c in cuts if c is not None), *plain.values()))
        for text, pieces in zip(texts, cuts, strict=True):
            parts = map(self.__getitem__, pieces) if pieces is not None else chain.from_iterable(map(self.__getitem__, plain[w]) if w in plain else [self.alone(w)] for w in words[text])
            yield np.frombuffer(b"".join(parts), np.uint32)


_known: dict[str, PieceTokens] = {}


def piece_tokens(path: str) -> PieceTokens:
    """One cache for each worker process."""
    if path not in _known:
        _known[path] = PieceTokens(path)
    return _known[path]


# --- Spark ---------------------------------------------------------------------------------------------------------------
SEGMENTS = "shard int, segment int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, code binary"


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> str:
    """Encodes docs and writes a store; returns its path.

    One shuffle, by ranges of doc_id (then of a text hash, so that one doc_id with many rows can be split).
    """
    spark = docs.sparkSession
    path = path or new_table(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
        tokens, shard = piece_tokens(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        ids, doc_ids, sizes, first, segment, held = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "first": pa.array([first], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "doc_tokens": pa.array([sizes], pa.list_(pa.int64())), "code": pa.array([pack(np.concatenate(ids))], pa.binary()),
            })

        for batch in text_rows(batches, 1024):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), tokens.of(batch.column("text").to_pylist()), strict=True):
                ids += [own, end]
                doc_ids.append(doc_id)
                sizes.append(len(own) + 1)
                held += len(own) + 1
                if held >= SEGMENT_TOKENS:
                    yield flush()
                    ids, doc_ids, sizes, first, segment, held = [], [], [], first + held, segment + 1, 0
        if doc_ids:
            yield flush()

    dealt.sortWithinPartitions(*order).mapInArrow(encode, SEGMENTS).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): the number of ids in all shards before; one row a shard."""
    from pyspark.sql import Window

    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a store."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = Code(row["code"]).all(), np.array(row["doc_tokens"], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([row["shard"]] * len(sizes), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "local": pa.array(row["first"] + offsets[:-1], pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()), "ids": pa.LargeListArray.from_arrays(offsets, pa.array(ids, pa.uint32()).cast(pa.int32())).cast(pa.list_(pa.int32())),
                })

    docs = spark.read.schema(SEGMENTS).parquet(path).mapInArrow(decode, "shard int, doc_id long, local long, n_tokens long, ids array<int>")
    return docs.join(shard_bases(spark, path), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read from the store's files: the crc32 of a document's ids as u32 little-endian."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = Code(row["code"]).all().astype("<u4"), np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([row["shard"]] * len(sizes), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "local": pa.array(row["first"] + ends - sizes, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([zlib.crc32(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.int64()),
                })

    docs = spark.read.schema(SEGMENTS).parquet(path).mapInArrow(decode, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(shard_bases(spark, path), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id) for a table of global positions: a range join of positions with segments by block, then one access a position.

    Positions that are null, negative or past the end give no row.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path).join(shard_bases(spark, path), "shard").withColumn("lo", F.col("base") + F.col("first"))
    hi = F.col("lo") + F.col("n_tokens") - 1
    blocks = segments.filter("n_tokens > 0").select("lo", "n_tokens", "shard", "segment", F.explode(F.sequence(F.floor(F.col("lo") / SEGMENT_TOKENS), F.floor(hi / SEGMENT_TOKENS))).alias("block"))
    wanted = positions.select(F.col("position").cast("long")).filter("position >= 0").withColumn("block", F.floor(F.col("position") / SEGMENT_TOKENS))
    placed = wanted.join(blocks, "block").filter("position >= lo AND position < lo + n_tokens").select("position", (F.col("position") - F.col("lo")).alias("at"), "shard", "segment")
    with_code = placed.join(segments.select("shard", "segment", "code"), ["shard", "segment"]).select("position", "at", "code")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Code(c)[at] for c, at in zip(batch.column("code").to_pylist(), batch.column("at").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(got, pa.int64())], ["position", "id"])

    return with_code.mapInArrow(pick, "position long, id long")
