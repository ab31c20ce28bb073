"""Byte-level BPE by tree reduction.

Encoding is treated as a reduction over an associative join. A text is halved until a piece is short, pieces are encoded,
and neighbours are joined: the join re-encodes only a window around the cut. The window starts and ends where white space
follows something else; no alternative of the split pattern spans such a place, so tokens outside the window stand as they
are. If a side has no such place, the window grows over all of it. Within one long match of the pattern (no such place at
all) halves are joined by merge windows: the window grows until the tokens at its two rims are compatible with their outer
neighbours, that is, until the neighbour and the rim token encode to themselves as a pair. A sequence whose adjacent pairs
all do so is the encoding of its bytes, so tokens outside are proven stable.

Decoding joins the bytes of halves up the same tree. Nulls: a null text is empty and gives no token; a null id stays null. Rows that share an id stay rows, and equal texts get equal
ids. An empty table gives no rows. Texts are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows, whole_text

LEAF_CHARS = 4096
LONG_MATCH = 1024


class TreeBpe:
    #: The code points that the split pattern's \\s stands for.
    WHITE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS, long_match: int = LONG_MATCH):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.match = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.blank_run = regex.compile(r"\s{%d}" % long_match)
        self.leaf, self.long_match, self.pairs = leaf, long_match, {}

    # encoding
    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._leaf(text)
        cut = len(text) // 2
        return self._join(text[:cut], self.encode(text[:cut]), text[cut:], self.encode(text[cut:]))

    def _leaf(self, text: str) -> list[int]:
        if len(text) > self.long_match and (max(map(len, text.split()), default=0) >= self.long_match or self.blank_run.search(text)):
            return [t for m in self.match.finditer(text) for t in self._one(m.group().encode())]
        return self.core.encode_ordinary(text)

    def _join(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        start, end = self._last_place(a), self._first_place(b)
        n_left = len(self._window(a[start:]))
        n_right = len(self._window(b[:end]))
        return left[: len(left) - n_left] + self._window(a[start:] + b[:end]) + right[n_right:]

    def _window(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text) if len(text) <= self.long_match else self._leaf(text)

    @staticmethod
    def _last_place(a: str) -> int:
        """The last place in a where white space follows something else, or 0."""
        white = TreeBpe.WHITE
        return next((i for i in range(len(a) - 1, 0, -1) if a[i] in white and a[i - 1] not in white), 0)

    @staticmethod
    def _first_place(b: str) -> int:
        white = TreeBpe.WHITE
        return next((i for i in range(1, len(b)) if b[i] in white and b[i - 1] not in white), len(b))

    def _one(self, data: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        if len(data) <= self.long_match:
            return self.core._encode_single_piece(data)
        cut = len(data) // 2
        left, right = self._one(data[:cut]), self._one(data[cut:])
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            mid = self.core._encode_single_piece(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == 0 or self._stable(left[i - 1], mid[0])) and (j == len(right) or self._stable(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            k *= 2

    def _stable(self, a: int, b: int) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > 1 << 18:
                self.pairs.clear()
            self.pairs[a, b] = self.core._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.pairs[a, b]

    # decoding
    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


_known: dict[tuple[str, str], TreeBpe] = {}


def tree_bpe(ranks_path: str, pattern: str) -> TreeBpe:
    """One for each worker process."""
    if (ranks_path, pattern) not in _known:
        _known[ranks_path, pattern] = TreeBpe(ranks_path, pattern)
    return _known[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(ranks_path, pattern)
        for batch in text_rows(batches):
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data) of every row of (doc_id, ids); null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(ranks_path, pattern)
        for batch in text_rows(batches):
            data = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so that ids need not leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(ranks_path, pattern)
        for batch in text_rows(batches):
            n, ids_sha, data_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                data_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
