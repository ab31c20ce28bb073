"""Benchmark decontamination by the CGK embedding.

Words are compared case-free. The CGK walk reads a text with a pointer and writes one symbol a step; whether the pointer
moves on is a random bit of (step, symbol), the same for all texts. Texts within a small edit distance end up at a small
Hamming distance, since the walks meet again after an edit. For every benchmark item, each item-sized window of a document
is embedded, a repetition keeps a few random places of the embedding, and windows and items that agree on all of them are
candidates. Repetitions are independent walks and places. Candidates are verified by exact edit distance of the words: a
window is a passage of the item if at most a fifth of the item's words differ.

Lossless skip: if at most k = n // 5 words of an n-word item differ, one of k + 1 parts of it is untouched, so the window
holds a run of q = n // (k + 1) words of the item in its place, give or take k words; an edit spoils at most q of an item's
runs of q words, so n - q + 1 - k q of them occur in the text. Windows without such runs are not embedded. A window is
anchored at each such run, so it starts where the item's start would be.

The benchmark is broadcast only if it has at most MOST_ITEM_BYTES; a larger one is dealt in slices, each within the bound.
Nulls: a null text is empty, rows or items without words or with a null item id give no finding. An empty
table of documents or items gives no findings; repeated rows and items each give their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, combined, mixed, text_rows, whole_text
from .near_dup import edit_distance

SHARE = 0.2
REPETITIONS, PLACES = 16, 2
MOST_ITEM_BYTES = 32 << 20
BATCH = 4096


def allowed(n: int) -> int:
    return int(np.floor(SHARE * n + 1e-9))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def cgk(windows: np.ndarray, lengths: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Walks over rows of word hashes (0 past the end), as (rows, steps)."""
    out = np.empty((len(windows), steps), np.uint64)
    rows, at = np.arange(len(windows)), np.zeros(len(windows), np.int64)
    for step in range(steps):
        symbol = np.where(at < lengths, windows[rows, np.minimum(at, windows.shape[1] - 1)], np.uint64(0))
        out[:, step] = symbol
        at += (mixed(symbol, seed * 100_003 + step) >> np.uint64(63)).astype(np.int64)
    return out


class Benchmark:
    """Items, the runs that anchor windows, and the buckets of their embeddings."""

    def __init__(self, items: list[tuple[int, str]], repetitions: int = REPETITIONS, places: int = PLACES):
        self.repetitions = repetitions
        words = WordHashes()
        self.items = [(i, words.of(words_of(t))) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w)]
        self.run = min((len(w) // (allowed(len(w)) + 1) for _, w in self.items), default=1)
        self.run = max(1, min(self.run, 4))
        runs = []
        for k, (_, w) in enumerate(self.items):
            r = self.runs(w)
            runs.append((r, np.full(len(r), k), np.arange(len(r))))
        parts = [np.concatenate(x) if runs else np.zeros(0, np.int64) for x in zip(*runs, strict=True)] if runs else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        order = np.argsort(parts[0], kind="stable")
        self.run_hash, self.run_item, self.run_at = (p[order] for p in parts)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.run_hash >> np.uint64(44)] = True
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)
        self.least = np.maximum(1, self.lengths - self.run + 1 - self.run * np.floor(SHARE * self.lengths + 1e-9).astype(np.int64))
        self.places = np.random.default_rng(3).random((repetitions, places))
        longest = int(self.lengths.max(initial=1))
        own = np.zeros((len(self.items), longest), np.uint64)
        for k, (_, w) in enumerate(self.items):
            own[k, : len(w)] = w
        self.keys = self.embedded(own, self.lengths, self.lengths)

    def runs(self, w: np.ndarray) -> np.ndarray:
        n = len(w) - self.run + 1
        return combined([w[i : i + n] for i in range(self.run)]) if n > 0 else np.zeros(0, np.uint64)

    def embedded(self, windows: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(rows, repetitions) bucket keys of windows of the given sizes, each for an item of n words."""
        keys, rows = np.empty((len(windows), self.repetitions), np.uint64), np.arange(len(windows))
        for r in range(self.repetitions):
            walk = cgk(windows, sizes, 2 * windows.shape[1], r)
            keys[:, r] = combined([walk[rows, (p * 2 * n).astype(np.int64)] for p in self.places[r]])
        return keys

    def starts(self, w: np.ndarray) -> np.ndarray:
        """(item, start) of the windows of the text w that may hold an item, as two rows."""
        runs = self.runs(w)
        hit = np.flatnonzero(self.seen[runs >> np.uint64(44)])
        lo, hi = np.searchsorted(self.run_hash, runs[hit], "left"), np.searchsorted(self.run_hash, runs[hit], "right")
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(hit):
            return np.zeros((2, 0), np.int64)
        counts = hi - lo
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        # how many places of each item occur in the text
        places = np.bincount(self.run_item[np.unique(which)], minlength=len(self.items))
        item, start = self.run_item[which], np.maximum(np.repeat(hit, counts) - self.run_at[which], 0)
        slack = np.floor(SHARE * self.lengths[item] + 1e-9).astype(np.int64)
        fits = (places[item] >= self.least[item]) & (start + self.lengths[item] - slack <= len(w))
        return np.unique(np.stack([item[fits], start[fits]]), axis=1)

    def findings(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """For each text (item, first word, distance) of the best window of each item that it holds."""
        found = [self.starts(w) for w in texts]
        doc = np.repeat(np.arange(len(texts)), [f.shape[1] for f in found])
        item, start = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for at in range(0, len(doc), BATCH):
            d, k, s = (x[at : at + BATCH] for x in (doc, item, start))
            n = self.lengths[k]
            sizes = np.minimum(n, np.array([len(texts[i]) for i in d]) - s)
            windows = np.zeros((len(d), int(n.max())), np.uint64)
            for row, (i, b, size) in enumerate(zip(d, s, sizes, strict=True)):
                windows[row, :size] = texts[i][b : b + size]
            agree = (self.embedded(windows, sizes, n) == self.keys[k]).any(1)
            for i, j, b in zip(d[agree], k[agree], s[agree], strict=True):
                distance = self.distance(texts[i], int(b), self.items[j][1])
                if distance <= allowed(int(self.lengths[j])) and (j not in best[i] or (distance, int(b)) < best[i][j]):
                    best[i][j] = (distance, int(b))
        return [[(self.items[k][0], b, d) for k, (d, b) in sorted(x.items())] for x in best]

    @staticmethod
    def distance(w: np.ndarray, start: int, own: np.ndarray) -> int:
        """Smallest distance between the item and a window from start, at most allowed() words shorter or longer."""
        n, most = len(own), allowed(len(own))
        d = edit_distance(w[start : start + n], own, most)
        for size in (x for s in range(1, most + 1) for x in (n - s, n + s)):
            if abs(size - n) >= d:
                break
            if 0 < size and start + size <= len(w):
                d = min(d, edit_distance(w[start : start + size], own, most))
        return d


def slices(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The benchmark in slices within MOST_ITEM_BYTES, read one after the other; its size is taken first."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // MOST_ITEM_BYTES))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def findings(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, distance, item_words): a document's best passage of each item it holds; no shuffle of documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), whole_text(item_text_col).alias("text")).filter("item_id IS NOT NULL")
    out = None
    for part in slices(items):
        shared = spark.sparkContext.broadcast(Benchmark(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench, words = shared.value, WordHashes()
            sizes = dict(zip((i for i, _ in bench.items), bench.lengths.tolist(), strict=True))
            for batch in text_rows(batches):
                words.trim()
                found = bench.findings([words.of(words_of(t)) for t in batch.column("text").to_pylist()])
                got = [(d, *f, sizes[f[0]]) for d, fs in zip(batch.column("doc_id").to_pylist(), found, strict=True) for f in fs]
                columns = list(zip(*got, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "first_word", "distance", "item_words"])

        found = rows.mapInArrow(run, "doc_id long, item_id long, first_word long, distance long, item_words long")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no passage, each judged by its own text, whatever its id; no shuffle."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), whole_text(item_text_col).alias("text")).filter("item_id IS NOT NULL")
    rows = docs.withColumn("text_", whole_text(text_col))
    for part in slices(items):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(part))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench, words = shared.value, WordHashes()
            for batch in text_rows(batches):
                words.trim()
                found = bench.findings([words.of(words_of(t)) for t in batch.column("text_").to_pylist()])
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*docs.columns)
