"""Near-duplicate classes by order MinHash.

A text is its lower-cased, blank-separated words; texts with the same words are copies and one vertex. The k-mers are runs
of three words, labelled with their occurrence number. A sample keeps two labelled k-mers, the smallest or the largest under
its permutation, in text order, so it agrees for two texts only if they share both k-mers and their order. Pairs that agree
in any of BANDS samples are candidates, verified by banded alignment of the words: a link needs an edit similarity of 0.8 or
more (1 - distance / longer length). Runs of three and not of five words: with an edit in every fifth word two texts of edit
similarity 0.8 share no run of five words at all. Measured chance that a pair of exactly 0.8 is a candidate, edits at random
places and in every fifth word: 0.99 and 0.90 at 15 words, 1.0 and 0.92 at 20, 1.0 and 0.98 or more from 40 to 500; 0.93 and
0.61 at 10 words.

Hot groups. Copies meet in partial aggregates. In a bucket members are first compared with its smallest member only, then one
pair of each two components, so a group of n near copies needs about n alignments; then every pair of different components
that shares a bucket, whatever its size. Pairs that length or word counts prove to be further apart are left out before their
words are fetched. A bucket is compared in tiles of two blocks, each in one task, so no bucket is one task and no pair that isn't
plausible becomes a row. No pair of one component is compared, no bucket is cut.

Nulls: a null text is empty; a text without words is a class of its own, one for each row. A null id gives a null class.
Rows that share an id stay rows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, drop_table, mixed, release, text_rows, whole_text, written
from .graph import components, extended

K = 3
SIMILARITY = 0.8
BANDS = 80
BAG, PARITY = 1024, 1024
FACTS = ["size", "bag", "odd"]
TILE, STRIPE, PIECE = 2048, 64, 4096
#: The low bits of a key are its band; NONE is no key of any band.
BAND_BITS, NONE = 7, -1
#: Texts of edit similarity SIMILARITY or more are in one class of sizes or in neighbouring ones.
STEP = 1.01 / SIMILARITY
SALTS = 16
SEED = 0x5EED
TIMES = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 2048


def words_of(text: str) -> list[str]:
    return text.lower().split()


class OrderMinHash:
    def __init__(self, bands: int = BANDS, k: int = K, seed: int = SEED):
        self.bands, self.k = bands, k
        rng = np.random.default_rng(seed)
        n = bands // 2  # each permutation gives two samples
        self.flip = rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]
        self.times = (rng.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1))[:, None]

    def labelled(self, hashes: np.ndarray) -> np.ndarray:
        """k-mers (a shorter text is one of all its words) with their occurrence number mixed in."""
        k = min(self.k, len(hashes))
        n = len(hashes) - k + 1
        s = hashes[:n].copy()
        for i in range(1, k):
            s = s * TIMES + hashes[i : i + n]
        s = mixed(s, k)
        t = np.sort(s)
        if not (t[1:] == t[:-1]).any():
            return mixed(s, 1)
        order = np.argsort(s, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        number = np.arange(len(s)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(s)]])))
        out = np.empty(len(s), np.uint64)
        out[order] = number.astype(np.uint64)
        return mixed(s + out * TIMES, 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """One key for each band; its low bits are the band."""
        x = self.labelled(hashes)
        found = [self.ends(x[at : at + BLOCK]) + at for at in range(0, len(x), BLOCK)]
        if len(found) > 1:
            kept = np.concatenate(found, axis=1)
            found = [np.take_along_axis(kept, self.ends(x[kept]), 1)]
        at = np.sort(found[0].reshape(len(self.flip), 2, 2), axis=2).reshape(-1, 2)
        band = np.arange(self.bands, dtype=np.uint64)
        return mixed((x[at[:, 0]] * TIMES + x[at[:, 1]]) * TIMES + band, 2) >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | band

    def ends(self, x: np.ndarray) -> np.ndarray:
        """Places of the two smallest and the two largest k-mers under each permutation; one alone is all of them."""
        h, rows = (x ^ self.flip) * self.times, np.arange(len(self.flip))
        low = h.argmin(1)
        kept = h[rows, low]
        h[rows, low] = np.iinfo(np.uint64).max
        second = h.argmin(1)
        h[rows, low] = kept
        high = h.argmax(1)
        h[rows, high] = 0
        return np.stack([low, second, h.argmax(1), high], axis=1)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to insert, delete or replace; most + 1 if there are more than most. The band doubles until it proves the result."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    differs = a[:n] != b[:n]
    start = int(differs.argmax()) if differs.any() else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differs = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
    end = int(differs.argmax()) if differs.any() else n
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return min(len(a) + len(b), most + 1)
    # every word that one text has more often than the other costs an edit
    _, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    balance = np.bincount(inverse[: len(a)], minlength=inverse.max() + 1) - np.bincount(inverse[len(a) :], minlength=inverse.max() + 1)
    least = int(max(balance.clip(0).sum(), (-balance).clip(0).sum()))
    if least > most:
        return most + 1
    width = min(most, max(8, least, abs(len(a) - len(b))))
    while True:
        d = _in_band(a, b, width)
        if d <= width:
            return d
        if width >= most:
            return most + 1
        width = min(most, 2 * width)


def _in_band(a: np.ndarray, b: np.ndarray, w: int) -> int:
    """Distance along alignments that stay within w diagonals; more than w if it isn't proven.

    The differences between neighbouring cells of a band's column are bits of two integers, so a word of b costs a few
    operations on integers of the band's width. Bits of the band are the places of a from start on; a word's bits are kept
    from the base at which they were last written.
    """
    a, b = (a.tolist(), b.tolist()) if len(a) >= len(b) else (b.tolist(), a.tolist())
    n, w = len(a), min(w, len(a))
    size = 2 * w + 2
    full, last = (1 << size) - 1, 1 << (size - 1)
    level = 1 << (size - 2)
    up, down, distance = full & ~((1 << (size - w - 1)) - 1), 0, w
    start, bits = w + 1 - size, {}
    for at in range(min(w, n)):
        m, base = bits.get(a[at], (0, start))
        bits[a[at]] = m | 1 << (at - start), base
    for i, word in enumerate(b):
        if i + w < n:
            m, base = bits.get(a[i + w], (0, start))
            bits[a[i + w]] = m >> (start - base) | 1 << (i + w - start), start
        m, base = bits.get(word, (0, start))
        x = m >> (start - base) & full
        same = (((x & up) + up) ^ up | x | down) & full
        more, fewer = down | full & ~(same | up), same & up
        if i < n - w:
            distance += not same & last
        else:
            distance += bool(more & level) - bool(fewer & level)
            level >>= 1
        up, down = fewer | full & ~(same >> 1 | more), same >> 1 & more
        start += 1
    return distance if distance <= w else w + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    most = int(np.floor((1 - least) * longer + 1e-9))
    return edit_distance(a, b, most) <= most


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, t, h, size, bands) of (doc_id, t, text): h is the hash of the words, null for a text without words, size their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketch = WordHashes(), OrderMinHash()
        for batch in text_rows(batches):
            words.trim()
            keys, sizes, bands = [], [], []
            for text in batch.column("text").to_pylist():
                w = words_of(text)
                keys.append(xxhash.xxh3_64_intdigest(" ".join(w)) - (1 << 63) if w else None)
                sizes.append(len(w))
                bands.append(sketch.of(words.of(w)).view(np.int64) if w else None)
            columns = [batch.column("doc_id"), batch.column("t"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "h", "size", "bands"])

    return docs.mapInArrow(run, "doc_id long, t long, h long, size long, bands array<long>")


def bucket_members(texts: DataFrame) -> DataFrame:
    """(key, h, size) of (h, size, bands), one row a text: members of buckets that hold another text of a size that may be linked.

    The first shuffle counts keys, the second brings members to the keys that several texts share; what follows is small.
    """
    rows = texts.select("h", "size", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    sized = written(rows.join(shared, "key").withColumn("step", F.floor(F.log("size") / float(np.log(STEP)))), "sized")
    around = sized.groupBy("key", "step").agg(F.count("*").alias("n")).select("key", F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1)).alias("step"), "n")
    met = around.groupBy("key", "step").agg(F.sum("n").alias("n")).filter("n > 1").select("key", "step")
    members = written(sized.join(met, ["key", "step"]).select("key", "h", "size"), "members")
    drop_table(sized)
    return members


def led(members: DataFrame) -> DataFrame:
    """(a, b): each member with the smallest of its bucket, where sizes allow a link."""
    least = members.groupBy("key").agg(F.min(F.struct("h", "size")).alias("least"))
    most = F.floor(F.greatest("size", "least.size") * (1 - SIMILARITY) + 1e-9)
    return members.join(least, "key").filter((F.col("h") != F.col("least.h")) & (F.abs(F.col("size") - F.col("least.size")) <= most)).select(F.col("least.h").alias("a"), F.col("h").alias("b")).distinct()


def word_arrays(texts: DataFrame) -> DataFrame:
    """(h, words, size, bag, odd): 64-bit hashes of the words of each text, how many there are, how many fall in each of BAG bins (127 at most), and a bitmap of the PARITY bins that hold an odd number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in text_rows(batches):
            words.trim()
            split = [words_of(t) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_64_intdigest(" ".join(w)) - (1 << 63) for w in split]
            hashes = [words.of(w) for w in split]
            bags = [np.bincount((x % np.uint64(BAG)).astype(np.int64), minlength=BAG).clip(0, 127).astype(np.int8).tobytes() for x in hashes]
            odd = [np.packbits((np.bincount((x % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(bool)).tobytes() for x in hashes]
            columns = [pa.array(keys, pa.int64()), pa.array([x.view(np.int64) for x in hashes], pa.list_(pa.int64())), pa.array([len(w) for w in split], pa.int64()), pa.array(bags, pa.binary()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "words", "size", "bag", "odd"])

    return texts.mapInArrow(run, "h long, words array<long>, size long, bag binary, odd binary")


class Facts:
    """What is known of texts without their words: rows of arrays."""

    def __init__(self, columns: dict[str, pa.Array]):
        plain = lambda c: np.asarray(columns[c])
        wide = lambda c, kind: np.frombuffer(b"".join(columns[c].to_pylist()), kind).reshape(len(columns[c]), -1)
        self.h, self.c, self.size = plain("h"), plain("c"), plain("size")
        self.bag, self.odd = wide("bag", np.int8), wide("odd", np.uint64)


def allowed(x: Facts, i: np.ndarray, y: Facts, j: np.ndarray) -> np.ndarray:
    """False only for pairs (i of x, j of y) that no alignment can link.

    An edit changes the length by one and the parity of two bins at most, and adds and removes one word at most. Bins count to
    127, which can only lower a surplus.
    """
    most = np.floor((1 - SIMILARITY) * np.maximum(x.size[i], y.size[j]) + 1e-9)
    ok = np.abs(x.size[i] - y.size[j]) <= most
    for test in (lambda i, j: (np.bitwise_count(x.odd[i] ^ y.odd[j]).sum(1), 2), lambda i, j: (_surplus(x.bag[i], y.bag[j]), 1)):
        left = np.flatnonzero(ok)
        for at in range(0, len(left), PIECE):
            some = left[at : at + PIECE]
            value, times = test(i[some], j[some])
            ok[some] = value <= times * most[some]
    return ok


def _surplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.maximum(np.maximum(d, 0).sum(1, dtype=np.int64), np.maximum(-d, 0).sum(1, dtype=np.int64))


def plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those (a, b) that facts allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (Facts({"h": batch.column(k), "c": batch.column(k)} | {f: batch.column(f"{f}_{k}") for f in FACTS}) for k in ("a", "b"))
            at = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(allowed(x, at, y, at), pa.bool_()))

    of = lambda col: facts.select(F.col("h").alias(col), *(F.col(f).alias(f"{f}_{col}") for f in FACTS))
    return pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(run, "a long, b long")


def crowded_pairs(members: DataFrame, *, components_too: bool = False) -> DataFrame:
    """(a, b) of members (key, h, c, and facts) of one bucket but of different components that facts allow to be linked; components_too adds these, ca and cb.

    A bucket is cut into blocks of about TILE members by their hash, and each two blocks, or one with itself, are a tile that one
    task compares in arrays: a bucket of any size is spread over many tasks, no row is made for a pair that isn't plausible, and
    none is left out. A pair that shares several buckets comes from the first of them alone: prints, the keys of all buckets with
    members of different components that a text is in, say which that is.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    placed = members.join(counts.select("key", blocks.alias("blocks")), "key").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = placed.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select("key", "lo", "hi", "own", "h", "c", *FACTS, "prints")
    sorted_ = tiled.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    names = ["a", "b", "ca", "cb"] if components_too else ["a", "b"]

    def pairs_of(tile: pa.Table) -> pa.RecordBatch:
        f = Facts({c: tile.column(c).combine_chunks() for c in ("h", "c", *FACTS)})
        own, lo, hi = (np.asarray(tile.column(c)) for c in ("own", "lo", "hi"))
        held, key = tile.column("prints").combine_chunks(), tile.column("key")[0].as_py()
        flat, low = held.flatten().to_numpy(), (1 << BAND_BITS) - 1
        prints = np.full((len(own), BANDS), NONE, np.int64)
        prints[np.repeat(np.arange(len(own)), held.value_lengths().to_numpy()), flat & low] = flat
        left, right = np.flatnonzero(own == lo[0]), np.flatnonzero(own == hi[0])
        found = []
        for at in range(0, len(left), STRIPE):
            some = left[at : at + STRIPE]
            i, j = np.repeat(some, len(right)), np.tile(right, len(some))
            keep = f.c[i] != f.c[j]
            if lo[0] == hi[0]:
                keep &= i < j
            i, j = i[keep], j[keep]
            ok = allowed(f, i, f, j)
            i, j = i[ok], j[ok]
            first = ((prints[i] == prints[j]) & (prints[i] != NONE)).argmax(1)
            here = prints[i, first] == key
            found.append((f.h[i[here]], f.h[j[here]], f.c[i[here]], f.c[j[here]]))
        a, b, ca, cb = (np.concatenate([p[k] for p in found]) for k in range(4))
        swap = a > b
        columns = [np.minimum(a, b), np.maximum(a, b), np.where(swap, cb, ca), np.where(swap, ca, cb)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns[: len(names)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "lo", "hi")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                name = tuple(keys[:, begin])
                if open_ and name != last:
                    yield pairs_of(pa.Table.from_batches(open_))
                    open_ = []
                open_.append(batch.slice(begin, end - begin))
                last = name
        if open_:
            yield pairs_of(pa.Table.from_batches(open_))

    return sorted_.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def verified(pairs: DataFrame, words: DataFrame, *, many: bool = False) -> DataFrame:
    """Those (a, b) whose alignment shows SIMILARITY; b is fetched first, a may be one text in very many pairs.

    Only words that a pair asks for are moved: pairs of late rounds are few, and then small enough for Spark to broadcast.
    many: pairs grow with the table, so they are shuffled whatever their size, and small tables cost what large ones do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches, 64):
            a, b = batch.column("wa"), batch.column("wb")
            keep = [similar(np.asarray(x.values), np.asarray(y.values)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    needed = words.select("h", "words").join(asked, "h", "left_semi")
    pairs = pairs.hint("merge") if many else pairs
    with_b = pairs.join(needed.select(F.col("h").alias("b"), F.col("words").alias("wb")), "b")
    with_b = with_b.hint("merge") if many else with_b
    both = with_b.join(needed.select(F.col("h").alias("a"), F.col("words").alias("wa")), "a")
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def relabelled(members: DataFrame, labels: DataFrame, col: str, name: str) -> DataFrame:
    """members with the component of col: a vertex without links is its own."""
    return members.join(labels.select(F.col("v").alias(col), F.col("c").alias("found")), col, "left").withColumn(name, F.coalesce("found", col)).drop("found")


def separate(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, ca, cb) of those (a, b) whose components, ca and cb, differ."""
    return relabelled(relabelled(pairs.select("a", "b"), labels, "a", "ca"), labels, "b", "cb").filter("ca <> cb")


def settled(apart: DataFrame, words: DataFrame, labels: DataFrame, links: DataFrame, rounds: tuple[bool, ...]) -> tuple[DataFrame, DataFrame]:
    """labels and links after verifying untested pairs of different components (a, b, ca, cb): in rounds of True one pair of each two components, since one link joins all of both; in those of False every pair still apart.

    A round hands on only pairs that are still apart, so pairs within a component are joined with labels once.
    """
    for n, one_each in enumerate(rounds):
        if n:
            apart = separate(apart.join(asked, ["a", "b"], "left_anti"), labels)
        if one_each:
            apart = written(apart, "still-apart")
            asked = apart.groupBy(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
        else:
            asked = apart.select("a", "b")
        asked = written(asked, "asked")
        if asked.isEmpty():
            break
        more_links = written(verified(asked, words), "links")
        labels, links = extended(labels, more_links), links.union(more_links)
    return labels, links


def class_ids(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, c, class_id) of (h, doc_id): the smallest doc_id of each component. The join by component is salted: one may hold most texts."""
    linked = texts.join(labels.select(F.col("v").alias("h"), "c"), "h").withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)))
    least = linked.groupBy("c").agg(F.min("doc_id").alias("class_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return linked.join(least, ["c", "salt"]).select("h", "c", "class_id")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every row: class_id is the smallest doc_id among all that links connect; n_links counts the linked different texts."""
    return placed(docs, id_col, text_col).select("doc_id", "class_id", "n_links")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class: that with the smallest id, then the smallest hash of its text; of equal rows one.

    Rows are told apart by id and text, so a row stays whatever other rows share its id. Rows with a null id or without words
    stay as they are. Texts are shuffled once.
    """
    where = written(placed(docs, id_col, text_col).filter("h IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "t", "c").agg(F.count("*").alias("n")), "placed")
    best = where.groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("best")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = where.withColumn("salt", F.pmod(F.xxhash64("doc_id", "t"), F.lit(SALTS)))
    decided = written(salted.join(best, ["c", "salt"]).select("doc_id", "t", "n", ((F.col("best.doc_id") == F.col("doc_id")) & (F.col("best.t") == F.col("t"))).alias("stays")).filter("n > 1 OR NOT stays"), "decided")
    keyed = docs.withColumn("id_", F.col(id_col).cast("long")).withColumn("t_", F.xxhash64(whole_text(text_col)))
    of = lambda rows: rows.select(F.col("doc_id").alias("id_"), F.col("t").alias("t_")).distinct()
    out = keyed.join(of(decided).hint("merge"), ["id_", "t_"], "left_anti").select(*docs.columns)  # rows decided grow with the table: shuffled whatever their size
    repeated = decided.filter("stays")
    if not repeated.isEmpty():
        out = out.union(keyed.join(of(repeated), ["id_", "t_"], "left_semi").dropDuplicates(["id_", "t_"]).select(*docs.columns))
    return out


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, h, c, class_id, n_links) of every row: t is a hash of its text, h of its words, c names its component."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    with_bands = written(sketches(rows), "sketches")
    sketched = written(with_bands.select("doc_id", "t", "h"), "ids")
    texts = written(with_bands.filter("h IS NOT NULL").groupBy("h").agg(F.first("size").alias("size"), F.first("bands").alias("bands")), "bands")
    drop_table(with_bands)
    release(texts)
    members = bucket_members(texts)
    drop_table(texts)
    release(members)
    wanted = members.select("h").distinct()
    reps = sketched.select("doc_id", "h").join(wanted, "h").groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    reps = written(reps.distinct(), "reps")  # a table, so that Spark knows its size before it decides whether to shuffle texts
    words = written(word_arrays(rows.join(reps, "doc_id").select("text")).dropDuplicates(["h"]), "words")
    drop_table(reps)
    facts = words.select("h", *FACTS)

    # first each text with the smallest of its buckets' smallest members, then with those that are still apart
    leaders = written(plausible(led(members), facts), "leaders")
    tested = leaders.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = written(verified(tested, words, many=True), "links")
    labels = components(links)
    labels, links = settled(separate(leaders.join(tested, ["a", "b"], "left_anti"), labels), words, labels, links, (True, True, False))

    # then what is still apart within a bucket
    now = relabelled(members.select("key", "h"), labels, "h", "c")
    mixed_keys = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    apart = written(now.join(mixed_keys, "key"), "apart")
    prints = apart.groupBy("h").agg(F.collect_list("key").alias("prints"))  # one for each band at most
    crowd = written(apart.join(prints.join(facts, "h"), "h"), "crowded")
    pairs = crowded_pairs(crowd, components_too=True).join(leaders, ["a", "b"], "left_anti")
    labels, links = settled(pairs, words, labels, links, (True, False))
    for table in (members, leaders, words, apart, crowd):
        drop_table(table)

    ends = links.select(F.col("a").alias("h"), F.col("b").alias("o")).union(links.select("b", "a")).distinct().groupBy("h").agg(F.count("o").alias("n_links"))
    own = sketched.filter("h IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    of_text = own.select("h", F.col("doc_id").alias("own")).join(class_ids(own, labels), "h", "left").join(ends, "h", "left").select("h", F.coalesce("c", "h").alias("c"), F.coalesce("class_id", "own").alias("class_id"), "n_links")
    joined = sketched.select("doc_id", "t", "h").join(of_text, "h", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    return joined.select("doc_id", "t", "h", "c", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
