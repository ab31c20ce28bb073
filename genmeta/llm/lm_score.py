"""Language-model scores by a log-bilinear model, trained in numpy with noise-contrastive estimation.

Tokens are the blank-separated words of a text, A-Z lowered, then one end. All training rows are counted: tokens, and runs of
three classes. The classes are the COMMON most frequent tokens and OTHER groups of the rest (by their last two bytes); a
token's probability is that of its class given the two classes before, times its smoothed share of its class, so the model
gives a normalised probability to any text. The class model is log-bilinear: the next class's vector against the sum of the
context's vectors, each times its place's weights, plus a bias. Tasks train on their share of the counted runs, HELD at a
time, and parameters are averaged after each round. As a score is a sum over the two places, normalisers of all contexts come
from one matrix product, and the score of a run from two tables of classes by classes. Tasks split a batch of texts at once and
look up its distinct tokens.

Bounds: parameters, the tables of normalisers and scores (classes x classes) and the most frequent tokens, at most HEAD and all
of one count or none beyond the COMMON ones, are shared with all tasks; their sizes are parameters. Counts of all other tokens
come from a join, so every count is exact.

Nulls: a null text is empty (one token, the end); a null id trains as the empty id. Rows that share an id stay rows. An empty
table gives no rows; without training rows N is 0, every token unseen and the classes uniform. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fold, text_rows, whole_text, written

COMMON, OTHER = 1024, 512
CLASSES = COMMON + OTHER
HEAD = 250_000
DIM, NOISE, BATCH, ROUNDS, RATE = 24, 64, 2048, 2, 0.15
FLUSH = 400_000
PART, HELD = 8_000_000, 1 << 20  # tokens for each task that sums counted runs, and runs trained on at a time
TEXTS = 2048  # split at a time, if they aren't long
TINY = 1e-250
END = b""


def tokens_of(text: str) -> list[bytes]:
    """The tokens of one text, as tokenised() finds them."""
    return [*text.encode("utf-8", "replace").lower().split(), END]


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, the end first; the place of each token among them; where each text starts."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(words), 0)  # a text that starts or ends with a blank has empty parts there
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = before[parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()] + np.arange(len(texts))
    words = words.filter(full).dictionary_encode()
    at = np.zeros(len(words) + len(texts), np.int32)
    is_word = np.ones(len(at), bool)
    is_word[ends] = False
    at[is_word] = words.indices.to_numpy() + 1
    return pa.concat_arrays([pa.array([END], pa.binary()), words.dictionary]), at, np.concatenate([[0], ends[:-1] + 1])


def other(token: bytes) -> int:
    return COMMON + zlib.crc32(token[-2:]) % OTHER


def others(tokens: pa.Array) -> np.ndarray:
    endings = pc.binary_slice(tokens, -2, None).dictionary_encode()
    return np.array([other(t) for t in endings.dictionary.to_pylist()], np.int32)[endings.indices.to_numpy()]


def other_class() -> F.Column:
    return F.lit(COMMON) + (F.crc32(F.substring("token", -2, 2)) % OTHER).cast("int")


# --- counts --------------------------------------------------------------------------------------------------------------
def token_counts(rows: DataFrame) -> DataFrame:
    """(token, c) over all rows; tasks send each distinct token of about FLUSH once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.RecordBatch:
            sums = pa.Table.from_batches(held).group_by("token", use_threads=False).aggregate([("c", "sum")]).combine_chunks()
            return pa.RecordBatch.from_arrays([sums["token"].chunk(0), sums["c_sum"].chunk(0)], ["token", "c"])

        for batch in text_rows(batches, TEXTS):
            words, at, _ = tokenised(batch.column("text"))
            held.append(pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)))], ["token", "c"]))
            size += len(words)
            if size > 2 * FLUSH:
                held = [merged()]
                size = len(held[0])
                if size > FLUSH:
                    yield held.pop()
                    size = 0
        if held:
            yield merged()

    return rows.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def classes_of(tokens: pa.Array, common: pa.Array) -> np.ndarray:
    """The class of each token: its place among the common ones, or the group of the rest."""
    at = pc.fill_null(pc.index_in(tokens, value_set=common), -1).to_numpy()
    return np.where(at >= 0, at, others(tokens))


def contexts(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; before a text stand ends."""
    one = np.empty_like(ids)
    two = np.empty_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[starts] = two[starts] = end
    two[starts[starts < len(ids) - 1] + 1] = end
    return one, two


def run_counts(rows: DataFrame, common: list[bytes], end: int, parts: int) -> DataFrame:
    """(code, n): how often each run of three classes occurs in all rows, dealt over parts by code. Tasks have counted their
    runs, so rows are summed after the shuffle alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = pa.array(common, pa.binary()), [], 0

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        for batch in text_rows(batches, TEXTS):
            words, at, starts = tokenised(batch.column("text"))
            ids = classes_of(words, known)[at].astype(np.int64)
            one, two = contexts(ids, starts, end)
            held.append((two * CLASSES + one) * CLASSES + ids)
            size += len(ids)
            if size > 4 * FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return rows.select("text").mapInArrow(run, "code long, n long").repartition(parts, "code").groupBy("code").agg(F.sum("n").alias("n"))


def most_frequent(vocabulary: DataFrame, most: int, common: int) -> list[tuple[bytes, int]]:
    """(token, c), the most frequent first, of at most about most tokens: the common most frequent ones, then all others that
    occur more often than some count, so many that most are not exceeded. Tokens of one count are ordered by their bytes.

    How many tokens have each count says where to cut, so only tokens that are kept reach the driver, as columns.
    """
    sizes = vocabulary.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))  # one row a count: about the square root of all tokens at most
    counts = sizes.toArrow()
    c, upto = counts["c"].to_numpy(), np.cumsum(counts["n"].to_numpy())
    whole = int(np.searchsorted(upto, most, "right"))  # so many counts have all their tokens within most
    first = min(int(np.searchsorted(upto, common)), len(c) - 1)  # the common ones end within this count
    got = []
    if len(c):
        least = int(c[first])
        got = [vocabulary.filter(F.col("c") >= least).select("token", "c").orderBy(F.desc("c"), "token").limit(common).toArrow()]
        if whole:
            got += [vocabulary.filter((F.col("c") >= int(c[whole - 1]))).select("token", "c").toArrow()]
    held = {t: n for table in got for t, n in zip(table["token"].to_pylist(), table["c"].to_pylist(), strict=True)}
    return sorted(held.items(), key=lambda x: (-x[1], x[0]))


# --- the class model -----------------------------------------------------------------------------------------------------
@dataclass
class LogBilinear:
    context: np.ndarray  # classes x dim
    target: np.ndarray  # classes x dim
    place: np.ndarray  # 2 x dim: weights of the class before, and of the one before that
    bias: np.ndarray  # classes

    @staticmethod
    def start(share: np.ndarray, seed: int = 2) -> LogBilinear:
        rng = np.random.default_rng(seed)
        draw = lambda: rng.normal(0, 0.1, (len(share), DIM)).astype(np.float32)
        return LogBilinear(draw(), draw(), np.ones((2, DIM), np.float32), np.log(share).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.context.ravel(), self.target.ravel(), self.place.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray) -> LogBilinear:
        a, b, c = np.cumsum([CLASSES * DIM, CLASSES * DIM, 2 * DIM])
        return LogBilinear(flat[:a].reshape(-1, DIM).copy(), flat[a:b].reshape(-1, DIM).copy(), flat[b:c].reshape(2, DIM).copy(), flat[c:].copy())

    def past(self) -> list[np.ndarray]:
        """What train() knows of earlier steps, at its start."""
        return [np.full_like(x, 0.05) for x in (self.context, self.target, self.place, self.bias)]

    def train(self, codes: np.ndarray, n: np.ndarray, share: np.ndarray, rate: float, rng: np.random.Generator, past: list[np.ndarray]) -> None:
        """One pass over counted runs: true classes against NOISE classes drawn by their share, common to a batch."""
        log_noise = np.log(NOISE * share).astype(np.float32)
        order = rng.permutation(len(codes))
        edges = np.cumsum(share) / share.sum()
        for at in range(0, len(order), BATCH):
            code, weight = codes[order[at : at + BATCH]], n[order[at : at + BATCH]].astype(np.float32)
            weight = np.minimum(weight / weight.mean(), 50)
            word, one, two = code % CLASSES, code // CLASSES % CLASSES, code // CLASSES**2
            noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), CLASSES - 1)
            h1, h2 = self.context[one], self.context[two]
            h = h1 * self.place[0] + h2 * self.place[1]
            t = self.target[word]
            true = weight * (1 - sigmoid((h * t).sum(1) + self.bias[word] - log_noise[word]))
            false = -weight[:, None] * sigmoid(h @ self.target[noise].T + self.bias[noise] - log_noise[noise])
            dh = true[:, None] * t + false @ self.target[noise]
            scale = np.float32(1 / len(code))
            d_target = summed(np.concatenate([word, noise]), np.concatenate([true[:, None] * h, false.T @ h]))
            d_bias = np.bincount(np.concatenate([word, noise]), np.concatenate([true, false.sum(0)]), CLASSES).astype(np.float32)
            d_context = summed(np.concatenate([one, two]), np.concatenate([dh * self.place[0], dh * self.place[1]]))
            d_place = np.stack([(dh * h1).sum(0), (dh * h2).sum(0)])
            for value, p, g in zip((self.context, self.target, self.place, self.bias), past, (d_context, d_target, d_place, d_bias), strict=True):
                g *= scale * 64
                p += g * g
                value += rate * g / np.sqrt(p)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the class before and the one before that add to the score of each class (its bias is in the first)."""
        return (self.context * self.place[0]) @ self.target.T + self.bias, (self.context * self.place[1]) @ self.target.T

    def normalisers(self, two: int | np.ndarray) -> np.ndarray:
        """log of the sum over all classes, for each class before, given the one before that (or each of several)."""
        first, second = (x.astype(np.float64) for x in self.tables())
        second = second[two]
        tops = first.max(1), second.max(-1, keepdims=True)
        sums = np.exp(second - tops[1]) @ np.exp(first - tops[0][:, None]).T
        out = tops[0] + tops[1] + np.log(np.maximum(sums, TINY))
        for at in zip(*np.nonzero(sums <= TINY), strict=True):  # both tops are far from the sum's: term by term
            s = first[at[-1]] + second[at[:-1]]
            out[at] = s.max() + np.log(np.exp(s - s.max()).sum())
        return out


def summed(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """classes x dim: the sum of the rows at each class."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros((CLASSES, DIM), np.float32)
    out[at[starts]] = np.add.reduceat(rows[order], starts)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trained(runs: DataFrame, share: np.ndarray) -> LogBilinear:
    """Rounds of training in tasks, then an average of the parameters, weighted by the runs that a task saw."""
    spark = runs.sparkSession
    model = LogBilinear.start(share)
    size, blocks = len(model.flat()), 64
    width = -(-size // blocks)
    runs = written(runs, "runs")
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model.flat(), share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            flat, share = shared.value
            own, rng, total = LogBilinear.of(flat), np.random.default_rng(r), 0.0
            past, held, size = own.past(), [], 0

            def step() -> float:
                codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
                own.train(codes, n, share, RATE / (1 + r), rng, past)
                return float(n.sum())

            for b in batches:
                held.append((b.column("code").to_numpy(), b.column("n").to_numpy()))
                size += b.num_rows
                if size >= HELD:
                    total += step()
                    held, size = [], 0
            if size:
                total += step()
            if total:
                out = own.flat()
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([out[k * width : (k + 1) * width].tobytes() for k in range(blocks)], pa.binary()), pa.array([total] * blocks)], ["block", "part", "n"])

        def mean(part: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(p, np.float32) * w for p, w in zip(part["part"], part["n"], strict=True)) / part["n"].sum()
            return pd.DataFrame({"block": [part["block"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})

        got = runs.mapInArrow(run, "block int, part binary, n double").groupBy("block").applyInPandas(mean, "block int, part binary").collect()
        if got:
            model = LogBilinear.of(np.concatenate([np.frombuffer(x["part"], np.float32) for x in sorted(got, key=lambda x: x["block"])]))
    drop_table(runs)
    return model


def all_normalisers(spark, model: LogBilinear) -> np.ndarray:
    """classes x classes, [two before, one before]."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = shared.value.normalisers(batch.column("id").to_numpy()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in z], pa.binary())], ["id", "z"])

    got = spark.range(0, CLASSES, 1, 12).mapInArrow(run, "id long, z binary").collect()
    return np.stack([np.frombuffer(x["z"], np.float32) for x in sorted(got, key=lambda x: x["id"])])


# --- scores --------------------------------------------------------------------------------------------------------------
@dataclass
class Shared:
    head: dict[bytes, int]
    base: np.ndarray  # log10 of the smoothed share of each head token; here and below one more entry, for tokens outside the head
    known: np.ndarray
    classes: np.ndarray
    within: np.ndarray  # log10 of its share of its class
    model: LogBilinear
    z: np.ndarray
    end: int


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); trains on the rows outside fold 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), (fold(held_out, id_col) == 0).alias("held_out"))
    learn = rows.filter(~F.col("held_out"))
    vocabulary = written(token_counts(learn).withColumn("other", other_class()), "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(vocabulary, HEAD, COMMON)
    common = [t for t, _ in top[:COMMON]]
    end = common.index(END) if END in common else 0

    # counts and kinds of tokens in each class outside the common ones
    c_common = Counter(other(t) for t in common)
    n_common = Counter()
    for t, c in top[:COMMON]:
        n_common[other(t)] += c
    own = {r["other"]: (r["n"], r["v"]) for r in vocabulary.groupBy("other").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    in_class = {k: own.get(k, (0, 0)) for k in range(COMMON, CLASSES)}
    rest = {k: (n - n_common[k], v - c_common[k]) for k, (n, v) in in_class.items()}
    share = np.zeros(CLASSES)
    share[: len(common)] = [c for _, c in top[:COMMON]]
    share[COMMON:] = [rest[k][0] for k in range(COMMON, CLASSES)]
    share = (share + 0.1) / (share + 0.1).sum()
    below = {k: n + 0.1 * (v + 1) for k, (n, v) in rest.items()}

    parts = max(6, spark.sparkContext.defaultParallelism, -(-total // PART))
    model = trained(run_counts(learn, common, end, parts), share)
    z = all_normalisers(spark, model)
    floor = total + 0.1 * (distinct + 1)
    counts = np.array([c for _, c in top], np.float64)
    classes = np.array([*(i if i < COMMON else other(t) for i, (t, _) in enumerate(top)), -1], np.int64)
    within = np.array([*(0.0 if i < COMMON else np.log10((c + 0.1) / below[classes[i]]) for i, (_, c) in enumerate(top)), 0.0])
    base = np.append(np.log10((counts + 0.1) / floor), 0.0)
    known = np.append((counts > 0).astype(np.int64), 0)
    shared = spark.sparkContext.broadcast(Shared({t: i for i, (t, _) in enumerate(top)}, base, known, classes, within, model, z, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = shared.value
        by_one, by_two = (x.ravel() for x in s.model.tables())
        z = s.z.ravel()
        number = TaskContext.get().partitionId() << 40
        for batch in text_rows(batches, TEXTS):
            words, at, starts = tokenised(batch.column("text"))
            place = np.array([s.head.get(t, -1) for t in words.to_pylist()])
            rare = place < 0
            ids = np.where(rare, others(words), s.classes[place]).astype(np.int32)[at]
            one, two = contexts(ids, starts, s.end)
            log_p = np.empty(len(at))
            for k in range(0, len(at), 1 << 16):
                a, b, c = (x[k : k + (1 << 16)].astype(np.int64) for x in (one, two, ids))
                log_p[k : k + (1 << 16)] = by_one[a * CLASSES + c] + by_two[b * CLASSES + c] - z[b * CLASSES + a]
            n_tokens = np.diff(starts, append=len(at))
            known, base, within = (np.add.reduceat(of[place][at], starts) for of in (s.known, s.base, s.within))
            left = np.flatnonzero(rare[at])
            key, tf = np.unique((np.searchsorted(starts, left, "right") - 1) * len(words) + at[left], return_counts=True)
            tokens = pa.StructArray.from_arrays([words.take(pa.array(key % len(words))), pa.array(tf)], ["token", "tf"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(key, np.arange(len(starts) + 1) * len(words)), pa.int32()), tokens)
            row = np.arange(len(starts)) + number
            number += len(starts)
            columns = (row, n_tokens, known, base, np.add.reduceat(log_p, starts) / np.log(10) + within)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns), tail], ["doc_id", "held_out", "row", "n_tokens", "known", "base", "model", "tail"])

    schema = "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, model double, tail array<struct<token:binary,tf:long>>"
    scored = written(rows.mapInArrow(run, schema), "scored")
    tail = scored.select("row", F.inline("tail")).join(vocabulary.select("token", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    denominators = F.create_map(*(x for k in range(COMMON, CLASSES) for x in (F.lit(k), F.lit(float(below[k])))))
    tail = tail.withColumn("below", F.element_at(denominators, other_class()))
    sums = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.1) / F.lit(float(floor)))).alias("b"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.1) / F.col("below"))).alias("m"),
    )
    zero = F.lit(0.0)
    return scored.drop("tail").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("model") + F.coalesce("m", zero)).alias("score"),
    )
