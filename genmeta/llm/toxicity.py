"""Toxicity: a convolutional text classifier in numpy.

A word is a hashed embedding of itself and of its first letters; filters of widths 1, 2 and 3 run over the whole text and
are max-pooled; a logistic layer scores the pooled values. Max pooling sends each gradient to one window, so a step costs a
gather of a few words. Scores are shifted by a threshold for each language, so that 0.5 is the threshold everywhere; the
language is the one that the text itself shows (the n-gram model of ``language``), never a column.

The model is fitted on about PER_LABEL labelled ids of each label at most (those with the smallest hashes; only ids and labels
are ranked, their texts are fetched afterwards). The query's thresholds come from the logits of all other labelled rows, counted in
cells (calibrate()). The bounded sample's own thresholds weigh its rows kept apart by how many ids of their label there
are, so they don't move when the bound takes a smaller share of the more frequent label. Every language that the rows kept apart
show gets a threshold: the cut with the fewest errors among its rows and all rows together, which count as COMMON rows of it.
So a language with few rows stays near the common threshold and moves away as its own evidence grows; a language that no row kept
apart shows takes the common one.

Nulls: a null text is empty; an empty text gets the score of a text in which no filter fires. Without labels, or with one
label only, all scores are 0. Labels whose id is null or in no document teach nothing; an id with both labels counts as
toxic, and of rows that share an id one text is learned from. Rows that share an id are scored one by one. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language
from .common import text_rows, whole_text

BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 10
PREFIXES = (4, 5)
PER_LABEL = 4000
COMMON = 20.0
CELLS = 64
CHUNK, WORDS = 1 << 14, 1 << 17


def buckets_of(word: str) -> tuple[int, ...]:
    """The buckets of a word: itself and its first letters."""
    w = word.strip(".,;:!?\"'()")
    return tuple(xxhash.xxh64_intdigest(f"{i}{x}".encode("utf-8", "surrogatepass")) % BUCKETS for i, x in enumerate((w, *(w[:n] for n in PREFIXES))))


class WordBuckets(dict):
    """Buckets of words, remembered; for training, on a bounded sample."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        value = self[word] = buckets_of(word)
        return value

    def of(self, text: str) -> np.ndarray:
        return np.array(list(map(self.__getitem__, text.lower().split())), np.int32).reshape(-1, 1 + len(PREFIXES))


class ToxicityModel:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.offsets = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.full(1, -1, np.float32)
        ones = lambda x: np.full_like(x, 0.1)
        self.past = {"embed": ones(self.embed), "filters": [ones(x) for x in self.filters], "offsets": [ones(x) for x in self.offsets], "out": ones(self.out), "bias": ones(self.bias)}
        self.thresholds: dict[str, float] = {}
        self.threshold = 0.0
        self.trained = False
        self.fitted: list[int] = []  # ids whose rows gradients came from

    def pooled(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter over the whole text, and the word where its window starts; -1 where it is below 0."""
        best, where = np.zeros(len(self.out), np.float32), np.full(len(self.out), -1)
        for at in range(0, len(buckets), CHUNK):
            x = self.embed[buckets[at : at + CHUNK + max(WIDTHS) - 1]].sum(1)
            for k, w in enumerate(WIDTHS):
                n = len(x) - w + 1
                if n <= 0:
                    continue
                part = self.filters[k]
                y = x[:n] @ part[:DIM]
                for i in range(1, w):
                    y += x[i : i + n] @ part[i * DIM : (i + 1) * DIM]
                top = y.argmax(0)
                value = y[top, np.arange(FILTERS)] + self.offsets[k]
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                better = value > best[s]
                best[s] = np.where(better, value, best[s])
                where[s] = np.where(better, top + at, where[s])
        return best, where

    def logit(self, buckets: np.ndarray) -> float:
        return float(self.pooled(buckets)[0] @ self.out + self.bias[0])

    def step(self, buckets: np.ndarray, y: int, rate: float, weight: float) -> None:
        """One row's gradient step, with a rate for each parameter that falls with its past gradients."""
        best, where = self.pooled(buckets)
        error = np.float32(weight * (1 / (1 + np.exp(-np.clip(best @ self.out + self.bias[0], -30, 30))) - y))
        back = error * self.out
        self._move("out", slice(None), error * best, rate)
        self._move("bias", slice(None), np.array([error]), rate)
        for k, w in enumerate(WIDTHS):
            at, g = where[k * FILTERS : (k + 1) * FILTERS], back[k * FILTERS : (k + 1) * FILTERS]
            fired = np.flatnonzero(at >= 0)
            if not len(fired):
                continue
            windows = buckets[at[fired, None] + np.arange(w)]  # filters x words x buckets
            x = self.embed[windows].sum(2).reshape(len(fired), -1)
            grad = (g[fired, None] * self.filters[k][:, fired].T).reshape(len(fired), w, 1, DIM)
            self._move("filters", (slice(None), fired), (g[fired, None] * x).T, rate, k)
            self._move("offsets", fired, g[fired], rate, k)
            flat, back_to = np.unique(windows, return_inverse=True)
            total = np.zeros((len(flat), DIM), np.float32)
            np.add.at(total, back_to.ravel(), np.broadcast_to(grad, (*windows.shape, DIM)).reshape(-1, DIM))
            self._move("embed", flat, total, rate)

    def _move(self, name: str, at, grad: np.ndarray, rate: float, k: int | None = None) -> None:
        value, past = getattr(self, name), self.past[name]
        if k is not None:
            value, past = value[k], past[k]
        past[at] += grad * grad
        value[at] -= rate * grad / np.sqrt(past[at])

    def shifted(self, logit: float, lang: str) -> float:
        if not self.trained:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(logit - self.thresholds.get(lang, self.threshold), -40, 40))))


class Scorer(dict):
    """Logits of texts: what each word adds to each place of each filter is computed once a word.

    A window's value is then a sum of w rows. At most WORDS words are remembered.
    """

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model
        self.parts = np.concatenate([f[i * DIM : (i + 1) * DIM] for f, w in zip(model.filters, WIDTHS, strict=True) for i in range(w)], axis=1)
        self.rows = np.zeros((1 << 12, self.parts.shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self))
        if len(self) + len(new) > WORDS:
            self.clear()
            new = list(words)
        if not new:
            return
        n = len(self)
        if n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:n], np.zeros((max(n, len(new)) * 2, self.rows.shape[1]), np.float32)])
        self.rows[n : n + len(new)] = self.model.embed[np.array([buckets_of(w) for w in new], np.int32)].sum(1) @ self.parts
        self.update(zip(new, range(n, n + len(new)), strict=True))

    def logits(self, texts: list[str]) -> list[float]:
        split = [t.lower().split() for t in texts]
        self.learn(set().union(*split))
        return [self.logit(np.fromiter(map(self.__getitem__, words), np.int64, len(words))) for words in split]

    def logit(self, at: np.ndarray) -> float:
        best = np.zeros(len(self.model.out), np.float32)
        for begin in range(0, len(at), CHUNK):
            x = self.rows[at[begin : begin + CHUNK + max(WIDTHS) - 1]]
            column = 0
            for k, w in enumerate(WIDTHS):
                n = len(x) - w + 1
                if n > 0:
                    y = x[:n, column : column + FILTERS]
                    for i in range(1, w):
                        y = y + x[i : i + n, column + i * FILTERS : column + (i + 1) * FILTERS]
                    s = slice(k * FILTERS, (k + 1) * FILTERS)
                    best[s] = np.maximum(best[s], y.max(0) + self.model.offsets[k])
                column += w * FILTERS
        return float(best @ self.model.out + self.model.bias[0])


def best_threshold(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit between two neighbouring rows at which the least weight is wrong; the widest gap among equals."""
    order = np.argsort(logits)
    s, toxic, clean = logits[order], (weight * y)[order], (weight * (1 - y))[order]
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + (clean.sum() - np.concatenate([[0], np.cumsum(clean)]))
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    gaps = edges[1:] - edges[:-1]
    wrong = np.where(gaps > 0, wrong, np.inf)  # equal logits can't be told apart
    k = max(np.flatnonzero(wrong <= wrong.min() + 1e-9), key=lambda i: gaps[i])
    return float((edges[k] + edges[k + 1]) / 2)


def train(texts: list[str], y: list[int], langs: list[str], all_rows: tuple[int, int] | None = None, *, epochs: int = 5, rate: float = 0.05, seed: int = 11) -> ToxicityModel:
    """all_rows: how many rows of label 0 and 1 the sample stands for."""
    model, buckets, y = ToxicityModel(seed), WordBuckets(), np.array(y)
    if not len(y) or y.min() == y.max():
        return model
    rows = [buckets.of(t) for t in texts]
    apart = np.arange(len(y)) % 5 == 0 if len(y) >= 100 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~apart)
    # the first dimension of a bucket starts at the log odds of the documents that hold it
    seen = np.ones((2, BUCKETS))
    for i in fit:
        seen[y[i]][np.unique(rows[i])] += 1
    n = np.bincount(y[fit], minlength=2) + 1
    model.embed[:, 0] = np.clip(np.log(seen[1] / n[1]) - np.log(seen[0] / n[0]), -4, 4) / 4
    for part in model.filters:
        part[::DIM, : FILTERS // 2] = np.abs(part[::DIM, : FILTERS // 2]) + 0.5
    model.out[:] = np.abs(model.out)
    weight = {0: 1.0, 1: min(5.0, n[0] / n[1])}
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in rng.permutation(fit):
            model.step(rows[i], int(y[i]), rate / (1 + epoch / 2), weight[int(y[i])])
    model.trained, model.past, model.fitted = True, {}, fit.tolist()
    held = np.flatnonzero(apart) if apart.any() else fit
    logits, names = np.array([model.logit(rows[i]) for i in held]), np.array([langs[i] for i in held])
    stands_for = np.array(all_rows or (1, 1)) / (np.bincount(y, minlength=2) if all_rows else 1)
    set_thresholds(model, logits, y[held], names, stands_for[y[held]])
    return model


def set_thresholds(model: ToxicityModel, logits: np.ndarray, y: np.ndarray, names: np.ndarray, each: np.ndarray, rows: np.ndarray | None = None) -> None:
    """The common threshold and that of each language; each is the weight of an entry, which is one row unless rows says how many."""
    model.threshold, model.thresholds = best_threshold(logits, y, each), {}
    each = each / (each.sum() / (len(each) if rows is None else rows.sum()))
    for lang in sorted(set(map(str, names))):
        # all rows together count as COMMON rows of the language, so its threshold leaves the common one as its own rows speak against it
        model.thresholds[lang] = best_threshold(logits, y, each * (names == lang) + COMMON * each / each.sum())


def fit(docs: DataFrame, labels: DataFrame, languages: language.LanguageModel, *, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on a bounded sample of labels (doc_id, toxic) and the texts of docs; calibrate() then sets thresholds by all other labels."""
    known = known_labels(labels, label_col)
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, language.share(total.get(1, 0), per_label)).otherwise(language.share(total.get(0, 0), per_label))
    chosen = F.broadcast(known.filter(language.unit_hash("doc_id") < share))  # about per_label ids of each label
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).join(chosen, "doc_id")
    got = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("doc_id").collect()
    model = train([r["text"] for r in got], [r["y"] for r in got], [languages.predict(r["text"])[0] for r in got], (total.get(0, 0), total.get(1, 0)))
    model.fitted = [got[i]["doc_id"] for i in model.fitted]
    return model


def known_labels(labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """(doc_id, y), one row an id."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def logits(docs: DataFrame, model: ToxicityModel, languages: language.LanguageModel, keep: list[str] = (), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *keep, logit, seen) of every whole text: seen is the language that the text shows; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model, languages))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, whole_text(text_col).alias("text_"))
    schema = rows.drop("text_").schema.add("logit", "double").add("seen", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, langs = shared.value
        scorer = Scorer(own)
        for batch in text_rows(batches):
            texts = batch.column("text_").to_pylist()
            rest = batch.drop_columns(["text_"])
            seen = [langs.predict(t)[0] if own.trained else "" for t in texts]
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(scorer.logits(texts), pa.float64()), pa.array(seen, pa.string())], [*rest.schema.names, "logit", "seen"])

    return rows.mapInArrow(run, schema)


def calibrate(scored: DataFrame, labels: DataFrame, model: ToxicityModel, *, label_col: str = "toxic") -> None:
    """Sets the model's thresholds by all labelled rows of scored (doc_id, logit, seen), except those that it was fitted on.

    Rows are counted in cells of 1 / CELLS of a logit. A cut lies between two cells, so the errors of each cut are those of all
    rows; what reaches the driver are cells, of which a language has about 80 x CELLS at most. Rows of a label weigh so much that
    they stand for all of the label. Nothing changes if there are no such rows of both labels.
    """
    if not model.trained:
        return
    known = known_labels(labels, label_col)
    fitted = scored.sparkSession.createDataFrame([(i,) for i in model.fitted], "doc_id long")
    one = scored.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("logit", "seen")).alias("s"))
    held = one.join(F.broadcast(fitted), "doc_id", "left_anti").withColumn("cell", F.floor(F.greatest(F.least("s.logit", F.lit(40.0)), F.lit(-40.0)) * CELLS))
    cells = held.groupBy(F.col("s.seen").alias("seen"), "cell", "y").agg(F.count("*").alias("n")).orderBy("seen", "cell", "y").toArrow()
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    y, n = cells["y"].to_numpy(), cells["n"].to_numpy()
    rows = np.bincount(y, n, 2)
    if rows.min() > 0:
        stands_for = np.array([total[0], total[1]]) / rows
        set_thresholds(model, (cells["cell"].to_numpy() + 0.5) / CELLS, y, np.array(cells["seen"].to_pylist()), n * stands_for[y], n)


def shifted_scores(scored: DataFrame, model: ToxicityModel) -> DataFrame:
    """scored with score and predicted for logit and seen, by the model's thresholds."""
    at = F.lit(model.threshold)
    if model.thresholds:
        at = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair)), F.col("seen")), at)
    z = F.greatest(F.least(F.col("logit") - at, F.lit(40.0)), F.lit(-40.0))
    score = 1 / (1 + F.exp(-z)) if model.trained else F.lit(0.0)
    return scored.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, model: ToxicityModel, languages: language.LanguageModel, keep: list[str] = (), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *keep, score, predicted) of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model, languages))  # bounded by BUCKETS, FEATURES and the languages
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, whole_text(text_col).alias("text_"))
    schema = rows.drop("text_").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, langs = shared.value
        scorer = Scorer(own)
        for batch in text_rows(batches):
            texts = batch.column("text_").to_pylist()
            got = [own.shifted(z, langs.predict(t)[0] if own.thresholds else "") for z, t in zip(scorer.logits(texts), texts, strict=True)]
            rest = batch.drop_columns(["text_"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], [*rest.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, schema)
