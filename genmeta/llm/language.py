"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned with follow-the-regularised-leader (per-coordinate rates, elastic-net penalties), so most of them are
exactly zero; a temperature fitted on rows kept apart calibrates the probabilities. The model is fitted on a sample of at
most PER_LANG different texts of each language (those with the smallest hashes) and about MOST_ROWS in all; every language
takes part. Scoring reads whole texts.

Nulls: a null or letterless text is ``und`` with score 0. Rows with a null language never train. If there is no row to learn
from, everything is ``und``; an empty table gives no rows. Rows that share an id are predicted one by one. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_rows, whole_text

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
PER_LANG = 600
MOST_ROWS = 60_000
CHUNK = 1 << 18
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the lower-cased text, a blank before and after; long texts in chunks."""
    total = np.zeros(FEATURES, np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text), CHUNK):
        code = np.frombuffer(text[at : at + CHUNK + max(ORDERS) - 1].encode("utf-32-le", "replace"), np.uint32)
        here = min(CHUNK, len(text) - at)
        h = np.zeros(len(code), np.uint32)
        for n in ORDERS:
            if n > len(code):
                break
            h = (h[: len(code) - n + 1] + code[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            total += np.bincount((h[:here] + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)) >> np.uint32(17), minlength=FEATURES)
    return total


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class LanguageModel:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    @staticmethod
    def features(index: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = (1 + np.log(tf)) * idf[index]
        return index, (value / max(np.sqrt(value @ value), 1e-12)).astype(np.float32)

    def probabilities(self, text: str) -> np.ndarray:
        tf = counts(text)
        index = np.flatnonzero(tf)
        index, value = self.features(index, tf[index], self.idf)
        z = (value @ self.weights[index]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(texts: list[str], langs: list[str], *, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5) -> LanguageModel:
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros(FEATURES, np.float32), np.zeros((FEATURES, 0), np.float32), 1.0)
    sparse, seen = [], np.zeros(FEATURES, np.int64)
    for text in texts:
        tf = counts(text)
        index = np.flatnonzero(tf)
        sparse.append((index.astype(np.int32), tf[index].astype(np.int32)))
        seen[index] += 1
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    rows = [LanguageModel.features(index, tf, idf) for index, tf in sparse]
    del sparse
    y = np.array([names.index(x) for x in langs])
    apart = np.arange(len(y)) % 8 == 0 if len(y) >= 40 else np.zeros(len(y), bool)
    z, n = np.zeros((FEATURES, len(names))), np.zeros((FEATURES, len(names)))

    def weights(index: np.ndarray) -> np.ndarray:
        zi, ni = z[index], n[index]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~apart)):
            index, value = rows[i]
            w = weights(index)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    model = LanguageModel(names, idf, weights(np.arange(FEATURES)).astype(np.float32), 1.0)
    if apart.any():
        scores = np.array([rows[i][1] @ model.weights[rows[i][0]] for i in np.flatnonzero(apart)])

        def loss(t: float) -> float:
            s = scores / t - (scores / t).max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[apart]]).mean()) + 1e-3 * np.log(t) ** 2

        model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    return model


def unit_hash(*cols: str) -> F.Column:
    """A hash of the columns, spread over [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def share(n: int, wanted: int) -> F.Column:
    """The share of n evenly spread hashes that holds about wanted of them, six deviations more."""
    return F.lit(min(1.0, (wanted + 6 * wanted**0.5 + 10) / max(n, 1)))


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most_rows: int = MOST_ROWS) -> LanguageModel:
    """Fits on a bounded sample: the per_lang texts with the smallest hashes of each language, fewer where all languages together have more than most_rows.

    One pass counts the different texts of each language, a second one fetches about as many as are wanted; equal texts of a
    language meet in partial aggregates, so copies neither fill the sample nor a task.
    """
    rows = docs.select(whole_text(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL").withColumn("h", unit_hash("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not sizes:
        return train([], [])
    wanted = max(1, min(per_lang, most_rows // len(sizes)))
    cuts = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.25 * (wanted + 6 * wanted**0.5 + 10) / max(r["n"], 1))) for r in sizes], "lang string, cut double")
    few = rows.join(F.broadcast(cuts), "lang").filter("h < cut").groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    got = few.withColumn("rank", rank).filter(F.col("rank") <= wanted).orderBy("h", "lang").select("text", "lang").collect()
    got = [r for r in got if has_letter(r["text"])]
    return train([r["text"] for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] = (), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *keep, lang_pred, score): the likeliest language of every whole text; no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES x languages floats
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, whole_text(text_col).alias("text_"))
    schema = rows.drop("text_").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            got = [shared.value.predict(t) for t in batch.column("text_").to_pylist()]
            rest = batch.drop_columns(["text_"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*rest.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
