"""Licence scans by a trained paragraph classifier.

A paragraph (a line; longer ones in overlapping windows) is a sparse vector of word uni- and bigrams. A multinomial logistic
regression, trained on the templates below with words dropped and embedded, against paragraphs of the corpus and near misses,
gives the licence family or ``unknown``; a temperature fitted on examples kept apart calibrates it. A prediction counts
only if the paragraph also holds at least CONFIRM of the bigrams of a template of that family.

The corpus part of the training set is bounded: at most NEGATIVES rows (smallest hashes of their id). Paragraphs without any
cue word of a template hold none of its telling bigrams, so they are ``unknown`` without scoring; the rest is scored whole.
Nulls: a null text is empty and has no licence. Rows that share an id stay rows. An empty table gives no rows, and a
model fitted on one has no negative examples of its own. Of each of the NEGATIVES texts the first four lines are negative examples,
and the first 20,000 words of all of them are filler. Very long lines are cut into windows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows, whole_text

FEATURES = 1 << 14
WINDOW, STEP = 64, 32
NEGATIVES = 400
CONFIRM = 0.6
UNKNOWN = "unknown"

#: Sentences that state or make up each licence family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "Released under the BSD License"],
    "CC-BY": ["Licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work", "dedicated to the public domain under CC0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU General Public License version 2"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
}
#: Sentences that speak of licences without granting one.
NEAR_MISSES = [
    "He obtained a driving license last year", "The license fee was paid under protest", "A new version of the plan was released", "Permission to build was granted by the city",
    "The foundation published a general report for the public", "All rights reserved", "The work was done under the supervision of the author", "Creative work is common in this school",
]
WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    grams = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}
    index = np.array(sorted({xxhash.xxh32_intdigest(g) % FEATURES for g in grams}), np.int64)
    return index, np.full(len(index), 1 / np.sqrt(max(len(index), 1)), np.float32)


def units(text: str) -> Iterator[list[str]]:
    for line in text.split("\n"):
        words = words_of(line)
        if len(words) <= WINDOW:
            if words:
                yield words
        else:
            for at in range(0, len(words) - STEP, STEP):
                yield words[at : at + WINDOW]


class LicenseModel:
    def __init__(self):
        self.families = [UNKNOWN, *TEMPLATES]
        self.weights = np.zeros((FEATURES, len(self.families)), np.float32)
        self.bias = np.zeros(len(self.families), np.float32)
        self.temperature = 1.0
        self.templates = {f: [bigrams(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()}
        self.cues = {w for ts in TEMPLATES.values() for t in ts for w in words_of(t) if len(w) > 2} - {"the", "and", "for", "with", "this", "that", "you", "not", "are", "all", "any", "has", "use", "may", "into", "person"}

    def logits(self, row: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return row[1] @ self.weights[row[0]] + self.bias

    def classify(self, words: list[str]) -> tuple[str, float]:
        if self.cues.isdisjoint(words):
            return UNKNOWN, 1.0
        z = self.logits(features(words)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        if k:
            own = bigrams(words)
            if not any(len(t & own) >= CONFIRM * len(t) for t in self.templates[self.families[k]]):
                return UNKNOWN, float(1 - p[k])
        return self.families[k], float(p[k])

    def scan(self, text: str) -> list[tuple[str, float, int]]:
        """(family, highest score, paragraphs) of each family found."""
        best: dict[str, tuple[float, int]] = {}
        for words in units(text):
            family, p = self.classify(words)
            if family != UNKNOWN:
                old = best.get(family, (0.0, 0))
                best[family] = (max(p, old[0]), old[1] + 1)
        return [(f, p, n) for f, (p, n) in sorted(best.items())]


def train(negatives: list[str], *, epochs: int = 12, rate: float = 0.5, seed: int = 4) -> LicenseModel:
    model, rng, examples = LicenseModel(), np.random.default_rng(seed), []
    filler = [w for t in negatives for u in units(t) for w in u][:20_000] or ["lorem", "ipsum"]
    pick = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]
    for k, family in enumerate(model.families[1:], 1):
        for template in TEMPLATES[family]:
            words = words_of(template)
            for _ in range(40):
                kept = [w for w in words if rng.random() > 0.05]
                examples.append((pick(rng.integers(0, 12)) + kept + pick(rng.integers(0, 12)) if rng.random() < 0.5 else kept, k))
    for text in negatives:
        examples += [(u, 0) for u in list(units(text))[:4]]
    for text in NEAR_MISSES:
        examples += [(words_of(text) + pick(rng.integers(0, 12)), 0) for _ in range(20)]
    rows = [(features(w), k) for w, k in examples if w]
    apart = np.arange(len(rows)) % 6 == 0
    for epoch in range(epochs):
        for i in rng.permutation(np.flatnonzero(~apart)):
            row, k = rows[i]
            z = model.logits(row)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            step = rate / (1 + 0.3 * epoch)
            model.weights[row[0]] -= step * row[1][:, None] * p
            model.bias -= 0.1 * step * p
    held = [(model.logits(rows[i][0]), rows[i][1]) for i in np.flatnonzero(apart)]
    loss = lambda t: sum(np.log(np.exp(z / t - (z / t).max()).sum()) + (z / t).max() - z[k] / t for z, k in held)
    model.temperature = float(min(np.geomspace(0.1, 5, 40), key=loss))
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(NEGATIVES)
    texts = [r["text"] for r in rows.join(F.broadcast(ids.distinct()), "doc_id").orderBy("doc_id", "text").collect()]
    plain = LicenseModel()
    free = ["\n".join(line for line in t.split("\n") if not any(len(x & bigrams(words_of(line))) >= 0.5 * len(x) for ts in plain.templates.values() for x in ts)) for t in texts]
    return train(free)


def scan(docs: DataFrame, model: LicenseModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, score, licences): the licence with the highest score (null if none), and all as family:paragraphs; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            found = [shared.value.scan(t) for t in batch.column("text").to_pylist()]
            top = [max(f, key=lambda x: (x[1], x[0]), default=(None, 0.0, 0)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t[0] for t in top], pa.string()), pa.array([t[1] for t in top], pa.float64()), pa.array([",".join(f"{a}:{n}" for a, _, n in f) for f in found], pa.string())], ["doc_id", "licence", "score", "licences"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, licence string, score double, licences string")
