"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and rereads
it. All but the last return the columns of documents; further columns go. A null text counts as the empty text, which the
first stage drops since it has no letter. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genmeta.llm import byte_bpe, decontaminate, language, near_dup, pii
from genmeta.llm.common import fold, read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if its language can't be told: no letter, or a probability below this.
SURE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language can't be told; sets lang to the predicted language where it is null."""
    model = language.fit(docs.filter(fold(5) != 0))
    scored = language.predict(docs.withColumn("text0", F.col("text")), model, ["text0", "lang", "source", "n_chars"])
    kept = scored.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE))
    return kept.select("doc_id", F.col("text0").alias("text"), F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class, that with the smallest doc_id; rows are told apart by id and text. Rows with a null doc_id or without words stay."""
    return near_dup.representatives(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; each row is judged by its own text. An empty benchmark drops nothing."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by marks and counts characters anew; keeps every document."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def byte_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    return byte_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("byte BPE", byte_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [lambda docs, name=name, f=f: written(f(spark, docs, sf_dir), name.replace(" ", "-")) for name, f in STAGES]
    return reduce(lambda docs, step: step(docs), steps, read(spark, sf_dir, "documents"))
