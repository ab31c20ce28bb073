"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, decontaminate, language, license_scan, lm_score, merkle, near_dup, oracles, piece_bpe, pii, token_store, toxicity, whitening
from .common import fold, read, whole_text, written

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(read(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID)
    return token_store.document_digests(spark, path)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(read(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    languages = language.fit(docs.filter(fold(5) != 0))
    labels = read(spark, sf_dir, "labels").filter(fold(5) != 0)
    model = toxicity.fit(docs, labels, languages)
    scored = written(toxicity.logits(docs.withColumn("held_out", fold(5) == 0), model, languages, ["held_out"]), "logits")
    toxicity.calibrate(scored, labels, model)
    return toxicity.shifted_scores(scored, model).select("doc_id", "held_out", "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold(5) != 0))
    return language.predict(docs.withColumn("held_out", fold(5) == 0), model, ["held_out"]).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op3_pii": op3_pii,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op9_language": op9_language,
}
ORACLES: dict[str, str] = {}


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.findings(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"))


QUERIES |= {"op7_decontamination": op7_decontamination, "op8_near_dup": op8_near_dup}


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(read(spark, sf_dir, "documents"))


QUERIES |= {"op4_lm_score": op4_lm_score}


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


QUERIES |= {"op10_nearest": op10_nearest}


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit(docs))


QUERIES |= {"op2_license_scan": op2_license_scan}


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), merkle.every_fifth())


QUERIES |= {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES |= {"op12_merkle_manifest": oracles.MERKLE}


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digests(read(spark, sf_dir, "documents"), PIECE_MODEL)


QUERIES |= {"op13_sentencepiece": op13_sentencepiece}


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


QUERIES |= {"op11_whitening": op11_whitening}
