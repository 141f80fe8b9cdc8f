"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecheck.llm import language, quality, toxicity
from pulsecheck.llm.alignment import aligned
from pulsecheck.llm.common import table
from pulsecheck.llm.decontaminate import contamination
from pulsecheck.llm.extraction import main_text
from pulsecheck.llm.licenses import license_scan
from pulsecheck.llm.negatives import hard_negatives
from pulsecheck.llm.neighbours import nearest
from pulsecheck.llm.oracle import ORACLE  # noqa: F401
from pulsecheck.llm.packing import pack
from pulsecheck.llm.samples import remainder
from pulsecheck.llm.secrets import secret_scan
from pulsecheck.llm.simhash import near_duplicates
from pulsecheck.llm.tokens import token_counts


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _held_out() -> Column:
    return F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    evidence, passage, beta = toxicity.train(docs, labels)
    return toxicity.toxicity(docs, evidence, passage, beta).withColumn("held_out", _held_out()).select("doc_id", "held_out", "score", "predicted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights, change = quality.train(docs, labels)
    return quality.quality(docs, weights, change).withColumn("held_out", _held_out()).select("doc_id", "held_out", "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, net = language.train(docs, learn="crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    return language.identify(docs, names, net).withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_token_counts": op9_token_counts,
    "op10_neighbours": op10_neighbours,
    "op11_main_text": op11_main_text,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}
