"""Documents to training sequences: the stages of a corpus pipeline, each by one of the operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; `run` writes every stage's
result as Parquet in the cluster's shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecheck.llm import language
from pulsecheck.llm.common import table
from pulsecheck.llm.decontaminate import clean_documents
from pulsecheck.llm.packing import pack
from pulsecheck.llm.secrets import redact
from pulsecheck.llm.simhash import one_of_each
from pulsecheck.sources.shared import settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of which the network takes more for noise than of any held-out text of a language.
    With fewer than two languages to learn there is nothing to tell apart: every document with a letter stays."""
    names, net = language.train(docs, learn="crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0", noise=True)
    if len(names) < 2:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return language.in_known_language(docs, language.spoken(docs, net))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the benchmark's windows go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret found is replaced in the text, and n_chars follows."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: The first stage is a trained network, which SQL can't express; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
