"""Bounded samples of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo `divisor`; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % divisor


def by_class(rows: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """At most `n` rows of each label: those whose key has the smallest hash. One row of rows with one key and label.

    Only labels and hashes are ranked; the texts of the rows chosen are read after that.
    """
    hashed = F.xxhash64(F.col(f"`{key}`").cast("string"))
    named = rows.select(F.col(f"`{label}`").alias("label_"), hashed.alias("hash_"))
    nth = F.row_number().over(Window.partitionBy("label_").orderBy("hash_"))
    # Repeated keys count once; ranking keeps n of each label in each task before rows move.
    bars = named.distinct().withColumn("nth", nth).where(F.col("nth") <= n).groupBy("label_").agg(F.max("hash_").alias("bar_"))
    found = bars.collect()  # one row a label
    chosen = F.lit(False)
    for r in found:
        chosen = chosen | ((F.col(f"`{label}`") == F.lit(r["label_"])) & (hashed <= F.lit(r["bar_"])))
    return rows.where(chosen).withColumn("hash_", hashed).dropDuplicates([label, "hash_"]).drop("hash_")


#: A label table of up to so many rows (24 bytes each) is joined by a broadcast; of a larger one up to so many are looked up (8 bytes each).
SENT, MARKED = 1_000_000, 16_000_000


def moves(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> bool:
    """Whether `labelled` has to move texts to their labels."""
    kinds = {docs.schema[key].dataType, labels.schema[key].dataType}
    n = labels.count()
    return n > MARKED or n > SENT and not (len(kinds) == 1 and kinds <= {LongType(), IntegerType(), StringType()})


def _marked(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` with the labels of `known`, which has one row a key: what a join gives, but no row moves. Keys are told apart by 63 bits
    of their hash; the bit left is the label."""
    hashed = F.xxhash64(F.col("key").cast("string"))
    got = known.select(hashed.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("label").cast("long")).alias("mark")).toArrow()
    held = rows.sparkSession.sparkContext.broadcast(np.sort(got.column("mark").to_numpy()))

    @F.arrow_udf(IntegerType())
    def label_of(hashes: pa.Array) -> pa.Array:
        table, asked = held.value, hashes.to_numpy(zero_copy_only=False) & ~1
        near = table[np.minimum(np.searchsorted(table, asked), len(table) - 1)] if len(table) else ~asked
        return pa.array(np.where(near & ~1 == asked, near & 1, -1), pa.int32())

    return rows.where("key IS NOT NULL").withColumn("label", label_of(hashed)).where("label >= 0")


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, label (0 or 1) of the documents that have one. Several labels of one key count as the largest."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    if labels.count() <= SENT:
        return rows.join(F.broadcast(known), "key")
    return rows.join(known, "key") if moves(docs, labels, key) else _marked(rows, known)
