"""Slots for the categories of model features, numbered in the order of their text, without a list of them on the driver.

The distinct values are counted once and written. Each is numbered by its place in a range of texts and the values of the ranges
before. A column of few values goes to the executors as a list; the values of a larger one are joined: the most frequent
ones by a small broadcast, and the rest by a shuffle in which rows that have found their slot, or have none, are dealt by salt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsecheck.config import PERIOD, REFERENCE
from pulsecheck.functions.literal import literal_table, local_table
from pulsecheck.functions.ordering import locate, partition_count
from pulsecheck.operators.frequency import category_counts
from pulsecheck.sources.pairs import pair_from
from pulsecheck.sources.shared import settle

#: Values of a column, and bytes of all of them, up to which they are listed; the frequent values of a larger column that are
#: broadcast, and their bytes.
LISTED, LISTED_BYTES, FREQUENT, FREQUENT_BYTES = 10_000, 1 << 20, 1_000, 1 << 20
#: Values of one range of texts, and characters of a point that cuts them.
IN_RANGE, POINT = 100_000, 64


@dataclass
class CategoryIndex:
    columns: list[str]
    table: DataFrame  # column, value, n, slot
    sizes: list[int]
    listed: dict[int, list[str]]

    def encoder(self, spark) -> OneHotEncoderModel:
        """As many places as a column has values; the slot behind the last has none. It is fitted on the numbers of values alone."""
        names = [f"cat_{i}" for i in range(len(self.columns))]
        last = local_table(spark, [tuple(float(n) for n in self.sizes)], ", ".join(f"{n}_index double" for n in names))
        return OneHotEncoder(inputCols=[f"{n}_index" for n in names], outputCols=[f"{n}_onehot" for n in names], dropLast=True).fit(last)

    def with_slots(self, df: DataFrame) -> DataFrame:
        """Adds `cat_<i>_index` for each text in `cat_<i>`."""
        out = df
        for i, labels in self.listed.items():
            # A value that is not known has the slot behind the last. One model a column: lists of one model have one length.
            out = StringIndexerModel.from_labels(labels, f"cat_{i}", f"cat_{i}_index", "keep").transform(out)
        # Without the names of the values, which the encoder would take for names of places.
        out = out.withColumns({f"cat_{k}_index": F.col(f"cat_{k}_index") + F.lit(0.0) for k in self.listed})
        for i in range(len(self.columns)):
            if i not in self.listed:
                out = self._joined(out, i)
        return out

    def _joined(self, df: DataFrame, i: int) -> DataFrame:
        own = self.table.where(F.col("column") == self.columns[i]).select(F.col("value").alias("__value"), F.col("slot").cast("double").alias("__slot"), "n")
        first = own.orderBy(F.desc("n"), "__value").limit(FREQUENT).withColumn("__bytes", F.sum(F.octet_length("__value") + 8).over(Window.orderBy(F.desc("n"), "__value")))
        frequent = literal_table(first.where(F.col("__bytes") <= FREQUENT_BYTES).select("__value", F.col("__slot").alias("__first")))
        text = F.col(f"cat_{i}")
        # FREQUENT rows and FREQUENT_BYTES bytes at most.
        met = df.join(F.broadcast(frequent), text == F.col("__value"), "left").drop("__value")
        parts = partition_count(df)
        done = F.col("__first").isNotNull()
        salt = F.when(done, 1 + F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c.startswith("cat_") or c.startswith("num_")]), F.lit(parts))).otherwise(0)
        rest = own.select("__value", "__slot", F.lit(0).cast("long").alias("__salt"))
        met = met.withColumns({"__salt": salt.cast("long"), "__key": F.when(~done, text)})
        found = met.join(rest, (F.col("__key") == F.col("__value")) & (met["__salt"] == rest["__salt"]), "left")
        return found.select(*df.columns, F.coalesce("__first", "__slot", F.lit(float(self.sizes[i]))).alias(f"cat_{i}_index"))


def category_index(train: DataFrame, columns: Sequence[str]) -> CategoryIndex:
    """The values that `train` has in `columns`, numbered from 0 in the order of their text."""
    spark, columns = train.sparkSession, list(columns)
    pair = pair_from(train.withColumn(PERIOD, F.lit(REFERENCE)), columns)
    counts = category_counts(pair, columns, labelled=False).where("value IS NOT NULL")
    values = settle(counts.select("column", "value", F.col("n_ref").alias("n")), "category-values")
    facts = {r["column"]: r for r in values.groupBy("column").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes")).collect()}
    table = settle(_numbered(values, {c: facts[c]["n"] for c in facts}), "category-slots")
    few = [c for c in facts if facts[c]["n"] <= LISTED and facts[c]["bytes"] <= LISTED_BYTES]
    labels: dict[str, list[str]] = {c: [] for c in few}
    for row in table.where(F.col("column").isin(*few)).select("column", "value", "slot").orderBy("column", "slot").collect() if few else []:
        labels[row["column"]].append(row["value"])
    sizes = [facts[c]["n"] if c in facts else 0 for c in columns]
    return CategoryIndex(columns, table, sizes, {i: labels[c] for i, c in enumerate(columns) if c in labels})


def _numbered(values: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Adds `slot`: ranges of texts, the place in the range, and the values of the ranges before."""
    points = []
    for column, size in sizes.items():
        ranges = -(-size // IN_RANGE)
        if ranges > 1:
            # the text with the least hash in each bucket of hashes: texts at random, which only balance the ranges
            bucket, text = F.pmod(F.xxhash64("value"), F.lit(ranges - 1)), F.substring("value", 1, POINT)
            drawn = values.where(F.col("column") == column).groupBy(bucket).agg(F.min_by(text, F.xxhash64(F.lit("point"), F.col("value"))).alias("point"))
            points.append((column, sorted({r["point"] for r in drawn.collect()})))
    located = values.withColumn("range_id", F.lit(0))
    if points:
        table = local_table(values.sparkSession, points, "column string, points array<string>")
        longest = max(len(p) for _, p in points)
        joined = values.join(F.broadcast(table), "column", "left")  # POINT characters for IN_RANGE values
        located = locate(joined, F.col("value"), F.coalesce("points", F.array().cast("array<string>")), longest, "range_id").drop("points")
    in_order = Window.partitionBy("column").orderBy("range_id")
    before = located.groupBy("column", "range_id").agg(F.count("*").alias("in_range"))
    before = before.select("column", "range_id", (F.sum("in_range").over(in_order) - F.col("in_range")).alias("before"))
    place = F.row_number().over(Window.partitionBy("column", "range_id").orderBy("value"))
    # One row a range of IN_RANGE values.
    return located.withColumn("place", place).join(F.broadcast(before), ["column", "range_id"]).select("column", "value", "n", (F.col("before") + F.col("place") - 1).alias("slot"))
