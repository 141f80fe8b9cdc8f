"""Data quality of current against reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecheck.config import DANGER, MISSING_DANGER, MISSING_WARNING, STABLE, WARNING
from pulsecheck.functions.expressions import is_numeric
from pulsecheck.functions.literal import local_table
from pulsecheck.operators.frequency import approximate_stats, cell_stats, column_stats
from pulsecheck.sources.pairs import Pair

TYPES = "column string, position int, ref_type string, cur_type string, is_text boolean"


def column_types(pair: Pair) -> DataFrame:
    """One row per column of either side; the type is null where the side lacks the column."""
    rows = []
    for position, name in enumerate(pair.columns):
        ref, cur = pair.reference_types.get(name), pair.current_types.get(name)
        rows.append(
            (
                name,
                position,
                ref.simpleString() if ref else None,
                cur.simpleString() if cur else None,
                bool(ref) and not is_numeric(ref),
            )
        )
    return local_table(pair.rows.sparkSession, rows, TYPES)


def _rate(count: str, rows: str, kind: str) -> Column:
    known = F.col(kind).isNotNull() & (F.col(rows) > 0)
    return F.when(known, F.col(count).cast("double") / F.col(rows).cast("double"))


def quality_table(pair: Pair, target: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """One row per column in union order: types, missing rates, distinct values, status and reason. `stats`: `column_stats` of the
    pair, if they are at hand."""
    facts = column_types(pair).join(F.broadcast(stats or column_stats(pair)), "column", "left")
    both = F.col("ref_type").isNotNull() & F.col("cur_type").isNotNull()
    few = F.least(
        F.lit(100), F.greatest(F.lit(20), F.floor(F.col("ref_rows").cast("double") * F.lit(0.20)).cast("long"))
    )
    counted = both & F.col("is_text") & (F.col("ref_distinct") <= few)
    table = facts.select(
        "position",
        "column",
        "ref_type",
        "cur_type",
        _rate("ref_missing", "ref_rows", "ref_type").alias("ref_missing_rate"),
        _rate("cur_missing", "cur_rows", "cur_type").alias("cur_missing_rate"),
        F.when(F.col("ref_type").isNotNull(), F.coalesce("ref_distinct", F.lit(0))).otherwise(0).cast("long").alias("ref_distinct"),
        F.when(F.col("cur_type").isNotNull(), F.coalesce("cur_distinct", F.lit(0))).otherwise(0).cast("long").alias("cur_distinct"),
        F.when(counted, F.col("new_values")).otherwise(0).cast("long").alias("new_categories"),
    ).withColumn(
        "missing_delta",
        F.when(F.col("ref_type").isNotNull() & F.col("cur_type").isNotNull(), F.col("cur_missing_rate") - F.col("ref_missing_rate")),
    )
    reason = (
        F.when(F.col("ref_type").isNull() | F.col("cur_type").isNull(), "one_sided")
        .when(F.col("ref_type") != F.col("cur_type"), "type_changed")
        .when(F.col("missing_delta") >= MISSING_DANGER, "missing_up_10_points")
        .when((F.col("new_categories") > 0) | (F.col("missing_delta") >= MISSING_WARNING), "new_category_or_missing_up")
        .otherwise("none")
    )
    status = (
        F.when(F.col("reason").isin("one_sided", "type_changed", "missing_up_10_points"), DANGER)
        .when(F.col("reason") == "new_category_or_missing_up", WARNING)
        .otherwise(STABLE)
    )
    return (
        table.withColumn("reason", reason)
        .withColumn("status", status)
        .withColumn("is_target", F.col("column") == F.lit(target) if target else F.lit(False))
        .orderBy("position")
    )


def missing_rates(pair: Pair) -> DataFrame:
    facts = column_types(pair).join(F.broadcast(cell_stats(pair)), "column", "left")
    rates = facts.select(
        "position",
        "column",
        _rate("ref_missing", "ref_rows", "ref_type").alias("ref_missing_rate"),
        _rate("cur_missing", "cur_rows", "cur_type").alias("cur_missing_rate"),
    )
    delta = (F.col("cur_missing_rate") - F.col("ref_missing_rate")).alias("missing_delta")
    return rates.orderBy("position").select("column", "ref_missing_rate", "cur_missing_rate", delta)


def distinct_counts(pair: Pair, approximate: float | None = None) -> DataFrame:
    """Exact by default; `approximate` is the relative error of a mergeable sketch, which shuffles no value."""
    if approximate is not None:
        return approximate_stats(pair, None, approximate).select("column", "ref_distinct", "cur_distinct")
    return quality_table(pair).select("column", "ref_distinct", "cur_distinct")


def type_changes(pair: Pair) -> DataFrame:
    """Columns of both sides, with their cells per side and whether the type differs."""
    stats = cell_stats(pair, pair.shared).select("column", "ref_rows", "cur_rows")
    types = column_types(pair).where(F.col("ref_type").isNotNull() & F.col("cur_type").isNotNull())
    return types.join(F.broadcast(stats), "column").select(
        "column", "ref_type", "cur_type", (F.col("ref_type") != F.col("cur_type")).alias("type_changed"), "ref_rows", "cur_rows"
    )


def one_sided_columns(pair: Pair) -> DataFrame:
    """Columns that only one side has, with the number of values they hold there."""
    stats = cell_stats(pair).select(
        "column", (F.col("ref_rows") + F.col("cur_rows") - F.col("ref_missing") - F.col("cur_missing")).alias("n_values")
    )
    types = column_types(pair).where(F.col("ref_type").isNull() | F.col("cur_type").isNull())
    side = F.when(F.col("cur_type").isNull(), "reference").otherwise("current")
    return types.join(F.broadcast(stats), "column").select("column", side.alias("present_in"), "n_values")


def new_categories(pair: Pair) -> DataFrame:
    return quality_table(pair).select("column", "new_categories")


def quality_status(pair: Pair) -> DataFrame:
    return quality_table(pair).select("column", "status", "reason")
