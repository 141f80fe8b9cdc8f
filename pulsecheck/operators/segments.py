"""Groups of rows on which the model does clearly worse than overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecheck.config import (
    DANGER,
    INSUFFICIENT,
    MAX_SEGMENT_GROUPS,
    MIN_SEGMENT_CLASS_ROWS,
    MIN_SEGMENT_ROWS,
    STABLE,
    WARNING,
)
from pulsecheck.functions.expressions import as_category
from pulsecheck.functions.literal import literal_table, local_table
from pulsecheck.operators.frequency import category_counts
from pulsecheck.operators.performance import binary_ratios, confusion_aggregates, label_cells, macro_metrics
from pulsecheck.sources.pairs import Pair

KEYS = ("period", "segment_column", "segment_group")
ALL = "(all)"


def segment_columns(pair: Pair, categorical: Sequence[str]) -> DataFrame:
    """(period, segment_column, n_groups, kept): distinct values incl. missing, judged per period."""
    counts = category_counts(pair, categorical)
    seen = counts.groupBy("column").agg(
        F.sum((F.col("n_ref") > 0).cast("long")).alias("reference"), F.sum((F.col("n_cur") > 0).cast("long")).alias("current")
    )
    long = seen.unpivot(["column"], ["reference", "current"], "period", "n_groups")
    return long.where(F.col("n_groups") > 0).select(
        "period", F.col("column").alias("segment_column"), "n_groups", (F.col("n_groups") <= MAX_SEGMENT_GROUPS).alias("kept")
    )


def segment_rows(scored: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per row and kept column, plus one under the group `(all)` for the period's overall
    figures, so that one scan serves groups and overall alike. `kept` is (period, segment_column)."""
    names = sorted({r["segment_column"] for r in kept.select("segment_column").distinct().collect()})
    parts = [F.lit(ALL), F.lit(ALL)]
    for name in names:
        parts += [F.lit(name), as_category(scored, name)]
    long = scored.select(
        "period", "y_true", "y_pred", F.stack(F.lit(len(names) + 1), *parts).alias("segment_column", "segment_group")
    )
    wanted = kept.select("period", "segment_column")
    everywhere = wanted.select("period").distinct().withColumn("segment_column", F.lit(ALL))
    # 2 x #columns rows
    return long.join(F.broadcast(wanted.union(everywhere)), ["period", "segment_column"], "left_semi")


def _against_overall(groups: DataFrame, overall: dict[str, str]) -> DataFrame:
    """Join each group with the `(all)` row of its period; `overall` maps a figure to its new name."""
    groups = literal_table(groups)  # at most 2 x (#columns x 30 + 1) rows, from one scan
    total = groups.where(F.col("segment_column") == ALL).select("period", *[F.col(c).alias(n) for c, n in overall.items()])
    return groups.where(F.col("segment_column") != ALL).join(F.broadcast(total), "period")


def _verdict(too_few: Column, danger: Column, warning: Column) -> Column:
    return F.when(too_few, INSUFFICIENT).when(danger, DANGER).when(warning, WARNING).otherwise(STABLE)


def segments_binary(rows: DataFrame, min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    return judged_binary(rows.groupBy(*KEYS).agg(*confusion_aggregates()), min_rows)


def judged_binary(groups: DataFrame, min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """From the confusion counts of every group and of `(all)`."""
    figures = groups.select(
        *KEYS, "n", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"), *binary_ratios()
    )
    joined = (
        _against_overall(figures, {"recall": "__recall", "fpr": "__fpr"})
        .withColumn("recall_gap", F.col("recall") - F.col("__recall"))
        .withColumn("fpr_gap", F.col("fpr") - F.col("__fpr"))
    )
    few = (
        (F.col("n") < min_rows)
        | (F.col("positives") < MIN_SEGMENT_CLASS_ROWS)
        | (F.col("negatives") < MIN_SEGMENT_CLASS_ROWS)
    )
    danger = (F.col("recall_gap") <= -0.20) | (F.col("fpr_gap") >= 0.20)
    warning = (F.col("recall_gap") <= -0.10) | (F.col("fpr_gap") >= 0.10)
    return joined.drop("__recall", "__fpr").withColumn("status", _verdict(few, danger, warning))


def segments_multiclass(rows: DataFrame, min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    figures = macro_metrics(label_cells(rows, KEYS), KEYS).select(*KEYS, "n", "accuracy", "macro_f1")
    joined = _against_overall(figures, {"macro_f1": "__f1"}).withColumn("macro_f1_gap", F.col("macro_f1") - F.col("__f1"))
    gap = F.col("macro_f1_gap")
    return joined.drop("__f1").withColumn("status", _verdict(F.col("n") < min_rows, gap <= -0.20, gap <= -0.10))


def segments_regression(rows: DataFrame, min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    figures = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")
    )
    joined = _against_overall(figures, {"mae": "__mae"}).withColumn(
        "mae_ratio", F.col("mae") / F.greatest(F.col("__mae"), F.lit(1e-9))
    )
    ratio = F.col("mae_ratio")
    return joined.drop("__mae").withColumn("status", _verdict(F.col("n") < min_rows, ratio >= 1.5, ratio >= 1.25))


def weak_segments(scored: DataFrame, pair: Pair, categorical: Sequence[str], kind: str, min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """All groups of all kept columns in both periods.

    `pair` decides which columns are kept; it holds the same rows as `scored`. The result has at most
    2 x #columns x 30 rows.
    """
    kept = segment_columns(pair, categorical).where("kept").select("period", "segment_column").collect()  # a row a column
    return judged_segments(scored, [tuple(r) for r in kept], kind, min_rows)


def judged_segments(scored: DataFrame, kept: Sequence[tuple[str, str]], kind: str, min_rows: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """`kept`: the (period, column) whose groups are judged."""
    build = {"binary": segments_binary, "multiclass": segments_multiclass, "regression": segments_regression}[kind]
    return build(segment_rows(scored, local_table(scored.sparkSession, sorted(kept), "period string, segment_column string")), min_rows)
