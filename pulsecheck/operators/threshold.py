"""What other probability thresholds would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecheck.config import CURRENT
from pulsecheck.functions.expressions import count_where, safe_div
from pulsecheck.functions.ordering import locate

# 0.10, 0.15, ..., 0.90.
THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(17)]
F1_GAIN = 0.03


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1, fp, fn) of the current rows. No row for a single class.

    One scan counts rows by the number of thresholds they reach: 18 groups. The sweep sums those.
    """
    edges = F.array(*[F.lit(t) for t in THRESHOLDS])
    rows = scored.where(F.col("period") == CURRENT).select("y_true", F.nanvl(F.col("proba").cast("double"), F.lit(None)).alias("proba"))
    rows = rows.where(F.col("proba").isNotNull())
    reached = (
        locate(rows, F.col("proba"), edges, len(THRESHOLDS), "reached")
        .groupBy("reached")
        .agg(count_where(F.col("y_true") == 1).alias("pos"), count_where(F.col("y_true") != 1).alias("neg"))
    )
    return swept(reached)


def swept(reached: DataFrame) -> DataFrame:
    """The sweep from (reached, pos, neg): rows by the number of thresholds they reach."""
    edges = F.array(*[F.lit(t) for t in THRESHOLDS])
    above = F.col("reached") > F.col("step")
    counts = reached.select("*", F.posexplode(edges).alias("step", "threshold")).groupBy("threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.where((F.col("positives") > 0) & (F.col("negatives") > 0)).select(
        "threshold",
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "fp",
        "fn",
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest F1; the lowest threshold on ties."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def threshold_improvement(sweep: DataFrame, threshold: float = 0.50) -> DataFrame:
    """One row: best threshold, the one nearest the current setting, the F1 gain and its priority."""
    distance = F.struct(F.abs(F.col("threshold") - F.lit(threshold)).alias("d"), "threshold")
    found = sweep.agg(
        F.count("*").alias("__n"),
        F.max_by(F.struct("threshold", "f1"), F.struct("f1", (-F.col("threshold")).alias("t"))).alias("best"),
        F.min_by(F.struct("threshold", "f1"), distance).alias("near"),
    ).where(F.col("__n") > 0)
    gain = F.col("best.f1") - F.col("near.f1")
    return found.select(
        F.col("best.threshold").alias("best_threshold"),
        F.col("best.f1").alias("best_f1"),
        F.col("near.threshold").alias("nearest_threshold"),
        F.col("near.f1").alias("nearest_f1"),
        gain.alias("improvement"),
        F.when(gain >= F1_GAIN, "short_term").otherwise("monitor").alias("priority"),
    )
