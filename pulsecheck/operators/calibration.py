"""Reliability of predicted probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecheck.config import BRIER_RISE, CALIBRATION_BINS, CURRENT, REFERENCE
from pulsecheck.functions.ordering import locate


def calibration_curve(scored: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """(period, bin, n, mean_probability, positive_rate) over equal bins of [0, 1], closed on the right."""
    inner = F.array(*[F.lit(i * (1 / bins)) for i in range(1, bins)])
    rows = scored.select("period", "y_true", F.nanvl(F.col("proba").cast("double"), F.lit(None)).alias("proba")).where(F.col("proba").isNotNull())
    return (
        locate(rows, F.col("proba"), inner, bins, "bin", strict=True)
        .groupBy("period", "bin")
        .agg(
            F.count("*").alias("n"),
            F.avg("proba").alias("mean_probability"),
            F.avg(F.col("y_true").cast("double")).alias("positive_rate"),
        )
    )


def _brier(scored: DataFrame) -> DataFrame:
    miss = F.nanvl(F.col("proba").cast("double"), F.lit(None)) - F.col("y_true").cast("double")
    squared = miss * miss
    current = F.col("period") == CURRENT
    return scored.agg(
        F.avg(F.when(F.col("period") == REFERENCE, squared)).alias("ref_brier"),
        F.avg(F.when(current, squared)).alias("cur_brier"),
        (F.min(F.when(current, F.col("y_true"))) < F.max(F.when(current, F.col("y_true")))).alias("both_classes"),
    )


def brier_score(scored: DataFrame) -> DataFrame:
    """One row: Brier score of both periods and the change."""
    return _brier(scored).drop("both_classes").withColumn("brier_delta", F.col("cur_brier") - F.col("ref_brier"))


def calibration_assessment(scored: DataFrame) -> DataFrame:
    """`brier_score` with the verdict. No row unless both current classes are present."""
    return assessed(_brier(scored))


def assessed(brier: DataFrame) -> DataFrame:
    """The verdict on (ref_brier, cur_brier, both_classes)."""
    verdict = F.when(F.col("brier_delta") >= BRIER_RISE, "overconfidence_rising").otherwise("no_big_change")
    return (
        brier.withColumn("brier_delta", F.col("cur_brier") - F.col("ref_brier"))
        .where(F.col("both_classes") & F.col("brier_delta").isNotNull())
        .drop("both_classes")
        .withColumn("assessment", verdict)
    )
