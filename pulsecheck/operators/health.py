"""The health score. Every input is a result table of a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecheck.config import CURRENT, DANGER, HEALTH_WEIGHTS, WARNING
from pulsecheck.functions.expressions import clip_score, count_where
from pulsecheck.functions.literal import local_table

COMPONENT = "component string, score double, reason string"


def _from_statuses(table: DataFrame, component: str, danger_cost: int, warning_cost: int, empty_is_null: bool) -> DataFrame:
    counted = table.agg(
        F.count("*").alias("n"),
        count_where(F.col("status") == DANGER).alias("danger"),
        count_where(F.col("status") == WARNING).alias("warning"),
    )
    score = clip_score((F.lit(100) - F.col("danger") * danger_cost - F.col("warning") * warning_cost).cast("double"))
    reason = F.format_string("danger %d, warning %d", "danger", "warning")
    if empty_is_null:
        score = F.when(F.col("n") > 0, score)
        reason = F.when(F.col("n") > 0, reason).otherwise("nothing to compare")
    return counted.select(F.lit(component).alias("component"), score.alias("score"), reason.alias("reason"))


def health_quality(quality: DataFrame) -> DataFrame:
    return _from_statuses(quality, "quality", 18, 7, empty_is_null=False)


def health_stability(drift: DataFrame) -> DataFrame:
    return _from_statuses(drift, "stability", 16, 6, empty_is_null=True)


def health_segments(segments: DataFrame | None, spark=None) -> DataFrame:
    """Current groups only. Without any group, of either period, there is no score."""
    if segments is None:
        return local_table(spark, [("segments", None, "no groups or no labels")], COMPONENT)
    past = F.col("period") != CURRENT
    return _from_statuses(
        segments.select(F.when(past, F.lit("past")).otherwise(F.col("status")).alias("status")), "segments", 18, 7, True
    )


def _drop(metric: str) -> Column:
    """How far the metric fell, at least 0; a missing metric counts as 0."""
    before = F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("before"))), F.lit(0.0))
    after = F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("after"))), F.lit(0.0))
    return F.greatest(F.lit(0.0), before - after)


def _rise(metric: str) -> Column:
    """Relative growth of an error, at least 0."""
    before = F.max(F.when(F.col("metric") == metric, F.col("before")))
    after = F.max(F.when(F.col("metric") == metric, F.col("after")))
    return F.greatest(F.lit(0.0), after / F.greatest(before, F.lit(1e-9)) - 1.0)


def _performance(performance: DataFrame, parts: list[tuple[str, Column, float]], template: str, scale: list[float]) -> DataFrame:
    known = F.count("after").alias("n")
    facts = performance.agg(known, *[c.alias(name) for name, c, _ in parts])
    score = F.lit(100.0)
    for name, _, cost in parts:
        score = score - F.col(name) * F.lit(cost)
    reason = F.format_string(template, *[F.col(name) * F.lit(s) for (name, _, _), s in zip(parts, scale)])
    return facts.select(
        F.lit("performance").alias("component"),
        F.when(F.col("n") > 0, clip_score(score)).alias("score"),
        F.when(F.col("n") > 0, reason).otherwise("no current labels").alias("reason"),
    )


def health_performance_binary(performance: DataFrame) -> DataFrame:
    parts = [("recall", _drop("recall"), 170.0), ("f1", _drop("f1"), 120.0), ("auc", _drop("roc_auc"), 80.0)]
    return _performance(performance, parts, "recall -%.1f, f1 -%.1f, roc_auc -%.1f points", [100.0, 100.0, 100.0])


def health_performance_multiclass(performance: DataFrame) -> DataFrame:
    parts = [
        ("recall", _drop("macro_recall"), 150.0),
        ("f1", _drop("macro_f1"), 140.0),
        ("balanced", _drop("balanced_accuracy"), 80.0),
    ]
    template = "macro_recall -%.1f, macro_f1 -%.1f, balanced_accuracy -%.1f points"
    return _performance(performance, parts, template, [100.0, 100.0, 100.0])


def health_performance_regression(performance: DataFrame) -> DataFrame:
    parts = [("mae", _rise("mae"), 55.0), ("rmse", _rise("rmse"), 35.0), ("r2", _drop("r2"), 35.0)]
    return _performance(performance, parts, "mae +%.1f%%, rmse +%.1f%%, r2 -%.3f", [100.0, 100.0, 1.0])


def health_reliability(calibration: DataFrame | None, spark=None) -> DataFrame:
    if calibration is None:
        return local_table(spark, [("reliability", None, "no calibration")], COMPONENT)
    facts = calibration.agg(F.count("*").alias("n"), F.max("cur_brier").alias("brier"), F.max("brier_delta").alias("delta"))
    delta = F.greatest(F.lit(0.0), F.col("delta"))
    score = clip_score(F.lit(100.0) - F.col("brier") * 170.0 - delta * 180.0)
    reason = F.format_string("brier %.3f, up %.3f", "brier", delta)
    return facts.select(
        F.lit("reliability").alias("component"),
        F.when(F.col("n") > 0, score).alias("score"),
        F.when(F.col("n") > 0, reason).otherwise("no calibration").alias("reason"),
    )


def health_performance(performance: DataFrame | None, kind: str, spark=None) -> DataFrame:
    if performance is None:
        return local_table(spark, [("performance", None, "no current labels")], COMPONENT)
    return {
        "binary": health_performance_binary,
        "multiclass": health_performance_multiclass,
        "regression": health_performance_regression,
    }[kind](performance)


def health_components(
    quality: DataFrame,
    drift: DataFrame,
    performance: DataFrame | None,
    calibration: DataFrame | None,
    segments: DataFrame | None,
    kind: str,
) -> DataFrame:
    """(ord, component, score, weight, reason, state): always five rows."""
    spark = quality.sparkSession
    parts = (
        health_quality(quality)
        .unionByName(health_stability(drift))
        .unionByName(health_performance(performance, kind, spark))
        .unionByName(health_reliability(calibration, spark))
        .unionByName(health_segments(segments, spark))
    )
    rows = [(i, name, weight) for i, (name, weight) in enumerate(HEALTH_WEIGHTS.items())]
    weights = local_table(spark, rows, "ord int, component string, weight double")
    state = F.when(F.col("score").isNotNull(), "computed").otherwise("unavailable")
    return (
        weights.join(parts, "component")
        .select("ord", "component", "score", "weight", "reason", state.alias("state"))
        .orderBy("ord")
    )


def health_score(components: DataFrame, current_rows: int) -> DataFrame:
    """One row (score, risk, confidence, n_unavailable). Weights of missing components are left out."""
    known = F.col("score").isNotNull()
    total = F.sum(F.when(known, F.col("score") * F.col("weight"))) / F.sum(F.when(known, F.col("weight")))
    # halves go to the even neighbour
    facts = components.agg(
        F.bround(clip_score(total), 1).alias("score"), count_where(~known).alias("n_unavailable")
    )
    risk = F.when(F.col("score") >= 80, "low").when(F.col("score") >= 60, "medium").otherwise("high")
    many, some = F.lit(current_rows >= 500), F.lit(current_rows >= 200)
    confidence = F.when(many & (F.col("n_unavailable") == 0), "high").when(some, "medium").otherwise("low")
    return facts.select("score", risk.alias("risk"), confidence.alias("confidence"), "n_unavailable")
