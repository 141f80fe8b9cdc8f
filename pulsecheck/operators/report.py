"""Findings, actions and result views. Every input is a result table of a few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.config import BRIER_RISE, CURRENT, DANGER, INSUFFICIENT, WARNING
from pulsecheck.functions.expressions import count_where
from pulsecheck.functions.literal import local_table
from pulsecheck.operators.threshold import threshold_improvement

NAMES_SHOWN = 5
SEGMENT_METRIC = {"binary": "recall", "multiclass": "macro_f1", "regression": "mae"}
KEY_METRIC = {"binary": "recall", "multiclass": "macro_recall", "regression": "mae"}


def _finding(df: DataFrame, ord_: int, finding: Column | str, severity: Column | str, evidence: Column, affected: Column | None = None) -> DataFrame:
    def column(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    none = F.array().cast("array<string>")
    return df.select(
        F.lit(ord_).alias("ord"),
        column(finding).alias("finding"),
        column(severity).alias("severity"),
        evidence.alias("evidence"),
        (none if affected is None else affected).alias("affected_columns"),
    )


def finding_drift(drift: DataFrame) -> DataFrame:
    """Columns past the danger limit, or else past the warning limit; the first five names by score."""

    def names(status: str) -> Column:
        entry = F.when(F.col("status") == status, F.struct((-F.col("score")).alias("s"), F.col("column").alias("name")))
        # drift tables have one row per feature
        return F.sort_array(F.collect_list(entry))

    facts = drift.agg(names(DANGER).alias("danger"), names(WARNING).alias("warning"))
    strong = F.size("danger") > 0
    chosen = F.when(strong, F.col("danger")).otherwise(F.col("warning"))
    facts = facts.withColumn("chosen", chosen).where(F.size("chosen") > 0)
    limit = F.when(strong, "danger").otherwise("warning")
    return _finding(
        facts,
        1,
        F.when(strong, "strong_drift").otherwise("drift_watch"),
        F.when(strong, "high").otherwise("medium"),
        F.format_string("%d columns past the %s limit", F.size("chosen"), limit),
        F.slice(F.col("chosen.name"), 1, NAMES_SHOWN),
    )


def _pick(metric: str, side: str) -> Column:
    return F.max(F.when(F.col("metric") == metric, F.col(side)))


def finding_performance(performance: DataFrame, kind: str) -> DataFrame:
    if kind == "regression":
        facts = performance.agg(_pick("mae", "before").alias("before"), _pick("mae", "after").alias("after"))
        facts = facts.withColumn("rise", F.col("after") / F.greatest(F.col("before"), F.lit(1e-9)) - 1.0)
        return _finding(
            facts.where(F.col("rise") >= 0.15),
            2,
            "error_increase",
            F.when(F.col("rise") >= 0.35, "high").otherwise("medium"),
            F.format_string("mae %.3f -> %.3f (+%.1f%%)", "before", "after", F.col("rise") * 100.0),
        )
    recall, f1 = ("recall", "f1") if kind == "binary" else ("macro_recall", "macro_f1")
    facts = performance.agg(
        _pick(recall, "before").alias("r0"),
        _pick(recall, "after").alias("r1"),
        (_pick(f1, "before") - _pick(f1, "after")).alias("f1_drop"),
    ).withColumn("recall_drop", F.col("r0") - F.col("r1"))
    return _finding(
        facts.where((F.col("recall_drop") >= 0.10) | (F.col("f1_drop") >= 0.10)),
        2,
        "performance_drop",
        F.when(F.col("recall_drop") >= 0.20, "high").otherwise("medium"),
        F.format_string(f"{recall} %.3f -> %.3f, {f1} -%.1f points", "r0", "r1", F.col("f1_drop") * 100.0),
    )


def finding_calibration(calibration: DataFrame) -> DataFrame:
    return _finding(
        calibration.where(F.col("brier_delta") >= BRIER_RISE),
        3,
        "calibration_worse",
        "medium",
        F.format_string("brier %.3f -> %.3f", "ref_brier", "cur_brier"),
    )


def weak_current(segments: DataFrame) -> DataFrame:
    return segments.where((F.col("period") == CURRENT) & F.col("status").isin(WARNING, DANGER))


def finding_segment(segments: DataFrame, kind: str, worst_first: bool = False) -> DataFrame:
    """The top weak group: danger before warning, then by the metric. By default the metric runs as in
    the rule this reports on (regression ascending, others descending); `worst_first` turns it around."""
    metric = SEGMENT_METRIC[kind]
    ascending = (kind == "regression") != worst_first
    rank = F.when(F.col("status") == DANGER, 0).otherwise(1)
    order = [rank, F.asc(metric) if ascending else F.desc(metric), "segment_column", "segment_group"]
    top = weak_current(segments).orderBy(*order).limit(1)
    evidence = F.format_string(f"%s=%s n=%d {metric}=%.3f", "segment_column", "segment_group", "n", metric)
    severity = F.when(F.col("status") == DANGER, "high").otherwise("medium")
    return _finding(top, 4, "weak_segment", severity, evidence, F.array("segment_column"))


def findings(
    drift: DataFrame,
    performance: DataFrame | None,
    calibration: DataFrame | None,
    segments: DataFrame | None,
    kind: str,
) -> DataFrame:
    """All findings in order; a single low-severity row when there is none."""
    found = finding_drift(drift)
    if performance is not None:
        found = found.unionByName(finding_performance(performance, kind))
    if calibration is not None:
        found = found.unionByName(finding_calibration(calibration))
    if segments is not None:
        found = found.unionByName(finding_segment(segments, kind))
    quiet = found.agg(F.count("*").alias("n")).where(F.col("n") == 0)
    calm = _finding(quiet, 9, "no_strong_signal", "low", F.lit("no key figure is past its limit"))
    return found.unionByName(calm).orderBy("ord")


def actions(
    drift: DataFrame,
    performance: DataFrame | None,
    calibration: DataFrame | None,
    sweep: DataFrame | None,
    kind: str,
    threshold: float = 0.50,
) -> DataFrame:
    """(ord, priority, action, reason)."""

    def action(df: DataFrame, ord_: int, priority: Column | str, text: Column | str, reason: Column | str) -> DataFrame:
        def column(value: Column | str) -> Column:
            return F.lit(value) if isinstance(value, str) else value

        return df.select(
            F.lit(ord_).alias("ord"),
            column(priority).alias("priority"),
            column(text).alias("action"),
            column(reason).alias("reason"),
        )

    drifted = drift.agg(count_where(F.col("status") == DANGER).alias("n")).where(F.col("n") > 0)
    steps = action(drifted, 1, "immediate", "check_collection_of_drifted_columns", F.format_string("%d columns drift", "n"))
    if performance is not None:
        key = KEY_METRIC[kind]
        facts = performance.agg(_pick(key, "before").alias("b"), _pick(key, "after").alias("a"))
        worse = F.col("a") > F.col("b") * 1.15 if kind == "regression" else F.col("b") - F.col("a") >= 0.10
        steps = steps.unionByName(action(facts.where(worse), 2, "short_term", "try_retraining_on_recent_labels", f"{key} got worse"))
    if kind == "binary" and sweep is not None:
        gain = threshold_improvement(sweep, threshold)
        steps = steps.unionByName(
            action(
                gain,
                3,
                F.col("priority"),
                F.format_string("review_threshold_%.2f", "best_threshold"),
                F.format_string("f1 %+.3f against the current setting", "improvement"),
            )
        )
    if calibration is not None:
        rising = calibration.where(F.col("brier_delta") >= BRIER_RISE)
        steps = steps.unionByName(action(rising, 4, "short_term", "try_probability_calibration", "brier score got worse"))
    always = [(5, "monitor", "track_drift_and_groups_weekly", "tell passing changes from lasting ones")]
    last = local_table(drift.sparkSession, always, "ord int, priority string, action string, reason string")
    return steps.unionByName(last).orderBy("ord")


def limitations(segments: DataFrame | None, kind: str, current_rows: int, has_labels: bool, spark) -> DataFrame:
    """(ord, limitation)."""
    fixed = [
        (1, "no_current_labels", not has_labels),
        (2, "calibration_and_thresholds_are_binary_only", kind != "binary"),
        (3, "fewer_than_200_current_rows", current_rows < 200),
        (5, "nothing_is_applied_automatically", True),
    ]
    schema = "ord int, limitation string"
    rows = local_table(spark, [(i, text) for i, text, holds in fixed if holds], schema)
    if segments is not None:
        small = segments.agg(count_where(F.col("status") == INSUFFICIENT).alias("n")).where(F.col("n") > 0)
        rows = rows.unionByName(small.select(F.lit(4).alias("ord"), F.lit("groups_with_too_few_samples").alias("limitation")))
    return rows.orderBy("ord")


def report_summary(score: DataFrame) -> DataFrame:
    text = F.format_string("health score %.1f/100, risk %s, confidence %s", "score", "risk", "confidence")
    return score.select("score", "risk", "confidence", text.alias("summary"))


def headline_counts(drift: DataFrame, segments: DataFrame | None, steps: DataFrame) -> DataFrame:
    """One row: danger drift columns, weak current groups, immediate actions."""
    marks = drift.where(F.col("status") == DANGER).select(F.lit("drift").alias("mark"))
    marks = marks.unionByName(steps.where(F.col("priority") == "immediate").select(F.lit("action").alias("mark")))
    if segments is not None:
        marks = marks.unionByName(weak_current(segments).select(F.lit("group").alias("mark")))
    return marks.agg(
        count_where(F.col("mark") == "drift").alias("danger_drift"),
        count_where(F.col("mark") == "group").alias("weak_groups"),
        count_where(F.col("mark") == "action").alias("immediate_actions"),
    )


# --- result views -----------------------------------------------------------------------------


def json_records(df: DataFrame, order: Sequence[Column | str], limit: int = 20) -> DataFrame:
    """One row (n, records): the first `limit` rows as a JSON array; NaN becomes null."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.nanvl(value, F.lit(None).cast("double"))
        columns.append(value.alias(field.name))
    top = df.orderBy(*order).limit(limit).select(*columns)
    # `limit` rows at most
    gathered = top.agg(F.count("*").alias("n"), F.collect_list(F.struct(*top.columns)).alias("records"))
    return gathered.select("n", F.to_json("records", {"ignoreNullFields": "false"}).alias("records"))


def top_drift(drift: DataFrame, limit: int = 10) -> DataFrame:
    return drift.orderBy(F.desc("score"), "column").limit(limit)


def current_segments(segments: DataFrame, limit: int = 15) -> DataFrame:
    """The first current groups by column and group name."""
    return segments.where(F.col("period") == CURRENT).orderBy("segment_column", "segment_group").limit(limit)


def top_thresholds(sweep: DataFrame, limit: int = 5) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(limit)


def json_views(
    score: DataFrame,
    components: DataFrame,
    drift: DataFrame,
    performance: DataFrame | None,
    calibration: DataFrame | None,
    segments: DataFrame | None,
    sweep: DataFrame | None,
) -> DataFrame:
    """(view, n, records) for every available result."""

    def view(name: str, df: DataFrame, order: Sequence[Column | str], limit: int) -> DataFrame:
        return json_records(df, order, limit).select(F.lit(name).alias("view"), "n", "records")

    views = view("health", score, ["score"], 1).unionByName(view("components", components, ["ord"], 20))
    views = views.unionByName(view("drift", drift, [F.desc("score"), "column"], 10))
    if performance is not None:
        views = views.unionByName(view("performance", performance, ["ord"], 20))
    if calibration is not None:
        views = views.unionByName(view("calibration", calibration, ["cur_brier"], 1))
    if segments is not None:
        current = segments.where(F.col("period") == CURRENT)
        views = views.unionByName(view("segments", current, ["segment_column", "segment_group"], 15))
    if sweep is not None:
        views = views.unionByName(view("thresholds", sweep, [F.desc("f1"), "threshold"], 5))
    return views
