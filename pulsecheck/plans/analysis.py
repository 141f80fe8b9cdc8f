"""The whole check: two tables in, every result out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecheck.config import CURRENT, MIN_SEGMENT_ROWS, PERIOD, REFERENCE
from pulsecheck.functions.expressions import quoted
from pulsecheck.functions.literal import literal_table
from pulsecheck.operators import calibration as cal
from pulsecheck.operators import columns as cols
from pulsecheck.operators import drift as dr
from pulsecheck.operators import cells, health, performance, profile, quality, report, segments, surrogate
from pulsecheck.operators.frequency import column_stats
from pulsecheck.sources.csv import write_csv
from pulsecheck.sources.pairs import OWN_PERIOD, Pair, pair_of

SEGMENT_FIGURE = report.SEGMENT_METRIC


@dataclass
class Analysis:
    """Result tables. A result that the data do not allow is None."""

    kind: str
    current_rows: int
    scored: DataFrame
    quality: DataFrame
    drift: DataFrame
    metrics: DataFrame
    performance: DataFrame | None
    calibration: DataFrame | None
    segments: DataFrame | None
    sweep: DataFrame | None
    components: DataFrame
    score: DataFrame
    findings: DataFrame
    actions: DataFrame
    limitations: DataFrame
    headline: DataFrame
    prediction_source: str = "logged"
    tables: dict[str, DataFrame] | None = None
    target: str | None = None

    def profile(self, period: str) -> dict[str, DataFrame]:
        """Profile of one side: summary, duplicates, ids, constants, leakage, target distribution."""
        df = self.tables[period]
        return profile.profile_data(df, self.target if self.target in df.columns else None)

    # data-sized results stay lazy
    def confusion(self) -> DataFrame:
        return performance.confusion_matrix(self.scored)

    def _with_curves(self) -> bool:
        """Both periods have probabilities and labels, and current has two classes."""
        return self.calibration is not None

    def roc_curve(self) -> DataFrame | None:
        return performance.roc_curve(self.scored) if self._with_curves() else None

    def pr_curve(self) -> DataFrame | None:
        return performance.pr_curve(self.scored) if self._with_curves() else None

    def calibration_curve(self) -> DataFrame | None:
        return cal.calibration_curve(self.scored) if self._with_curves() else None

    def residuals(self) -> DataFrame:
        return performance.residuals(self.scored)

    def summary(self) -> DataFrame:
        return report.report_summary(self.score)

    def json(self) -> DataFrame:
        return report.json_views(
            self.score, self.components, self.drift, self.performance, self.calibration, self.segments, self.sweep
        )

    def overview(self) -> DataFrame:
        """(section, item, measure, value, status): every figure and verdict in one long table."""

        def rows(df: DataFrame | None, section: str, item: Column, measure: Column, value: Column, status: Column) -> list[DataFrame]:
            if df is None:
                return []
            return [
                df.select(
                    F.lit(section).alias("section"),
                    item.cast("string").alias("item"),
                    measure.alias("measure"),
                    value.cast("double").alias("value"),
                    status.cast("string").alias("status"),
                )
            ]

        nothing = F.lit(None)
        figure = SEGMENT_FIGURE[self.kind]
        group = F.concat_ws("/", "period", "segment_column", "segment_group")
        parts = [
            *rows(self.quality, "quality", F.col("column"), F.lit("missing_delta"), F.col("missing_delta"), F.col("status")),
            *rows(self.drift, "drift", F.col("column"), F.col("measure"), F.col("score"), F.col("status")),
            *rows(self.performance, "performance", F.col("metric"), F.lit("before"), F.col("before"), nothing),
            *rows(self.performance, "performance", F.col("metric"), F.lit("after"), F.col("after"), nothing),
            *rows(self.calibration, "calibration", F.lit("brier"), F.lit("delta"), F.col("brier_delta"), F.col("assessment")),
            *rows(self.segments, "segment", group, F.lit(figure), F.col(figure) if self.segments else nothing, F.col("status")),
            *rows(self.sweep, "threshold", F.format_string("%.2f", "threshold"), F.lit("f1"), F.col("f1"), nothing),
            *rows(self.components, "health", F.col("component"), F.lit("score"), F.col("score"), F.col("state")),
            *rows(self.score, "health", F.lit("total"), F.lit("score"), F.col("score"), F.col("risk")),
            *rows(self.findings, "finding", F.col("finding"), F.lit("severity"), nothing, F.col("severity")),
            *rows(self.actions, "action", F.col("action"), F.lit("priority"), nothing, F.col("priority")),
            *rows(self.limitations, "limitation", F.col("limitation"), F.lit("holds"), nothing, nothing),
        ]
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        return table

    def write_csv(self, folder: str) -> list[str]:
        """The downloadable tables, one folder each."""
        written = []
        for field in fields(self):
            table = getattr(self, field.name)
            if field.name in ("components", "quality", "drift", "performance", "segments") and table is not None:
                write_csv(table, f"{folder}/{field.name}")
                written.append(f"{folder}/{field.name}")
        return written


def pair_counts(pair: Pair, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The counts of all columns and the drift of the numeric ones, of which nothing depends on a model."""
    stats, numeric_rows = _side_by_side(
        pair.rows.sparkSession,
        lambda: literal_table(column_stats(pair, None, dr.textual_columns(pair, categorical))),
        lambda: literal_table(dr.numeric_drift(pair, numeric)) if numeric else None,
    )
    return stats, numeric_rows


def analyze_scored(
    scored: DataFrame,
    pair: Pair,
    kind: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str | None = None,
    threshold_setting: float = 0.50,
    classes: Sequence[str] = (),
    probabilities: str | None = None,
    segment_pair: Pair | None = None,
    counted_pair: tuple[DataFrame, DataFrame | None] | None = None,
) -> Analysis:
    """Everything that follows from a scored table (`period, y_true, y_pred[, proba]` and features).

    `pair` holds the rows for quality and drift; `counted_pair` what `pair_counts` found in them, if that is known. Each result has a size that does not grow with the
    data, and is computed once; the score and the report then work on those rows alone.
    """
    spark = scored.sparkSession
    textual = dr.textual_columns(pair, categorical)
    stats, numeric_rows = counted_pair or pair_counts(pair, numeric, categorical)
    same_rows = segment_pair is None
    kept_from = stats if same_rows and len(textual) == len(categorical) else literal_table(column_stats(segment_pair or pair, categorical)) if categorical else None
    kept = cells.kept_segments(kept_from, categorical) if categorical else []
    if kind == "binary":
        table = cells.score_cells(scored, kept)
        facts = cells.overall(table).groupBy(PERIOD, F.col("y_true").isNull().alias("unlabelled")).agg(F.sum("n").alias("n"))
    else:
        facts = scored.groupBy(PERIOD, F.col("y_true").isNull().alias("unlabelled")).agg(F.count("*").alias("n"))
    counted = [r for r in facts.collect() if r[PERIOD] == CURRENT]
    current_rows = sum(r["n"] for r in counted)
    has_labels = current_rows > 0 and not any(r["unlabelled"] for r in counted)

    labelled = scored.where(F.col("y_true").isNotNull())
    with_groups = has_labels and bool(categorical)
    with_probabilities = has_labels and kind == "binary" and "proba" in scored.columns

    def metrics_of() -> DataFrame:
        if kind == "binary":
            return literal_table(cells.cell_metrics(table, labelled))
        return performance.settled_metrics(labelled, kind, classes, probabilities)

    def groups_of() -> DataFrame | None:
        if not with_groups:
            return None
        if kind == "binary":
            return literal_table(cells.cell_segments(table, MIN_SEGMENT_ROWS))
        return literal_table(segments.judged_segments(scored, kept, kind))

    metrics, groups, calibrated, sweep = _side_by_side(
        spark,
        metrics_of,
        groups_of,
        lambda: _unless_empty(literal_table(cells.cell_assessment(table))) if with_probabilities else None,
        lambda: _unless_empty(literal_table(cells.cell_sweep(table))) if with_probabilities else None,
    )
    quality_rows = literal_table(quality.quality_table(pair, target, stats))
    drift_rows = literal_table(dr.joined_drift(pair, numeric_rows, categorical, stats))
    compared = literal_table(performance.performance_table(metrics, kind)) if has_labels else None
    components, found, steps = _side_by_side(
        scored.sparkSession,
        lambda: literal_table(health.health_components(quality_rows, drift_rows, compared, calibrated, groups, kind)),
        lambda: literal_table(report.findings(drift_rows, compared, calibrated, groups, kind)),
        lambda: literal_table(report.actions(drift_rows, compared, calibrated, sweep, kind, threshold_setting)),
    )
    score = literal_table(health.health_score(components, current_rows))
    return Analysis(
        kind=kind,
        current_rows=current_rows,
        scored=scored,
        quality=quality_rows,
        drift=drift_rows,
        metrics=metrics,
        performance=compared,
        calibration=calibrated,
        segments=groups,
        sweep=sweep,
        components=components,
        score=score,
        findings=found,
        actions=steps,
        limitations=report.limitations(groups, kind, current_rows, has_labels, scored.sparkSession),
        headline=report.headline_counts(drift_rows, groups, steps),
        tables={name: pair.period(name) for name in (REFERENCE, CURRENT)},
        target=target,
    )


def _side_by_side(spark: SparkSession, *parts: Callable[[], Any]) -> list[Any]:
    """Independent results as Spark jobs that run at the same time, so that the cluster is not idle
    while the last tasks of one of them finish."""
    with ThreadPoolExecutor(len(parts)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(part)) for part in parts]
        return [job.result() for job in running]


def _unless_empty(df: DataFrame) -> DataFrame | None:
    return None if df.isEmpty() else df


def analyze(
    reference: DataFrame,
    current: DataFrame,
    target: str,
    order: Sequence[str],
    task: str = "auto",
    positive: str | None = None,
    excluded: Sequence[str] | None = None,
    threshold_setting: float = 0.50,
    prediction_column: str | None = None,
    probability_column: str | None = None,
    trees: int = surrogate.TREES,
    max_categories: int | None = None,
    baseline_prediction_column: str | None = None,
    labelled_only: bool = False,
) -> Analysis:
    """Compare two tables end to end, fitting the stand-in model on the reference.

    `order` names the columns that put reference rows into past-to-present order and end with a key.
    `excluded` defaults to the suggested exclusions. `max_categories`: a categorical feature with more values is an
    error (none by default; the values of a feature are kept on the driver while the model is fitted).

    `baseline_prediction_column` names logged predictions of the reference, `labelled_only` judges the labelled rows of a current
    table that has labels for some (see `score_tables`). A column called `period` takes part under the name OWN_PERIOD.
    """
    reference, current = (df.withColumnRenamed(PERIOD, OWN_PERIOD) for df in (reference, current))
    target, prediction_column, probability_column, baseline_prediction_column = (
        OWN_PERIOD if name == PERIOD else name for name in (target, prediction_column, probability_column, baseline_prediction_column)
    )
    order = [OWN_PERIOD if name == PERIOD else name for name in order]
    excluded = excluded and [OWN_PERIOD if name == PERIOD else name for name in excluded]
    found = cols.infer_task_type(reference, target, task)
    if excluded is None:
        excluded = [*cols.excluded_names(reference, target, prediction_column, probability_column), *filter(None, [baseline_prediction_column])]
    pair = pair_of(reference, current)
    numeric, categorical = cols.feature_columns(pair, target, excluded)
    if not numeric and not categorical:
        raise ValueError("the two tables share no feature columns")
    # The pair is counted while the driver and single tasks of the fit leave cores idle.
    scored, counted = _side_by_side(
        reference.sparkSession,
        lambda: surrogate.score_tables(
            reference,
            current,
            target,
            found,
            order,
            numeric,
            categorical,
            positive,
            threshold_setting,
            prediction_column,
            probability_column,
            trees,
            max_categories,
            baseline_prediction_column,
            labelled_only,
        ),
        lambda: pair_counts(pair, numeric, categorical),
    )
    kept = Pair(
        scored.rows.select(PERIOD, *[quoted(c) for c in categorical]),
        {c: pair.reference_types[c] for c in categorical},
        {c: pair.reference_types[c] for c in categorical},
    )
    result = analyze_scored(
        scored.rows,
        pair,
        found.kind,
        numeric,
        categorical,
        target,
        threshold_setting,
        list(range(len(scored.classes))),
        "probabilities" if found.kind == "multiclass" else None,
        segment_pair=kept,
        counted_pair=counted,
    )
    result.prediction_source = scored.source
    result.tables, result.target = {REFERENCE: reference, CURRENT: current}, target
    return result
