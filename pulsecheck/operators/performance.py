"""Model performance of both periods, from a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecheck.config import CURRENT, REFERENCE
from pulsecheck.functions.expressions import count_where, safe_div
from pulsecheck.functions.literal import literal_table
from pulsecheck.functions.ordering import running_totals

BINARY_METRICS = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]
RANKED_METRICS = ["roc_auc", "pr_auc"]
MULTICLASS_METRICS = ["accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1"]
REGRESSION_METRICS = ["mae", "rmse", "r2"]
MAX_LABELS = 100
EPSILON = 2.220446049250313e-16  # spacing of doubles at 1


# --- binary -----------------------------------------------------------------------------------


def confusion_aggregates() -> list[Column]:
    actual, predicted = F.col("y_true") == 1, F.col("y_pred") == 1
    return [
        F.count("*").alias("n"),
        count_where(~actual & ~predicted).alias("tn"),
        count_where(~actual & predicted).alias("fp"),
        count_where(actual & ~predicted).alias("fn"),
        count_where(actual & predicted).alias("tp"),
    ]


def binary_ratios() -> list[Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return [
        safe_div(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_div(fp, fp + tn).alias("fpr"),
        safe_div(fn, fn + tp).alias("fnr"),
    ]


def binary_confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("period").agg(*confusion_aggregates())


def binary_metrics(scored: DataFrame) -> DataFrame:
    return binary_confusion(scored).select("period", *binary_ratios())


def score_rows(scored: DataFrame) -> DataFrame:
    """(period, score, y_true); rows without a score (null or NaN) or without a label take no part."""
    rows = scored.select("period", F.nanvl(F.col("proba").cast("double"), F.lit(None)).alias("score"), "y_true")
    return rows.where("score IS NOT NULL AND y_true IS NOT NULL")


def score_ranks(scored: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Per period the distinct scores ascending, with positives and negatives, running and in total. `cuts`: see `running_totals`."""
    rows = score_rows(scored)
    counts = {"pos": count_where(F.col("y_true") == 1), "neg": count_where(F.col("y_true") != 1)}
    return running_totals(rows, ["period"], "score", counts, cuts, n_keys=2)


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def ranked_metrics(scored: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(period, roc_auc, pr_auc); null where a period has a single class."""
    both = (F.col("all_pos") > 0) & (F.col("all_neg") > 0)
    below = _double("cum_neg") - _double("neg") / 2.0
    caught = _double("all_pos") - _double("cum_pos") + _double("pos")
    alarms = _double("all_neg") - _double("cum_neg") + _double("neg")
    return (
        score_ranks(scored, cuts)
        .groupBy("period")
        .agg(
            F.sum(F.when(both, _double("pos") / _double("all_pos") * (below / _double("all_neg")))).alias("roc_auc"),
            F.sum(F.when(both, _double("pos") / _double("all_pos") * (caught / (caught + alarms)))).alias("pr_auc"),
        )
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    return ranked_metrics(scored).select("period", "roc_auc")


def pr_auc(scored: DataFrame) -> DataFrame:
    """Average precision: the step sum over distinct scores, not the trapezoid."""
    return ranked_metrics(scored).select("period", "pr_auc")


def roc_curve(scored: DataFrame) -> DataFrame:
    """(period, threshold, fpr, tpr): (0, 0) with a null threshold, then one point per distinct score
    from high to low. Points inside a straight run are dropped."""
    ranks = score_ranks(scored)
    # the neighbour with the next lower score: inside the range by a window, across ranges by a table
    # of one row per range
    ends = ranks.groupBy("period", "range_id").agg(F.max_by(F.struct("pos", "neg"), "score").alias("end"))
    steps = Window.partitionBy("period").orderBy("range_id")
    before = ends.select("period", "range_id", F.lag("end").over(steps).alias("__end"))
    inside = Window.partitionBy("period", "range_id").orderBy("score")
    linked = ranks.withColumn("__lower", F.lag(F.struct("pos", "neg")).over(inside)).join(
        F.broadcast(before), ["period", "range_id"]
    )
    lower = F.coalesce("__lower", "__end")
    highest = _highest()
    corner = highest | lower.isNull() | (lower["pos"] != F.col("pos")) | (lower["neg"] != F.col("neg"))
    points = linked.where(corner).select(
        "period",
        F.col("score").alias("threshold"),
        _share("neg").alias("fpr"),
        _share("pos").alias("tpr"),
        highest.alias("first"),
    )
    # the origin comes with the highest score of the period, so the table is not read for it
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    point = F.struct("threshold", "fpr", "tpr")
    return points.select("period", F.explode(F.when(F.col("first"), F.array(start, point)).otherwise(F.array(point))).alias("p")).select("period", "p.*")


def _highest() -> Column:
    """Whether a distinct score is the highest of its period."""
    return (F.col("cum_pos") == F.col("all_pos")) & (F.col("cum_neg") == F.col("all_neg"))


def _share(kind: str) -> Column:
    """Share of the rows of one class with this score or a higher one."""
    reached = _double(f"all_{kind}") - _double(f"cum_{kind}") + _double(kind)
    return F.when(F.col(f"all_{kind}") > 0, reached / _double(f"all_{kind}"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(period, threshold, recall, precision): one point per distinct score and the end point (0, 1)."""
    caught = _double("all_pos") - _double("cum_pos") + _double("pos")
    alarms = _double("all_neg") - _double("cum_neg") + _double("neg")
    recall = F.when(F.col("all_pos") > 0, caught / _double("all_pos")).otherwise(F.lit(1.0))
    points = score_ranks(scored).select(
        "period", _highest().alias("first"), F.col("score").alias("threshold"), recall.alias("recall"), safe_div(caught, caught + alarms).alias("precision")
    )
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    point = F.struct("threshold", "recall", "precision")
    return points.select("period", F.explode(F.when(F.col("first"), F.array(point, end)).otherwise(F.array(point))).alias("p")).select("period", "p.*")


# --- multiclass -------------------------------------------------------------------------------


def label_cells(scored: DataFrame, keys: Sequence[str] = ("period",)) -> DataFrame:
    """(keys, actual, predicted, n): at most classes x classes rows per key."""
    return scored.groupBy(*keys, F.col("y_true").alias("actual"), F.col("y_pred").alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Every (period, actual, predicted) over the labels seen on either side in any period."""
    cells = literal_table(label_cells(scored))  # one scan; classes x classes rows a period
    labels = cells.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct().count()
    if labels > MAX_LABELS:
        raise ValueError(f"a confusion matrix needs at most {MAX_LABELS} labels, not {labels}")
    seen = cells.agg(
        F.collect_set("period").alias("periods"),
        F.array_union(F.collect_set("actual"), F.collect_set("predicted")).alias("labels"),
    )
    grid = (
        seen.select(F.explode("periods").alias("period"), "labels")
        .select("period", F.explode("labels").alias("actual"), "labels")
        .select("period", "actual", F.explode("labels").alias("predicted"))
    )
    return grid.join(cells, ["period", "actual", "predicted"], "left").na.fill(0, ["n"])


def macro_metrics(cells: DataFrame, keys: Sequence[str] = ("period",)) -> DataFrame:
    """Accuracy, balanced accuracy and macro averages over the labels present in each key."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    rows = cells.select(*keys, F.col("actual").alias("label"), hit.alias("tp"), F.col("n").alias("actual_n"), zero.alias("predicted_n"))
    columns = cells.select(*keys, F.col("predicted").alias("label"), zero.alias("tp"), zero.alias("actual_n"), F.col("n").alias("predicted_n"))
    labels = rows.unionByName(columns).groupBy(*keys, "label").agg(
        F.sum("tp").alias("tp"), F.sum("actual_n").alias("actual_n"), F.sum("predicted_n").alias("predicted_n")
    )
    tp, actual, predicted = F.col("tp"), F.col("actual_n"), F.col("predicted_n")
    return labels.groupBy(*keys).agg(
        F.sum("actual_n").alias("n"),
        safe_div(F.sum("tp"), F.sum("actual_n")).alias("accuracy"),
        F.avg(F.when(actual > 0, safe_div(tp, actual))).alias("balanced_accuracy"),
        F.avg(safe_div(tp, predicted)).alias("macro_precision"),
        F.avg(safe_div(tp, actual)).alias("macro_recall"),
        F.avg(safe_div(2 * tp, actual + predicted)).alias("macro_f1"),
    )


def multiclass_metrics(scored: DataFrame) -> DataFrame:
    return macro_metrics(label_cells(scored)).select("period", *MULTICLASS_METRICS)


def log_loss(scored: DataFrame, classes: Sequence[str], probabilities: str = "probabilities") -> DataFrame:
    """(period, log_loss) of an array of class probabilities ordered like `classes`."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y_true"))
    chosen = F.get(F.col(probabilities), position.cast("int") - 1)
    clipped = F.greatest(F.least(chosen, F.lit(1.0 - EPSILON)), F.lit(EPSILON))
    return scored.groupBy("period").agg((-F.avg(F.ln(clipped))).alias("log_loss"))


# --- regression -------------------------------------------------------------------------------


def regression_metrics(scored: DataFrame) -> DataFrame:
    error = F.col("y_true") - F.col("y_pred")
    sums = scored.groupBy("period").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("__squared"),
        F.regr_syy(F.col("y_true"), F.col("y_true")).alias("__spread"),
    )
    r2 = F.when(F.col("__spread") > 0, F.lit(1.0) - F.col("__squared") / F.col("__spread")).otherwise(
        F.when(F.col("__squared") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return sums.select("period", "mae", "rmse", r2.alias("r2"))


def residuals(scored: DataFrame) -> DataFrame:
    kept = [c for c in scored.columns if c not in ("y_true", "y_pred", "proba", "probabilities")]
    return scored.select(
        *kept,
        F.col("y_true").alias("actual"),
        F.col("y_pred").alias("predicted"),
        (F.col("y_true") - F.col("y_pred")).alias("error"),
    )


# --- comparison -------------------------------------------------------------------------------


def metric_rows(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(period, ord, metric, value) from one row per period."""
    parts = [part for i, m in enumerate(metrics) for part in (F.lit(i), F.lit(m), F.col(m).cast("double"))]
    return wide.select("period", F.stack(F.lit(len(metrics)), *parts).alias("ord", "metric", "value"))


def task_metrics(
    scored: DataFrame, kind: str, classes: Sequence[str] = (), probabilities: str | None = None
) -> DataFrame:
    """(period, ord, metric, value) of all metrics of the task. Two rows per metric."""
    if kind == "regression":
        return metric_rows(regression_metrics(scored), REGRESSION_METRICS)
    if kind == "multiclass":
        wide, metrics = multiclass_metrics(scored), list(MULTICLASS_METRICS)
        if probabilities:
            wide = wide.join(log_loss(scored, classes, probabilities), "period")
            metrics.append("log_loss")
        return metric_rows(wide, metrics)
    wide, metrics = binary_metrics(scored), list(BINARY_METRICS)
    if "proba" in scored.columns:
        wide = wide.join(ranked_metrics(scored), "period", "left")
        metrics += RANKED_METRICS
    return metric_rows(wide, metrics).where(F.col("value").isNotNull() | ~F.col("metric").isin(*RANKED_METRICS))


def performance_table(metrics: DataFrame, kind: str) -> DataFrame:
    """(ord, metric, before, after, change, [change_points,] relative_change) from `task_metrics`."""
    table = metrics.groupBy("metric").agg(
        F.min("ord").alias("ord"),
        F.max(F.when(F.col("period") == REFERENCE, F.col("value"))).alias("before"),
        F.max(F.when(F.col("period") == CURRENT, F.col("value"))).alias("after"),
    )
    change = F.col("after") - F.col("before")
    known = F.col("before").isNotNull() & ~F.isnan("before") & (F.col("before") != 0)
    columns = [F.col("ord"), F.col("metric"), F.col("before"), F.col("after"), change.alias("change")]
    if kind != "regression":
        columns.append(F.when(F.col("metric") != "log_loss", change * 100.0).alias("change_points"))
    columns.append(F.when(known, change / F.abs("before")).alias("relative_change"))
    return table.select(*columns).orderBy("ord")


def settled_metrics(scored: DataFrame, kind: str, classes: Sequence[str] = (), probabilities: str | None = None) -> DataFrame:
    """`task_metrics`, computed once."""
    return literal_table(task_metrics(scored, kind, classes, probabilities))
