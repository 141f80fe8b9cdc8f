"""The tables behind the charts, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecheck.config import CURRENT, DANGER, INSUFFICIENT, REFERENCE, STABLE, WARNING
from pulsecheck.functions.expressions import as_category, as_number, quoted
from pulsecheck.functions.literal import literal_table, local_table
from pulsecheck.operators.drift import category_shares, numeric_facts
from pulsecheck.sources.pairs import Pair
from pulsecheck.sources.shared import settle

SEGMENT_METRICS = {
    "binary": ["recall", "f1", "fpr", "fnr"],
    "multiclass": ["macro_f1", "accuracy"],
    "regression": ["mae"],
}


def _over_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows per value of a fixed domain, zero where there is none."""
    rows = local_table(df.sparkSession, list(enumerate(domain)), f"ord int, {column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return rows.join(counts, column, "left").na.fill(0, ["n"]).select("ord", column, "n")


def severity_counts(found: DataFrame) -> DataFrame:
    return _over_domain(found, "severity", ["high", "medium", "low"])


def quality_status_counts(quality: DataFrame) -> DataFrame:
    return _over_domain(quality, "status", [DANGER, WARNING, STABLE])


def _long(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def missing_top(quality: DataFrame, limit: int = 15) -> DataFrame:
    """(column, period, missing_rate) of the columns with the highest rate on either side."""
    worst = F.greatest("ref_missing_rate", "cur_missing_rate")
    top = quality.where(~F.col("is_target")).orderBy(F.desc_nulls_last(worst), "column").limit(limit)
    renamed = top.select("column", F.col("ref_missing_rate").alias("reference"), F.col("cur_missing_rate").alias("current"))
    return _long(renamed, ["column"], ["reference", "current"], "period", "missing_rate")


def distinct_change_top(quality: DataFrame, limit: int = 12) -> DataFrame:
    """(column, period, n_distinct) of the columns whose number of distinct values changed most."""
    change = F.abs(F.col("cur_distinct") - F.col("ref_distinct"))
    top = quality.orderBy(F.desc(change), "column").limit(limit)
    renamed = top.select("column", F.col("ref_distinct").alias("reference"), F.col("cur_distinct").alias("current"))
    return _long(renamed, ["column"], ["reference", "current"], "period", "n_distinct")


def class_shares(rows: DataFrame, target: str) -> DataFrame:
    """(period, class, n, share), missing as a class of its own."""
    counts = rows.groupBy("period", as_category(rows, target).alias("class")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("period").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "period").select(
        "period", "class", "n", (F.col("n").cast("double") / F.col("total").cast("double")).alias("share")
    )


def drift_scores(drift: DataFrame) -> DataFrame:
    return drift.select("column", "score").orderBy(F.desc("score"), "column")


def drift_top(drift: DataFrame, limit: int = 10) -> DataFrame:
    return drift.orderBy(F.desc("score"), "column").limit(limit).select("column", "measure", "score", "status")


def equal_bins(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """(period, bin, low, high, n): equal bins over the pooled range of finite values, the last one closed. Infinite
    values are counted apart, in the bins -1 and `bins`, whose ends are infinite."""
    cells = rows.select("period", F.nanvl(value.cast("double"), F.lit(None)).alias("value")).where(F.col("value").isNotNull())
    infinite = F.abs("value") == F.lit(float("inf"))
    finite = F.when(~infinite, F.col("value"))
    lo, hi = cells.agg(F.min(finite), F.max(finite)).first()
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    whole = hi - lo < float("inf")
    width = (hi - lo) / bins if whole else hi / bins - lo / bins
    from_low = (F.col("value") - F.lit(lo)) / F.lit(width) if whole else F.col("value") / F.lit(width) - F.lit(lo / width)
    index = F.floor(from_low) if width > 0 else F.lit(0)
    own = F.when(infinite, F.when(F.col("value") > 0, F.lit(bins)).otherwise(F.lit(-1))).otherwise(F.least(index, F.lit(bins - 1)))
    binned = cells.select("period", own.cast("int").alias("bin"))
    outside = F.when(F.col("bin") < 0, F.lit(float("-inf"))).when(F.col("bin") >= bins, F.lit(float("inf")))
    low = F.lit(lo) + F.col("bin") * F.lit(width) if whole else F.lit(lo) + F.col("bin") * F.lit(width / 2) + F.col("bin") * F.lit(width / 2)
    return binned.groupBy("period", "bin").agg(F.count("*").alias("n")).select(
        "period", "bin", F.coalesce(outside, low).alias("low"), F.coalesce(outside, low + F.lit(width)).alias("high"), "n"
    )


def numeric_histogram(pair: Pair, column: str, bins: int = 35) -> DataFrame:
    return equal_bins(pair.rows, as_number(pair.rows, column), bins)


def probability_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    return equal_bins(scored, as_number(scored, "proba"), bins)


def residual_histogram(scored: DataFrame, bins: int = 35) -> DataFrame:
    return equal_bins(scored, F.col("y_true") - F.col("y_pred"), bins)


def numeric_box(pair: Pair, column: str) -> DataFrame:
    """(period, n, minimum, q1, median, q3, maximum, low_whisker, high_whisker, n_outliers).

    Exact linear quartiles; whiskers end at the last value within 1.5 times the quartile range.
    """
    shares = [0.25, 0.5, 0.75]
    facts = numeric_facts(pair, [column], dict.fromkeys(("ref", "cur"), shares))[0]
    rows = [(name, facts.n[s], *(facts.quantile(s, q) for q in shares)) for s, name in (("ref", REFERENCE), ("cur", CURRENT)) if facts.n[s]]
    stats = local_table(pair.rows.sparkSession, rows, "period string, n long, q1 double, median double, q3 double")  # two rows
    reach = (F.col("q3") - F.col("q1")) * 1.5
    cells = pair.rows.select("period", as_number(pair.rows, column).alias("value")).where(F.col("value").isNotNull())
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        cells.join(F.broadcast(stats), "period")
        .groupBy("period", "n", "q1", "median", "q3")
        .agg(
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
            F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
            F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
            F.sum((~inside).cast("long")).alias("n_outliers"),
        )
    )


def box_extremes(pair: Pair, column: str, key: Sequence[str], limit: int = 20) -> DataFrame:
    """(period, side, place, keys, value): of each period the `limit` rows furthest below the low whisker and above the high
    one, ties by `key`. Each task keeps so many rows of a side before any are moved."""
    box = literal_table(numeric_box(pair, column))  # two rows
    rows = pair.rows.select("period", *[quoted(k) for k in key], as_number(pair.rows, column).alias("value")).where(F.col("value").isNotNull())
    side = F.when(F.col("value") < F.col("low_whisker"), "low").when(F.col("value") > F.col("high_whisker"), "high")
    outside = rows.join(F.broadcast(box.select("period", "low_whisker", "high_whisker")), "period").withColumn("side", side).where("side IS NOT NULL")
    away = F.when(F.col("side") == "low", F.col("value")).otherwise(-F.col("value"))
    place = F.row_number().over(Window.partitionBy("period", "side").orderBy(away, *[quoted(k) for k in key]))
    return outside.withColumn("place", place).where(F.col("place") <= limit).select("period", "side", "place", *[quoted(k) for k in key], "value")


def scatter_points(scored: DataFrame, key: Sequence[str], limit: int = 2000) -> DataFrame:
    """(period, keys, actual, predicted) of `limit` rows of each period: those whose key has the smallest hash, so that the same rows
    are drawn in every run and however the table is cut. Each task keeps so many before any are moved."""
    rows = scored.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    hashed = F.md5(F.concat_ws("|", *[quoted(k).cast("string") for k in key]).cast("binary"))
    place = F.row_number().over(Window.partitionBy("period").orderBy(hashed, *[quoted(k) for k in key]))
    drawn = rows.select("period", *[quoted(k) for k in key], F.col("y_true").alias("actual"), F.col("y_pred").alias("predicted"), place.alias("place"))
    return drawn.where(F.col("place") <= limit).drop("place")


def scatter_grid(scored: DataFrame, cells: int = 50) -> DataFrame:
    """(period, x, y, n): all rows, counted on a grid of `cells` by `cells` over the pooled range of actual and predicted values."""
    rows = scored.select("period", *[F.col(c).cast("double").alias(c) for c in ("y_true", "y_pred")])
    rows = rows.where("abs(y_true) < double('Infinity') AND abs(y_pred) < double('Infinity')")
    low, high = rows.agg(F.min(F.least("y_true", "y_pred")), F.max(F.greatest("y_true", "y_pred"))).first()
    low, high = low or 0.0, high or 0.0
    width = high / cells - low / cells

    def place(name: str) -> Column:
        return (F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(width)), F.lit(cells - 1)) if width > 0 else F.lit(0)).cast("int")

    return rows.groupBy("period", place("y_true").alias("x"), place("y_pred").alias("y")).agg(F.count("*").alias("n"))


def category_top_shares(pair: Pair, column: str, limit: int = 15) -> DataFrame:
    """(value, period, share) over the union of each period's most frequent categories."""
    # the input is scanned once; the counts, one row per category, are read again
    shares = settle(category_shares(pair, [column]), "categories")
    # two top-k selections instead of ranking all categories in one window
    top_ref = shares.where(F.col("n_ref") > 0).orderBy(F.desc("n_ref"), "value").limit(limit).select("value")
    top_cur = shares.where(F.col("n_cur") > 0).orderBy(F.desc("n_cur"), "value").limit(limit).select("value")
    kept = shares.join(F.broadcast(top_ref.union(top_cur).distinct()), "value", "left_semi")
    renamed = kept.select("value", F.col("ref_share").alias("reference"), F.col("cur_share").alias("current"))
    return _long(renamed, ["value"], ["reference", "current"], "period", "share")


def performance_long(performance: DataFrame) -> DataFrame:
    renamed = performance.select("ord", "metric", F.col("before").alias("reference"), F.col("after").alias("current"))
    return _long(renamed, ["ord", "metric"], ["reference", "current"], "period", "value")


def confusion_pivot(matrix: DataFrame, labels: list) -> DataFrame:
    """One row per (period, actual), one column per predicted label."""
    return matrix.groupBy("period", "actual").pivot("predicted", labels).agg(F.sum("n"))


def scatter_bounds(scored: DataFrame) -> DataFrame:
    """(period, low, high): the ends of the diagonal in the actual-against-predicted chart."""
    return scored.groupBy("period").agg(
        F.least(F.min("y_true"), F.min("y_pred")).alias("low"), F.greatest(F.max("y_true"), F.max("y_pred")).alias("high")
    )


def segment_metrics_long(segments: DataFrame, column: str, kind: str) -> DataFrame:
    kept = segments.where((F.col("segment_column") == column) & (F.col("status") != INSUFFICIENT))
    metrics = SEGMENT_METRICS[kind]
    return _long(kept.select("period", "segment_group", *metrics), ["period", "segment_group"], metrics, "metric", "value")


def segment_matrix(segments: DataFrame, column: str, kind: str, groups: list[str] | None = None) -> DataFrame:
    """Metrics by current groups. `groups` names the columns; otherwise they are looked up (<= 30)."""
    current = segment_metrics_long(segments, column, kind).where(F.col("period") == CURRENT)
    return current.groupBy("metric").pivot("segment_group", groups).agg(F.max("value"))


def threshold_long(sweep: DataFrame) -> DataFrame:
    """(threshold, measure, value): rates and error counts of the sweep."""
    parts = []
    names = ["precision", "recall", "f1", "fp", "fn"]
    for name in names:
        parts += [F.lit(name), quoted(name).cast("double")]
    return sweep.select("threshold", F.stack(F.lit(len(names)), *parts).alias("measure", "value"))


def component_scores(components: DataFrame) -> DataFrame:
    return components.where(F.col("score").isNotNull()).select("ord", "component", "score")
