"""One table of counts from which all label-based results of a binary model are rolled up.

A cell is (period, segment column and group, label, prediction, place of the score). The rows of the segment columns carry no score, and
the rows over all carry no group, so that the table has some thousand rows, whatever the size of the input, and one scan makes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecheck.config import MAX_SEGMENT_GROUPS
from pulsecheck.functions.expressions import as_category
from pulsecheck.functions.literal import literal_table, local_table
from pulsecheck.functions.ordering import collect_cuts, locate, range_count
from pulsecheck.operators.calibration import assessed
from pulsecheck.operators.performance import BINARY_METRICS, RANKED_METRICS, binary_ratios, metric_rows, ranked_metrics, score_rows
from pulsecheck.operators.segments import ALL, KEYS, judged_binary
from pulsecheck.operators.threshold import THRESHOLDS, swept

#: Places of a score: so many equal ones, and finer ones by powers of two below the first and above the last.
PLACES = 1024
#: The share of rows in one place above which places are too coarse to cut ranges by.
COARSE = 0.25


def score_cells(scored: DataFrame, kept: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(period, segment_column, segment_group, y_true, y_pred, reached, place, n, n_scores, squared), computed once. `kept`: the (period,
    column) whose groups are told apart, each with at most 30 groups.

    `reached` is the number of thresholds that the score reaches; `squared` sums (score - label)^2.
    """
    proba = F.nanvl(F.col("proba").cast("double"), F.lit(None)) if "proba" in scored.columns else F.lit(None).cast("double")
    rows = scored.withColumn("__p", proba)
    rows = locate(rows, F.col("__p"), F.array(*[F.lit(t) for t in THRESHOLDS]), len(THRESHOLDS), "reached")
    end = F.lit(1.0 / PLACES)
    place = (
        F.when(F.col("__p") < end, -F.floor(F.log2(F.greatest(F.col("__p"), F.lit(1e-300)))))
        .when(F.lit(1.0) - F.col("__p") < end, 2000 - F.floor(F.log2(F.greatest(F.lit(1.0) - F.col("__p"), F.lit(1e-300)))))
        .otherwise(4000 + F.floor(F.col("__p") * PLACES))
    )
    nothing = F.lit(None).cast("long")
    parts = [F.lit(ALL), F.lit(ALL), F.when(F.col("__p").isNotNull(), F.col("reached").cast("long")), place.cast("long")]
    for name in sorted({c for _, c in kept}):
        own = F.col("period").isin(*[p for p, c in kept if c == name])
        parts += [F.when(own, F.lit(name)), F.when(own, as_category(scored, name)), nothing, nothing]
    width = len(parts) // 4
    score = F.when(F.col("segment_column") == ALL, F.col("__p"))
    miss = score - F.col("y_true").cast("double")
    long = rows.select("period", "y_true", "y_pred", "__p", F.stack(F.lit(width), *parts).alias("segment_column", "segment_group", "reached", "place"))
    cells = long.where("segment_column IS NOT NULL").groupBy(*KEYS, "y_true", "y_pred", "reached", "place").agg(
        F.count("*").alias("n"), F.count(score).alias("n_scores"), F.sum(miss * miss).alias("squared")
    )
    return literal_table(cells)


def overall(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("segment_column") == ALL)


def _confusion() -> list[Column]:
    actual, predicted = F.col("y_true") == 1, F.col("y_pred") == 1
    zero = F.lit(0).cast("long")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), zero)

    return [
        F.sum("n").alias("n"),
        rows(~actual & ~predicted).alias("tn"),
        rows(~actual & predicted).alias("fp"),
        rows(actual & ~predicted).alias("fn"),
        rows(actual & predicted).alias("tp"),
    ]


def cell_metrics(cells: DataFrame, scored: DataFrame) -> DataFrame:
    """`task_metrics` of a binary model: the counted ones from the cells, the ranked ones from one more scan of `scored`."""
    labelled = overall(cells).where("y_true IS NOT NULL")
    wide = labelled.groupBy("period").agg(*_confusion()).select("period", *binary_ratios())
    names = list(BINARY_METRICS)
    if "proba" in scored.columns:
        wide = wide.join(F.broadcast(ranked_metrics(scored, cell_cuts(cells, scored))), "period", "left")  # one row a period
        names += RANKED_METRICS
    return metric_rows(wide, names).where(F.col("value").isNotNull() | ~F.col("metric").isin(*RANKED_METRICS))


def cell_cuts(cells: DataFrame, scored: DataFrame) -> DataFrame:
    """(period, cuts): scores that cut each period into about equal ranges, from the places of the cells. Where one place holds too many
    rows, a draw of the rows gives the points instead."""
    in_order = Window.partitionBy("period").orderBy("start")
    places = overall(cells).where("place IS NOT NULL AND y_true IS NOT NULL").groupBy("period", "place").agg(F.sum("n").alias("n"))
    power = F.pow(F.lit(2.0), -F.pmod("place", F.lit(2000)).cast("double"))
    start = F.when(F.col("place") >= 4000, (F.col("place") - 4000) / F.lit(float(PLACES))).when(F.col("place") >= 2000, F.lit(1.0) - power * 2).otherwise(power)
    known = places.withColumn("start", start).select(
        "period", "start", "n", F.sum("n").over(in_order).alias("through"), F.sum("n").over(Window.partitionBy("period")).alias("rows")
    )
    found = known.collect()  # places of two periods
    if any(r["n"] > COARSE * r["rows"] for r in found):
        return collect_cuts(score_rows(scored), ["period"], "score", n_keys=2)
    ranges = range_count(scored, 2)
    cuts: dict[str, dict[int, float]] = {r["period"]: {} for r in found}
    for r in found:
        number = (r["through"] - r["n"]) * ranges // r["rows"]
        if number:
            cuts[r["period"]][number] = min(cuts[r["period"]].get(number, r["start"]), r["start"])
    return local_table(scored.sparkSession, [(p, sorted(c.values())) for p, c in cuts.items()], "period string, cuts array<double>")


def cell_segments(cells: DataFrame, min_rows: int) -> DataFrame:
    """`weak_segments` of a binary model."""
    return judged_binary(cells.groupBy(*KEYS).agg(*_confusion()), min_rows)


def cell_assessment(cells: DataFrame) -> DataFrame:
    """`calibration_assessment`."""
    rows = overall(cells)
    current = F.col("period") == "current"
    scored = F.when(F.col("y_true").isNotNull(), F.col("n_scores"))

    def brier(side: Column) -> Column:
        return F.sum(F.when(side, F.col("squared"))) / F.nullif(F.sum(F.when(side, scored)), F.lit(0))

    return assessed(
        rows.agg(
            brier(~current).alias("ref_brier"),
            brier(current).alias("cur_brier"),
            (F.min(F.when(current, F.col("y_true"))) < F.max(F.when(current, F.col("y_true")))).alias("both_classes"),
        )
    )


def cell_sweep(cells: DataFrame) -> DataFrame:
    """`threshold_sweep`."""
    rows = overall(cells).where("period = 'current' AND reached IS NOT NULL")
    positive = F.col("y_true") == 1
    return swept(
        rows.groupBy("reached").agg(
            F.coalesce(F.sum(F.when(positive, F.col("n"))), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(~positive, F.col("n"))), F.lit(0)).alias("neg")
        )
    )


def kept_segments(stats: DataFrame, categorical: Sequence[str]) -> list[tuple[str, str]]:
    """(period, column) with at most 30 groups, missing among them, from `column_stats`."""
    kept = []
    for row in stats.where(F.col("column").isin(*categorical)).collect():
        for period, side in (("reference", "ref"), ("current", "cur")):
            groups = row[f"{side}_distinct"] + (row[f"{side}_missing"] > 0)
            if 0 < groups <= MAX_SEGMENT_GROUPS:
                kept.append((period, row["column"]))
    return sorted(kept)
