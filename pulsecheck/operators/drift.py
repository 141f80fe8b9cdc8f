"""Distribution drift: PSI and Kolmogorov-Smirnov for numbers, Jensen-Shannon for categories."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecheck.config import (
    JS_DANGER,
    JS_WARNING,
    PSI_BINS,
    PSI_DANGER,
    PSI_FLOOR,
    PSI_MIN_VALUES,
    PSI_WARNING,
)
from pulsecheck.functions.expressions import status_of
from pulsecheck.functions.literal import literal_table, local_table
from pulsecheck.functions.ordering import locate
from pulsecheck.functions.selection import Facts, select
from pulsecheck.operators.frequency import SHORT, TEXTUAL, category_counts, column_stats, named, numeric_cells
from pulsecheck.sources.pairs import Pair

DRIFT_SCHEMA = (
    "column string, kind string, measure string, score double, ks double, ks_pvalue double, "
    "ref_mean double, cur_mean double, mean_change double, ref_mode string, cur_mode string, status string"
)


INNER = "IF(SIZE(edges) > 2, SLICE(edges, 2, SIZE(edges) - 2), CAST(ARRAY() AS ARRAY<DOUBLE>))"

# --- numbers ----------------------------------------------------------------------------------


def coerce_numeric(pair: Pair, columns: Sequence[str]) -> DataFrame:
    """Values that are numbers, per column and period, and their mean."""
    counts = numeric_cells(pair, columns).groupBy("column_no", "is_ref").agg(
        F.count("*").alias("n_values"), F.avg("value").alias("mean")
    )
    return counts.selectExpr(named(columns), "IF(is_ref, 'reference', 'current') AS period", "n_values", "mean")


def mean_shift(pair: Pair, columns: Sequence[str]) -> DataFrame:
    means = numeric_cells(pair, columns).groupBy("column_no").agg(
        F.expr("AVG(IF(is_ref, value, NULL)) AS ref_mean"), F.expr("AVG(IF(is_ref, NULL, value)) AS cur_mean")
    )
    return means.selectExpr(named(columns), "ref_mean", "cur_mean", "cur_mean - ref_mean AS mean_change")


def quantile_shares(bins: int) -> list[float]:
    """0, 1/bins, ..., 1 in steps of the double 1/bins; the last one is exactly 1."""
    return [*(i * (1 / bins) for i in range(bins)), 1.0]


def numeric_facts(
    pair: Pair, columns: Sequence[str], shares: dict[str, Sequence[float]], gap: bool = False, edges: Callable[[Facts], Sequence[float]] | None = None
) -> list[Facts]:
    """Rows, sums and quantiles of every column, with the largest gap of both sides if asked for."""

    def cells(numbers: Sequence[int]) -> DataFrame:
        return numeric_cells(pair, [columns[i] for i in numbers])

    def thin() -> DataFrame:
        # drawing rows before they fan out into cells is cheaper than drawing cells
        return numeric_cells(Pair(pair.rows.sample(1 / 64, seed=11), pair.reference_types, pair.current_types), columns)

    return select(cells, thin, len(columns), shares, gap, edges)


def _numeric_summary(pair: Pair, columns: Sequence[str], bins: int) -> DataFrame:
    """One row per column: counts, means, KS D, the deduplicated quantile edges of the reference, the rows of both sides
    in the bins between the inner edges, and the PSI."""
    shares = quantile_shares(bins)
    rows = []

    def edges_of(facts: Facts) -> list[float]:
        # a column without reference values has no edges at all
        return list(dict.fromkeys(facts.quantile("ref", s) for s in shares)) if facts.n["ref"] else []

    for i, facts in enumerate(numeric_facts(pair, columns, {"ref": shares}, True, lambda f: edges_of(f)[1:-1])):
        edges = edges_of(facts)
        enough = min(facts.n.values()) >= PSI_MIN_VALUES
        counts = {}
        for side, total in facts.n.items():
            below = [0, *(facts.below[side, e] for e in edges[1:-1]), total]
            counts[side] = [b - a for a, b in zip(below, below[1:])]
        score = 0.0
        if enough and len(edges) >= 3:
            parts = zip(*([max(c / facts.n[side], PSI_FLOOR) for c in counts[side]] for side in ("ref", "cur")))
            score = sum((cur - ref) * math.log(cur / ref) for ref, cur in parts)
        gap = facts.gap if enough else 0.0
        rows.append((i, columns[i], facts.n["ref"], facts.n["cur"], gap, facts.mean("ref"), facts.mean("cur"), edges, counts["ref"], counts["cur"], score))
    schema = "column_no int, column string, ref_n long, cur_n long, ks double, ref_mean double, cur_mean double, edges array<double>"
    return local_table(pair.rows.sparkSession, rows, f"{schema}, ref_counts array<long>, cur_counts array<long>, psi double")


def approximate_edges(pair: Pair, columns: Sequence[str], bins: int = PSI_BINS, accuracy: int = 100_000) -> DataFrame:
    """(column_no, column, ref_n, cur_n, edges) from a mergeable sketch: one scan, no shuffle of values. Each edge is an actual
    value whose rank is off by at most n / accuracy."""
    shares = ", ".join(f"{s!r}D" for s in quantile_shares(bins))
    sketch = f"PERCENTILE_APPROX(IF(is_ref, value, NULL), ARRAY({shares}), {accuracy})"
    found = numeric_cells(pair, columns).groupBy("column_no").agg(
        F.expr("SUM(IF(is_ref, 1L, 0L)) AS ref_n"),
        F.expr("SUM(IF(is_ref, 0L, 1L)) AS cur_n"),
        F.expr(f"COALESCE(ARRAY_DISTINCT({sketch}), CAST(ARRAY() AS ARRAY<DOUBLE>)) AS edges"),
    )
    return _numbered(pair, columns).join(found, "column_no", "left")


def psi_bin_edges(pair: Pair, columns: Sequence[str], bins: int = PSI_BINS) -> DataFrame:
    """(column, edge_no, edge): exact interpolated quantiles of the reference, repeats removed."""
    summary = _numeric_summary(pair, columns, bins)
    return summary.select("column", F.posexplode("edges").alias("edge_no", "edge"))


def _bucket_counts(pair: Pair, columns: Sequence[str], edges: DataFrame, longest: int) -> DataFrame:
    """(column_no, bucket, ref_count, cur_count) of the bins [a, b) between the inner edges that hold a
    value. Counts combine before the shuffle, so it moves at most #bins rows a task."""
    inner = edges.selectExpr("column_no", f"{INNER} AS inner")
    # #columns rows of at most `longest` doubles
    cells = numeric_cells(pair, columns).join(F.broadcast(inner), "column_no")
    return locate(cells, F.col("value"), F.col("inner"), longest, "bucket").groupBy("column_no", "bucket").agg(
        F.expr("SUM(IF(is_ref, 1L, 0L)) AS ref_count"), F.expr("SUM(IF(is_ref, 0L, 1L)) AS cur_count")
    )


def psi_histogram(pair: Pair, columns: Sequence[str], bins: int = PSI_BINS) -> DataFrame:
    """(column, bucket, ref_count, cur_count, ref_share, cur_share), empty bins included."""
    summary = _numeric_summary(pair, columns, bins)
    counted = summary.select("column", "ref_n", "cur_n", F.posexplode(F.arrays_zip("ref_counts", "cur_counts")).alias("bucket", "counts"))
    return counted.selectExpr(
        "column",
        "bucket",
        "counts.ref_counts AS ref_count",
        "counts.cur_counts AS cur_count",
        "CAST(counts.ref_counts AS DOUBLE) / NULLIF(CAST(ref_n AS DOUBLE), 0D) AS ref_share",
        "CAST(counts.cur_counts AS DOUBLE) / NULLIF(CAST(cur_n AS DOUBLE), 0D) AS cur_share",
    )


def _with_psi(pair: Pair, columns: Sequence[str], summary: DataFrame, bins: int) -> DataFrame:
    usable = f"ref_n >= {PSI_MIN_VALUES} AND cur_n >= {PSI_MIN_VALUES} AND SIZE(edges) >= 3"
    measured = summary.where(usable)
    ref = f"GREATEST(CAST(ref_count AS DOUBLE) / CAST(ref_n AS DOUBLE), {PSI_FLOOR!r}D)"
    cur = f"GREATEST(CAST(cur_count AS DOUBLE) / CAST(cur_n AS DOUBLE), {PSI_FLOOR!r}D)"
    # a bin that both sides leave empty adds (c - r) ln(c / r) = 0, so only filled bins are summed
    scores = (
        _bucket_counts(pair, columns, measured, bins)
        .join(F.broadcast(measured.select("column_no", "ref_n", "cur_n")), "column_no")
        .groupBy("column_no")
        .agg(F.expr(f"SUM(({cur} - {ref}) * LN({cur} / {ref}))").alias("raw_psi"))
    )
    return summary.join(scores, "column_no", "left").withColumn("psi", F.coalesce("raw_psi", F.lit(0.0)))


def psi(pair: Pair, columns: Sequence[str], bins: int = PSI_BINS, approximate: bool = False) -> DataFrame:
    """(column, psi). `approximate` takes the edges from a sketch and shuffles no values."""
    if not approximate:
        return _numeric_summary(pair, columns, bins).select("column", "psi")
    summary = literal_table(approximate_edges(pair, columns, bins))
    return _with_psi(pair, columns, summary, bins).select("column", "psi")


def ks_statistic(pair: Pair, columns: Sequence[str]) -> DataFrame:
    """(column, ref_n, cur_n, ks): the largest gap between the two empirical distributions."""
    return _numeric_summary(pair, columns, PSI_BINS).select("column", "ref_n", "cur_n", "ks")


#: Rows of the larger side up to which the p-value is exact.
EXACT_ROWS = 10_000


def ks_exact(ks: float, n: int, m: int) -> float:
    """The probability that two samples of one distribution, `n` and `m` long and without ties, lie at least `ks` apart.

    All orders of the pooled values are equally likely: lattice paths from (0, 0) to (n, m). A path is followed step by step as
    a walk that draws without replacement, and what reaches the edge of the band for the first time is added up.
    """
    common = math.gcd(n, m)
    up, along = m // common, n // common  # what a step to either side adds to the distance of the shares, in whole units
    edge = round(ks * along * m)
    if edge <= 0:
        return 1.0
    inside, first, out = np.array([1.0]), 0, 0.0  # of the paths still inside, by the steps taken on the first side
    for step in range(n + m):
        taken = np.arange(first, first + len(inside))
        left = n + m - step
        longer = inside * ((n - taken) / left)
        other = inside * ((m - (step - taken)) / left)
        inside = np.concatenate([other, [0.0]])
        inside[1:] += longer
        taken = np.arange(first, first + len(inside))
        away = np.abs(taken * up - (step + 1 - taken) * along) >= edge
        out += inside[away].sum()
        kept = np.flatnonzero(~away & (taken <= n) & (step + 1 - taken <= m))
        if not len(kept):
            break
        first, inside = first + int(kept[0]), inside[kept[0] : kept[-1] + 1]
    return float(min(1.0, out))


def ks_probability(table: DataFrame) -> DataFrame:
    """Adds `ks_pvalue`, two-sided, from `ks`, `ref_n` and `cur_n`: exact where neither side has more than EXACT_ROWS rows, else
    asymptotic, the Kolmogorov series with 100 terms.

    Below 0.2 the series needs more terms, but the value is 1 to twelve digits there.
    """
    n, m = "CAST(ref_n AS DOUBLE)", "CAST(cur_n AS DOUBLE)"
    scaled = f"(ks * SQRT({n} * {m} / ({n} + {m})))"
    term = f"IF(k % 2 = 1, 1.0D, -1.0D) * EXP(-2.0D * k * k * {scaled} * {scaled})"
    series = f"2.0D * AGGREGATE(SEQUENCE(1, 100), 0.0D, (total, k) -> total + {term})"
    few = f"ref_n < {PSI_MIN_VALUES} OR cur_n < {PSI_MIN_VALUES}"
    limit = f"CASE WHEN {few} OR {scaled} < 0.2D THEN 1.0D ELSE GREATEST(0.0D, LEAST(1.0D, {series})) END"
    small = f"NOT ({few}) AND GREATEST(ref_n, cur_n) <= {EXACT_ROWS}"
    # One row a column, so the driver may ask; without a small column no Python is started.
    if table.where(small).isEmpty():
        return table.withColumn("ks_pvalue", F.expr(limit))

    @F.pandas_udf("double")
    def exact(ks: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        sizes = zip(ks, n, m)
        return pd.Series([ks_exact(d, int(a), int(b)) if PSI_MIN_VALUES <= min(a, b) and max(a, b) <= EXACT_ROWS else None for d, a, b in sizes], dtype=float)

    counted = table.withColumn("__exact", exact("ks", "ref_n", "cur_n"))
    return counted.withColumn("ks_pvalue", F.expr(f"IF({small}, __exact, {limit})")).drop("__exact")


def ks_pvalue(pair: Pair, columns: Sequence[str]) -> DataFrame:
    return ks_probability(ks_statistic(pair, columns)).select("column", "ks", "ks_pvalue")


def numeric_drift(pair: Pair, columns: Sequence[str], bins: int = PSI_BINS) -> DataFrame:
    return ks_probability(_numeric_summary(pair, columns, bins)).select(
        "column",
        F.lit("numeric").alias("kind"),
        F.lit("psi").alias("measure"),
        F.col("psi").alias("score"),
        "ks",
        "ks_pvalue",
        "ref_mean",
        "cur_mean",
        (F.col("cur_mean") - F.col("ref_mean")).alias("mean_change"),
        status_of(F.col("psi"), PSI_WARNING, PSI_DANGER).alias("status"),
    )


def _numbered(pair: Pair, columns: Sequence[str]) -> DataFrame:
    """(column_no, column): the numbers that the cells carry."""
    return local_table(pair.rows.sparkSession, list(enumerate(columns)), "column_no int, column string")


# --- categories -------------------------------------------------------------------------------


def category_shares(pair: Pair, columns: Sequence[str]) -> DataFrame:
    """(column, value, n_ref, n_cur, ref_share, cur_share) over the union of both sides."""
    counts = category_counts(pair, columns)
    totals = counts.groupBy("column").agg(F.sum("n_ref").alias("ref_n"), F.sum("n_cur").alias("cur_n"))
    return counts.join(F.broadcast(totals), "column").select(
        "column",
        "value",
        "n_ref",
        "n_cur",
        F.when(F.col("ref_n") > 0, F.col("n_ref").cast("double") / F.col("ref_n").cast("double")).alias("ref_share"),
        F.when(F.col("cur_n") > 0, F.col("n_cur").cast("double") / F.col("cur_n").cast("double")).alias("cur_share"),
    )


def _js_terms() -> Column:
    p, q = F.col("ref_share"), F.col("cur_share")
    middle = (p + q) / F.lit(2.0)

    def half(share: Column) -> Column:
        return F.when(share > 0, F.lit(0.5) * share * F.log2(share / middle)).otherwise(F.lit(0.0))

    return half(p) + half(q)


def _mode(side: str) -> Column:
    """Most frequent value of one side; on ties the smallest one."""
    count = F.col(f"n_{side}")
    key = F.when(count > 0, F.struct((-count).alias("n"), F.col("value")))
    return F.min(key)["value"]


def js_divergence(pair: Pair, columns: Sequence[str]) -> DataFrame:
    return category_shares(pair, columns).groupBy("column").agg(F.sum(_js_terms()).alias("js"))


def category_mode(pair: Pair, columns: Sequence[str]) -> DataFrame:
    return category_counts(pair, columns).groupBy("column").agg(
        _mode("ref").alias("ref_mode"), _mode("cur").alias("cur_mode")
    )


def categorical_drift(pair: Pair, columns: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """`stats`: `column_stats` of these columns, if they are at hand; columns that they do not cover are counted here."""
    covered = textual_columns(pair, columns)
    if stats is None:
        stats = literal_table(column_stats(pair, covered, covered)) if covered else None  # a row a column
    parts = []
    if covered:
        long = [r["column"] for r in stats.where(f"GREATEST(LENGTH(ref_mode), LENGTH(cur_mode)) > {SHORT}").select("column").collect()]
        known = stats.where(F.col("column").isin(*covered)).select("column", F.col("js").alias("score"), "ref_mode", "cur_mode")
        if long:  # these stand for themselves by their hash
            known = known.drop("ref_mode", "cur_mode").join(category_mode(pair, covered), "column")
        parts.append(known)
    rest = [c for c in columns if c not in covered]
    if rest:
        counted = category_shares(pair, rest).groupBy("column")
        parts.append(counted.agg(F.sum(_js_terms()).alias("score"), _mode("ref").alias("ref_mode"), _mode("cur").alias("cur_mode")))
    found = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    return found.select(
        "column",
        F.lit("categorical").alias("kind"),
        F.lit("js").alias("measure"),
        "score",
        "ref_mode",
        "cur_mode",
        status_of(F.col("score"), JS_WARNING, JS_DANGER).alias("status"),
    )


def textual_columns(pair: Pair, columns: Sequence[str]) -> list[str]:
    """Those of which `column_stats` gives divergence and modes."""
    return [c for c in columns if isinstance(pair.rows.schema[c].dataType, TEXTUAL)]


# --- both -------------------------------------------------------------------------------------


def drift_table(pair: Pair, numeric: Sequence[str], categorical: Sequence[str], bins: int = PSI_BINS, stats: DataFrame | None = None) -> DataFrame:
    """All features, highest score first; equal scores by column name. `stats`: see `categorical_drift`."""
    return joined_drift(pair, numeric_drift(pair, numeric, bins) if numeric else None, categorical, stats)


def joined_drift(pair: Pair, numeric: DataFrame | None, categorical: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """`drift_table` from the rows of the numeric columns."""
    table = local_table(pair.rows.sparkSession, [], DRIFT_SCHEMA)
    if numeric is not None:
        table = table.unionByName(numeric, allowMissingColumns=True)
    if categorical:
        table = table.unionByName(categorical_drift(pair, categorical, stats), allowMissingColumns=True)
    return table.orderBy(F.desc("score"), "column")
