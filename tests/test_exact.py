"""Values that look alike, infinities, exact p-values, drawn points, and options of the composed analysis."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from pulsecheck import analyze, pair_from, pair_of
from pulsecheck.operators import charts, columns, drift, profile, quality, surrogate


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def test_two_instants_of_a_repeated_hour(spark, new_york):
    at = "timestamp_seconds(IF(id = 0, 1730611800, 1730615400))"
    rows = spark.range(2).selectExpr(f"{at} AS t", f"struct({at} AS t) AS s", f"array({at}) AS a")
    for name in ("t", "s", "a"):
        assert profile.duplicate_rows(rows, [name]).first()["duplicate_rows"] == 0
    pair = pair_of(rows.select("t").limit(2), rows.select("t").unionAll(spark.sql("SELECT timestamp_seconds(1730615460)")))
    found = quality.quality_table(pair).first()
    assert (found["ref_distinct"], found["cur_distinct"], found["new_categories"]) == (2, 3, 1)


def test_whole_numbers_beside_doubles(spark):
    ref = spark.range(4).select((F.lit(1 << 53) + F.col("id")).alias("v"), F.lit(-(1 << 63)).alias("w"))
    cur = spark.range(4).select((F.lit(5.5) + F.col("id")).alias("v"), F.lit(1.0).alias("w"))
    for pair in (pair_of(ref, cur), pair_of(ref, cur).only(["v", "w"])):
        found = {r["column"]: (r["ref_distinct"], r["cur_distinct"]) for r in quality.distinct_counts(pair).collect()}
        assert found == {"v": (4, 4), "w": (1, 1)}
    assert set(pair_of(ref, cur).columns) == {"v", "w"}


def test_histograms_with_infinities(spark):
    rows = [("reference", float(i)) for i in range(100)] + [("current", v) for v in (math.inf, math.inf, -math.inf, math.nan, None)]
    df = spark.createDataFrame(rows, "period string, v double")
    found = sorted((r["period"], r["bin"], r["low"], r["high"], r["n"]) for r in charts.numeric_histogram(pair_from(df), "v", 10).collect())
    assert found[:2] == [("current", -1, -math.inf, -math.inf, 1), ("current", 10, math.inf, math.inf, 2)]
    assert [(b, n) for p, b, _, _, n in found if p == "reference"] == [(i, 10) for i in range(10)] and found[2][2:4] == (0.0, 9.9)
    wide = spark.createDataFrame([("reference", -1.7e308), ("current", 1.7e308)], "period string, v double")
    assert sorted((r["bin"], math.isfinite(r["low"])) for r in charts.numeric_histogram(pair_from(wide), "v", 10).collect()) == [(0, True), (9, True)]
    only = spark.createDataFrame([("reference", math.inf)], "period string, v double")
    assert [r["bin"] for r in charts.numeric_histogram(pair_from(only), "v", 10).collect()] == [10]


def enumerated(ks, n, m):
    hits = total = 0
    for ones in itertools.combinations(range(n + m), n):
        i = most = 0
        for k in range(n + m):
            i += k in ones
            most = max(most, abs(i * m - (k + 1 - i) * n))
        total, hits = total + 1, hits + (most >= round(ks * n * m))
    return hits / total


def test_ks_pvalue_of_small_samples():
    for n, m in [(1, 1), (1, 8), (2, 3), (4, 4), (5, 7), (6, 8), (8, 8)]:
        for most in sorted({abs(i * m - j * n) for i in range(n + 1) for j in range(m + 1)}):
            assert drift.ks_exact(most / (n * m), n, m) == pytest.approx(enumerated(most / (n * m), n, m), rel=1e-12)
    # tabled two-sided critical values of equal samples at 5 %: the least distance whose probability is not above it
    for n, most in [(10, 7), (15, 8), (20, 9), (25, 10)]:
        assert drift.ks_exact(most / n, n, n) <= 0.0501 < drift.ks_exact((most - 1) / n, n, n)
    assert 0 < drift.ks_exact(0.9, 200, 300) < 1e-60


def test_pvalue_is_exact_up_to_ten_thousand_rows(spark):
    table = spark.createDataFrame([("a", 0.3, 30, 40), ("b", 0.3, 19, 40), ("c", 0.02, 10_001, 9_000), ("d", 0.02, 10_000, 9_000)], "column string, ks double, ref_n long, cur_n long")
    found = {r["column"]: r["ks_pvalue"] for r in drift.ks_probability(table).collect()}
    limit = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 0.02**2 * 10_001 * 9_000 / 19_001) for k in range(1, 101))
    assert found["a"] == drift.ks_exact(0.3, 30, 40) and found["b"] == 1.0
    assert found["c"] == pytest.approx(limit, rel=1e-12) and found["d"] == drift.ks_exact(0.02, 10_000, 9_000)


@pytest.mark.parametrize("parts", [1, 40])
def test_drawn_points_and_extremes_do_not_depend_on_partitions(spark, parts):
    rows = spark.range(3000).selectExpr("IF(id % 2 = 0, 'reference', 'current') AS period", "id", "id * 7 % 100 + 0D AS y_true", "id % 50 + 0D AS y_pred", "IF(id % 300 < 2, 1e6, id % 10) AS v")
    rows = rows.repartition(parts)
    points = charts.scatter_points(rows, ["id"], 50).collect()
    import hashlib

    for period, start in (("reference", 0), ("current", 1)):
        want = sorted(range(start, 3000, 2), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:50]
        assert {r["id"] for r in points if r["period"] == period} == set(want)
    assert charts.scatter_grid(rows, 10).agg(F.sum("n")).first()[0] == 3000
    found = charts.box_extremes(pair_from(rows.select("period", "id", "v")), "v", ["id"], 4).collect()
    assert sorted((r["period"], r["side"], r["place"], r["id"]) for r in found) == [
        (p, "high", k + 1, 300 * k + s) for p, s in (("current", 1), ("reference", 0)) for k in range(4)
    ]


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.range(900).selectExpr("id", "id * 37 % 101 / 101D AS size", "concat('k', id % 3) AS kind", "IF(id * 37 % 101 > 50, 1, 0) AS y", "IF(id % 4 = 0, 1, 0) AS guess")
    return rows.where("id < 600"), rows.where("id >= 600")


def test_baseline_predictions_are_used(tables):
    reference, current = tables
    task = columns.infer_task_type(reference, "y")
    found = surrogate.score_tables(reference, current, "y", task, ["id"], ["size"], ["kind"], prediction_column="guess", baseline_prediction_column="guess", trees=3)
    assert found.source == "logged:guess, baseline:guess"
    shares = {r["period"]: r["share"] for r in found.rows.groupBy("period").agg(F.avg("y_pred").alias("share")).collect()}
    assert shares == {"reference": 0.25, "current": 0.25}


def test_labelled_rows_only(tables):
    reference, current = tables
    some = current.withColumn("y", F.when(F.col("id") % 3 > 0, F.col("y")))
    result = analyze(reference, some, "y", ["id"], excluded=["id", "guess"], trees=3)
    assert result.performance is None
    judged = analyze(reference, some, "y", ["id"], excluded=["id", "guess"], trees=3, labelled_only=True)
    assert judged.performance is not None and judged.current_rows == 200


def test_fit_does_not_depend_on_partitions(tables):
    reference, current = tables
    task = columns.infer_task_type(reference, "y")
    found = []
    for parts in (1, 7):
        scored = surrogate.score_tables(reference.repartition(parts), current, "y", task, ["id"], ["size"], ["kind"], trees=5).rows
        found.append(sorted((r["size"], r["proba"]) for r in scored.where("period = 'current'").collect()))
    assert found[0] == found[1]
