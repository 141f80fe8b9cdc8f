"""Drift, ranks and metrics against plain versions, with the awkward values put in on purpose."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsecheck.functions.ordering import precedes_rank, value_at_rank
from pulsecheck.operators import calibration, charts, drift, performance, segments, surrogate, threshold
from pulsecheck.sources.pairs import pair_from, pair_of
from tests import brute

PERIODS = ("reference", "current")


def frame(spark, columns, schema):
    return spark.createDataFrame(list(zip(*columns)), schema)


@pytest.fixture(params=["8", "64"])
def ranges(spark, request):
    """8 ranges use plain comparisons, 64 the binary search."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def awkward(seed):
    rng = random.Random(seed)
    n = 400
    return {
        "smooth": [rng.gauss(seed, 3) for _ in range(n)],
        "ties": [float(rng.choice([0, 1, 1, 1, 2, 5, 5, 9])) for _ in range(n)],
        "hot": [7.0 if rng.random() < 0.6 else rng.uniform(0, 20) for _ in range(n)],
        "holes": [None if rng.random() < 0.2 else math.nan if rng.random() < 0.2 else rng.random() for _ in range(n)],
        "constant": [4.0] * n,
        "few": [float(i) if i < 19 + seed else None for i in range(n)],
        "empty": [None] * n,
        "zeros": [rng.choice([0.0, -0.0, 1.0]) for _ in range(n)],
    }


SCHEMA = ", ".join(f"{c} double" for c in awkward(0))


def test_numeric_drift_matches_brute_force(spark, ranges):
    ref, cur = awkward(0), awkward(1)
    pair = pair_of(frame(spark, ref.values(), SCHEMA).repartition(7), frame(spark, cur.values(), SCHEMA))
    rows = {r["column"]: r for r in drift.numeric_drift(pair, list(ref)).collect()}
    assert set(rows) == set(ref)
    for name in ref:
        assert rows[name]["score"] == pytest.approx(brute.psi(ref[name], cur[name]), abs=1e-9), name
        assert rows[name]["ks"] == pytest.approx(brute.ks(ref[name], cur[name]), abs=1e-12), name
    assert rows["few"]["score"] == 0.0 and rows["few"]["ks_pvalue"] == 1.0  # 19 values in reference
    assert rows["empty"]["ref_mean"] is None and rows["empty"]["status"] == "stable"
    assert rows["constant"]["score"] == 0.0


def test_twenty_values_are_enough(spark):
    values = [float(i) for i in range(20)]
    shifted = [v + 30 for v in values]
    pair = pair_of(frame(spark, [values], "x double"), frame(spark, [shifted], "x double"))
    row = drift.numeric_drift(pair, ["x"]).first()
    assert row["score"] == pytest.approx(brute.psi(values, shifted)) and row["ks"] == 1.0 and row["status"] == "danger"


def test_text_numbers_are_coerced(spark):
    text = [str(i % 7) if i % 3 else "n/a" for i in range(90)]
    pair = pair_of(frame(spark, [text], "x string"), frame(spark, [text], "x string"))
    found = {r["period"]: r["n_values"] for r in drift.coerce_numeric(pair, ["x"]).collect()}
    assert found == {"reference": 60, "current": 60}


def test_approximate_psi_stays_close(spark):
    ref, cur = awkward(0), awkward(1)
    pair = pair_of(frame(spark, ref.values(), SCHEMA), frame(spark, cur.values(), SCHEMA))
    rough = {r["column"]: r["psi"] for r in drift.psi(pair, ["smooth", "ties"], approximate=True).collect()}
    assert rough["smooth"] == pytest.approx(brute.psi(ref["smooth"], cur["smooth"]), abs=0.05)
    assert set(rough) == {"smooth", "ties"}


def test_identical_and_swapped_tables(spark):
    ref, cur = awkward(0), awkward(3)
    a, b = frame(spark, ref.values(), SCHEMA), frame(spark, cur.values(), SCHEMA)
    names = ["smooth", "ties", "hot"]
    assert all(r["score"] == 0.0 and r["ks"] == 0.0 for r in drift.numeric_drift(pair_of(a, a), names).collect())
    there = {r["column"]: r["ks"] for r in drift.ks_statistic(pair_of(a, b), names).collect()}
    back = {r["column"]: r["ks"] for r in drift.ks_statistic(pair_of(b, a), names).collect()}
    assert there == back
    text = [c.cast("string").alias(n) for n, c in ((n, F.col(n)) for n in names)]
    there = {r["column"]: r["js"] for r in drift.js_divergence(pair_of(a.select(text), b.select(text)), names).collect()}
    back = {r["column"]: r["js"] for r in drift.js_divergence(pair_of(b.select(text), a.select(text)), names).collect()}
    assert there == pytest.approx(back) and there["smooth"] == pytest.approx(1.0)


def test_partitioning_does_not_change_results(spark):
    ref, cur = awkward(0), awkward(1)
    names = ["smooth", "ties", "hot", "holes"]
    results = []
    for parts in (1, 40):
        pair = pair_of(
            frame(spark, ref.values(), SCHEMA).repartition(parts), frame(spark, cur.values(), SCHEMA).repartition(parts, F.rand(parts))
        )
        results.append(sorted(map(tuple, drift.psi_bin_edges(pair, names).collect())))
        results[-1] += sorted(map(tuple, drift.ks_statistic(pair, names).collect()))
    assert results[0] == results[1]


def test_mode_and_js_with_missing(spark):
    pair = pair_of(
        frame(spark, [["b", "a", None, "a", "b"]], "c string"), frame(spark, [["z", None, None, "a", "z"]], "c string")
    )
    row = drift.category_mode(pair, ["c"]).first()
    assert (row["ref_mode"], row["cur_mode"]) == ("a", "(missing)")  # ties go to the smallest text
    p, q = {"a": 0.4, "b": 0.4, "-": 0.2}, {"a": 0.2, "z": 0.4, "-": 0.4}
    expected = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0), q.get(k, 0)
        m = (a + b) / 2
        expected += (0.5 * a * math.log2(a / m) if a else 0) + (0.5 * b * math.log2(b / m) if b else 0)
    assert drift.js_divergence(pair, ["c"]).first()["js"] == pytest.approx(expected)


def test_exact_median(spark):
    ref = awkward(0)
    rows = {r["column"]: r["median"] for r in surrogate.median_values(frame(spark, ref.values(), SCHEMA), list(ref)).collect()}
    for name in ("smooth", "ties", "hot", "few"):
        values = sorted(v for v in ref[name] if v is not None)
        middle = len(values) // 2
        expected = values[middle] if len(values) % 2 else (values[middle - 1] + values[middle]) / 2
        assert rows[name] == pytest.approx(expected)


# --- order ------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "timestamp"])
def test_first_rows_by_rank(spark, kind):
    rng = random.Random(5)
    n = 30_000 if kind == "bigint" else 1_500
    rows = [(rng.choice([None, 3, 3, 3, rng.randrange(10**6)]), i) for i in rng.sample(range(n), n)]
    raw = spark.createDataFrame(rows, "v bigint, id bigint").repartition(5)
    df = raw.withColumn("v", F.timestamp_seconds("v") if kind == "timestamp" else F.col("v").cast(kind))
    as_key = {"string": str, "double": float}.get(kind, int)
    ordered = sorted(rows, key=lambda r: (r[0] is None, as_key(r[0]) if r[0] is not None else 0, r[1]))
    for rank in (0, 1, n // 5, n // 2, int(n * 0.85)):
        chosen = {r["id"] for r in df.where(precedes_rank(df, ["v", "id"], rank)).select("id").collect()}
        assert chosen == {r[1] for r in ordered[:rank]}


def test_tie_at_the_cut_is_an_error(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (2,)], "v int")
    assert df.where(precedes_rank(df, ["v"], 2)).count() == 2
    with pytest.raises(ValueError, match="tie"):
        precedes_rank(df, ["v"], 3)


def test_value_at_rank_with_a_hot_value(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 500_000).otherwise(F.col("id") * 17).alias("v"))
    values = sorted(500_000 if i % 3 == 0 else i * 17 for i in range(60_000))
    for rank in (0, 17, 25_000, 30_000, 59_999):
        text, below, equal = value_at_rank(df, "v", rank)
        assert int(text) == values[rank]
        assert below == sum(v < values[rank] for v in values) and equal == values.count(values[rank])


# --- scores -----------------------------------------------------------------------------------


def score_case(case):
    rng = random.Random(case)
    n = [60, 300, 300, 40][case]
    if case == 0:  # long straight runs
        p = [i / n for i in range(n)]
        return [1 if i > n // 2 else 0 for i in range(n)], p
    if case == 1:  # heavy ties
        return [rng.randrange(2) for _ in range(n)], [rng.choice([0.0, 0.1, 0.5, 0.5, 0.9, 1.0]) for _ in range(n)]
    if case == 2:
        p = [rng.random() for _ in range(n)]
        return [int(rng.random() < v) for v in p], p
    return [i % 2 for i in range(n)], [0.5] * n


@pytest.mark.parametrize("case", range(4))
def test_curves_and_areas(spark, ranges, case):
    y, p = score_case(case)
    flipped = [1 - v for v in y]
    rows = [("reference", a, b) for a, b in zip(y, p)] + [("current", a, b) for a, b in zip(flipped, p)]
    scored = spark.createDataFrame(rows, "period string, y_true int, proba double").repartition(6)
    areas = {r["period"]: r for r in performance.ranked_metrics(scored).collect()}
    roc, pr = performance.roc_curve(scored).collect(), performance.pr_curve(scored).collect()
    for name, truth in zip(PERIODS, (y, flipped)):
        assert areas[name]["roc_auc"] == pytest.approx(brute.auc(truth, p), abs=1e-12)
        assert areas[name]["pr_auc"] == pytest.approx(brute.average_precision(truth, p), abs=1e-12)
        found = sorted(
            ((r["threshold"], r["fpr"], r["tpr"]) for r in roc if r["period"] == name),
            key=lambda r: -math.inf if r[0] is None else -r[0],
        )
        expected = brute.roc(truth, p)
        assert [f[0] for f in found] == [e[0] for e in expected]
        assert [f[1:] for f in found] == [pytest.approx(e[1:]) for e in expected]
        points = {r["threshold"]: (r["recall"], r["precision"]) for r in pr if r["period"] == name}
        assert points.pop(None) == (0.0, 1.0)
        assert points == {s: pytest.approx((tp / sum(truth), tp / (tp + fp))) for s, tp, fp in brute.score_points(truth, p)}


def test_single_class_has_no_area(spark):
    scored = spark.createDataFrame([("reference", 1, 0.2, 1), ("reference", 1, 0.7, 0)], "period string, y_true int, proba double, y_pred int")
    assert performance.roc_auc(scored).first()["roc_auc"] is None
    names = {r["metric"] for r in performance.task_metrics(scored, "binary").collect()}
    assert "roc_auc" not in names and "recall" in names
    assert threshold.threshold_sweep(scored).isEmpty()
    assert calibration.calibration_assessment(scored).isEmpty()


def test_zero_denominators(spark):
    scored = spark.createDataFrame([("reference", 0, 0)] * 3, "period string, y_true int, y_pred int")
    row = performance.binary_metrics(scored).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"], row["fpr"], row["fnr"]) == (1, 0, 0, 0, 0, 0)


def test_macro_metrics(spark):
    rng = random.Random(3)
    y = [rng.choice("abc") for _ in range(90)]
    p = [rng.choice("abd") for _ in range(90)]
    scored = spark.createDataFrame([("current", a, b) for a, b in zip(y, p)], "period string, y_true string, y_pred string")
    row = performance.multiclass_metrics(scored).first()
    found = [row["macro_precision"], row["macro_recall"], row["macro_f1"], row["balanced_accuracy"]]
    assert found == pytest.approx(brute.macro(y, p))
    matrix = performance.confusion_matrix(scored).collect()
    assert len(matrix) == 16 and sum(r["n"] for r in matrix) == 90
    wide = charts.confusion_pivot(performance.confusion_matrix(scored), list("abcd")).collect()
    assert len(wide) == 4


def test_regression_edges(spark):
    rows = [("reference", 2.0, 2.0), ("reference", 2.0, 2.0), ("current", 2.0, 1.0), ("current", 2.0, 3.0)]
    scored = spark.createDataFrame(rows, "period string, y_true double, y_pred double")
    found = {r["period"]: r for r in performance.regression_metrics(scored).collect()}
    assert found["reference"]["r2"] == 1.0 and found["current"]["r2"] == 0.0 and found["current"]["mae"] == 1.0


def test_log_loss_clips(spark):
    rows = [("current", "b", [1.0, 0.0]), ("current", "a", [1.0, 0.0])]
    scored = spark.createDataFrame(rows, "period string, y_true string, probabilities array<double>")
    eps = 2.220446049250313e-16
    assert performance.log_loss(scored, ["a", "b"]).first()["log_loss"] == pytest.approx(-(math.log(eps) + math.log(1 - eps)) / 2)


def test_calibration_bins_close_on_the_right(spark):
    p = [0.0, 0.1, 0.1000001, 0.5, 0.50001, 1.0]
    scored = spark.createDataFrame([("current", 1, v) for v in p], "period string, y_true int, proba double")
    assert {r["bin"]: r["n"] for r in calibration.calibration_curve(scored).collect()} == {0: 2, 1: 1, 4: 1, 5: 1, 9: 1}


def test_threshold_equal_to_a_score(spark):
    scored = spark.createDataFrame([("current", 1, 0.5), ("current", 0, 0.49), ("current", 0, 0.95)], "period string, y_true int, proba double")
    rows = {r["threshold"]: r for r in threshold.threshold_sweep(scored).collect()}
    assert len(rows) == 17
    assert (rows[0.5]["fp"], rows[0.5]["fn"]) == (1, 0) and (rows[0.55]["fp"], rows[0.55]["fn"]) == (1, 1)
    gain = threshold.threshold_improvement(threshold.threshold_sweep(scored), 0.9).first()
    assert gain["best_threshold"] == 0.5 and gain["priority"] == "short_term"


# --- segments ---------------------------------------------------------------------------------


def test_segment_limits(spark):
    rows = []
    for period in PERIODS:
        for i in range(310 if period == "reference" else 300):
            rows.append((period, f"g{i % (31 if period == 'reference' else 30)}", None if i % 5 == 0 else "k", i % 2, (i // 2) % 2))
    df = spark.createDataFrame(rows, "period string, many string, few string, y_true int, y_pred int")
    pair = pair_from(df, ["many", "few"])
    kept = {(r["period"], r["segment_column"]): r["kept"] for r in segments.segment_columns(pair, ["many", "few"]).collect()}
    assert kept == {
        ("reference", "many"): False, ("current", "many"): True, ("reference", "few"): True, ("current", "few"): True,
    }
    found = segments.weak_segments(df, pair, ["many", "few"], "binary").collect()
    assert sum(r["segment_column"] == "many" for r in found) == 30
    assert {r["segment_group"] for r in found if r["segment_column"] == "few"} == {"(missing)", "k"}


def test_segment_sample_sizes(spark):
    def rows(group, positives, negatives):
        return [("current", group, 1, 1)] * positives + [("current", group, 0, 0)] * negatives

    data = rows("n29", 14, 15) + rows("n30", 15, 15) + rows("p9", 9, 40) + rows("p10", 10, 40) + rows("q9", 40, 9)
    df = spark.createDataFrame(data, "period string, g string, y_true int, y_pred int")
    found = {r["segment_group"]: r["status"] for r in segments.weak_segments(df, pair_from(df, ["g"]), ["g"], "binary").collect()}
    assert found == {"n29": "insufficient", "n30": "stable", "p9": "insufficient", "p10": "stable", "q9": "insufficient"}


# --- plans ------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_data_sized_step_on_one_task(spark):
    rows = [("reference", 1, 0.3, 1), ("current", 0, 0.4, 1)]
    scored = spark.createDataFrame(rows, "period string, y_true int, proba double, y_pred int")
    for df in (
        performance.score_ranks(scored),
        performance.roc_curve(scored),
        performance.pr_curve(scored),
    ):
        text = plan(df)
        assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_split_is_a_filter_without_shuffle(spark):
    df = spark.range(5_000).select(F.col("id"), (F.col("id") * 7919 % 5_000).alias("v"))
    text = plan(df.where(precedes_rank(df, ["v", "id"], 3_000)))
    assert "Exchange" not in text and "Window" not in text
