"""What went wrong outside the fixture in the first round."""

import math

import pytest
from pyspark.sql import functions as F

from pulsecheck import analyze_scored, pair_from, pair_of
from pulsecheck.functions.ordering import precedes_rank
from pulsecheck.operators import calibration, charts, columns, drift, frequency, performance, prepare, profile, quality, split, surrogate, threshold
from pulsecheck.sources import csv
from pulsecheck.sources.shared import drop_settled, settle, shared_dir


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin"])
@pytest.mark.parametrize("ratio", [0.5, 0.6, 0.7])
def test_split_across_a_clock_change(spark, zone, ratio):
    before = spark.conf.get("spark.sql.session.timeZone")
    start = {"America/New_York": 1730608200, "Europe/Berlin": 1729988100}[zone]
    rows = spark.range(240).select("id", F.timestamp_seconds(F.lit(start) + 60 * F.col("id")).alias("t"))
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        labelled, warning = split.split_periods(rows, ["id"], ratio, "t")
        found = sorted(r["id"] for r in labelled.where("period = 'reference'").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert warning is None and found == list(range(int(240 * ratio)))


@pytest.mark.parametrize("kind", ["string", "double", "date", "timestamp_ntz", "decimal(20,3)"])
def test_cut_by_columns_of_every_type(spark, kind):
    value = {"string": "concat('v', lpad(id % 977, 4, '0'))", "double": "id % 977 / 7D", "date": "date_add(DATE '2024-01-01', CAST(id % 977 AS INT))"}
    value = value.get(kind, "CAST(TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id % 977) AS TIMESTAMP_NTZ)" if kind == "timestamp_ntz" else "CAST(id % 977 AS DECIMAL(20, 3))")
    rows = spark.range(3000).select("id", F.expr(value).alias("v"))
    expected = {r["id"] for r in rows.orderBy("v", "id").limit(1234).collect()}
    assert {r["id"] for r in rows.where(precedes_rank(rows, ["v", "id"], 1234)).collect()} == expected


def test_csv_keeps_blanks_and_line_breaks(spark, tmp_path):
    rows = [(1, "a\nb"), (2, " pad "), (3, 'q "x", y'), (4, "plain")]
    path = str(tmp_path / "t")
    csv.write_csv(spark.createDataFrame(rows, "id long, s string"), path)
    assert sorted(map(tuple, csv.read_csv(spark, path, multi_line=True).collect())) == rows
    with pytest.raises(ValueError, match="multi_line"):
        csv.read_csv(spark, path)


def test_hashes_and_values_do_not_merge(spark):
    long = "x" * 100
    rows = [(p, t) for p in ("reference", "current") for t in (long, __import__("hashlib").sha256(long.encode()).hexdigest())]
    stats = frequency.column_stats(pair_from(spark.createDataFrame(rows, "period string, s string"))).first()
    assert (stats["ref_distinct"], stats["cur_distinct"]) == (2, 2)


def test_missing_probabilities(spark):
    rows = [("reference", i % 2, 0.1 + 0.8 * (i % 2)) for i in range(40)] + [("current", i % 2, p) for i, p in enumerate([0.2, 0.9, math.nan, None] * 10)]
    df = spark.createDataFrame(rows, "period string, y_true int, proba double")
    check = prepare.probability_check(df, "proba").first()
    assert (check["n_missing"], check["valid"]) == (20, False)
    with pytest.raises(ValueError, match="20 rows"):
        prepare.logged_probability(df, "proba")
    assert {r[0] for r in df.where("proba IS NULL OR isnan(proba)").select(prepare.apply_threshold(F.col("proba"))).collect()} == {0}
    found = calibration.calibration_assessment(df).first()
    assert not math.isnan(found["brier_delta"]) and found["assessment"] == "no_big_change"
    assert performance.roc_auc(df).where("period = 'current'").first()["roc_auc"] == 1.0
    assert threshold.threshold_sweep(df).where("threshold = 0.5").first()["fp"] == 0


def test_missing_predictions_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None)], "c string, v double")
    for column, kind in (("c", "multiclass"), ("v", "regression")):
        with pytest.raises(ValueError, match="1 rows"):
            prepare.logged_prediction(df, column, kind)


def test_curves_need_labels(spark):
    rows = [("reference", i % 2, (i % 10) / 10, "a") for i in range(60)] + [("current", None, (i % 10) / 10, "a") for i in range(60)]
    df = spark.createDataFrame(rows, "period string, y_true int, proba double, g string").withColumn("y_pred", (F.col("proba") > 0.5).cast("int"))
    assert performance.pr_curve(df).where("period = 'current'").count() == 0
    result = analyze_scored(df, pair_from(df, ["proba", "g"]), "binary", ["proba"], ["g"])
    assert result.roc_curve() is None and result.pr_curve() is None and result.calibration_curve() is None
    assert result.profile("reference")["summary"].first()["n_rows"] == 60


def test_infinities_and_text_numbers(spark):
    rows = [("reference", float(i), "12") for i in range(100)] + [("current", math.inf, "12d") for _ in range(100)]
    pair = pair_from(spark.createDataFrame(rows, "period string, v double, t string"))
    assert drift.drift_table(pair, ["v"], []).first()["ref_mean"] == 49.5
    counts = {(r["period"]): r["n_values"] for r in drift.coerce_numeric(pair, ["t"]).collect()}
    assert counts == {"reference": 100}


def test_a_value_that_looks_like_missing(spark):
    df = spark.createDataFrame([("(missing)",)] * 5 + [("b",)] * 2 + [(None,)] * 9, "c string")
    assert surrogate.mode_values(df, ["c"]).first()["mode"] == "(missing)"


def test_residuals_without_a_number(spark):
    rows = [("reference", float(i), 0.0) for i in range(35)] + [("current", math.nan, 0.0)]
    df = spark.createDataFrame(rows, "period string, y_true double, y_pred double")
    found = charts.residual_histogram(df).collect()
    assert len({r["bin"] for r in found}) == 35 and not any(math.isnan(r["low"]) for r in found)


def test_columns_called_period(spark):
    ref = spark.range(30).select("id", F.lit("x").alias("period"))
    pair = pair_of(ref, ref.withColumn("period", F.lit("y")))
    assert quality.quality_table(pair).where("`column` LIKE 'period%'").first()["new_categories"] == 1


def test_class_list_is_bounded(spark):
    with pytest.raises(ValueError, match="100"):
        columns.class_list(spark.range(101).select(F.col("id").cast("string").alias("c")), "c").count()


def exchanges(df, text):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count(text)


def test_one_exchange_by_range(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "reference").otherwise("current").alias("period"), (F.col("id") % 3 == 0).cast("int").alias("y_true"), (F.col("id") * 7919 % 2000 / 2000.0).alias("proba"))
    assert exchanges(performance.roc_auc(rows), "REPARTITION_BY_COL") == 1


def test_sketches_and_duplicates(spark):
    df = spark.createDataFrame([("reference", i, "a") for i in range(200)] + [("current", i % 10, None) for i in range(200)], "period string, v long, s string")
    found = {r["column"]: r for r in quality.distinct_counts(pair_from(df), approximate=0.05).collect()}
    assert abs(found["v"]["ref_distinct"] - 200) < 30 and found["s"]["cur_distinct"] == 0
    twins = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), (None, "x"), (None, "x"), ("-", "x")], "p string, q string")
    assert profile.duplicate_rows(twins).first()["duplicate_rows"] == 1


def test_settled_tables_can_be_dropped(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert settle(spark.range(5).toDF("id"), "t").count() == 5
    assert drop_settled(spark) > 0 and spark.conf.get("spark.checkpoint.dir", None) == before and shared_dir(spark)
