"""Sources, roles, quality, health and the composed check on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsecheck import analyze, analyze_scored, pair_from, pair_of
from pulsecheck.operators import columns, health, prepare, profile, quality, report, split, surrogate
from pulsecheck.sources import csv

KOREAN = "이름,값,지역\n가나다,1,서울\n라마바,2,부산\n"


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp949"])
def test_csv_encodings(spark, tmp_path, encoding):
    df = csv.read_csv(spark, write(tmp_path, "t.csv", KOREAN.encode(encoding)))
    assert df.columns == ["이름", "값", "지역"]
    assert [tuple(r) for r in df.orderBy("값").collect()] == [("가나다", 1, "서울"), ("라마바", 2, "부산")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_csv_types_and_missing(spark, tmp_path):
    text = 'i,d,b,s,hole,q\n1,1.5,True,x,,"a ""b"", c"\nNA,2,false,NaN,null,""\n3,1e3,TRUE,y,,z\n'
    df = csv.read_csv(spark, write(tmp_path, "t.csv", text.encode()))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "hole": "double", "q": "string"}
    rows = [tuple(r) for r in df.collect()]
    assert rows == [(1, 1.5, True, "x", None, 'a "b", c'), (None, 2.0, False, None, None, None), (3, 1000.0, True, "y", None, "z")]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        csv.read_csv(spark, write(tmp_path, "empty.csv", b"a,b\n"))
    with pytest.raises(ValueError, match="neither"):
        csv.read_csv(spark, write(tmp_path, "bad.csv", b"a,b\n\xff\xff,1\n"))


def test_split_rules(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 5 == 0, "soon").otherwise(F.lit("2024-01-01 00:00:00")).alias("t"))
    labelled, warning = split.split_periods(df, ["id"], 0.6, "t")  # exactly 80 % parse
    assert warning is None and labelled.where("period = 'reference'").count() == 120
    worse = df.withColumn("t", F.when(F.col("id") == 1, "soon").otherwise(F.col("t")))
    assert split.split_periods(worse, ["id"], 0.6, "t")[1] == "time_not_parsed"
    assert split.split_periods(df, ["id"])[1] == "no_time_column"
    for ratio in (0.29, 0.86):
        with pytest.raises(ValueError):
            split.split_periods(df, ["id"], ratio)
    with pytest.raises(ValueError):
        split.split_periods(df.limit(99), ["id"])


def test_task_types(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("two"), (F.col("id") % 7).alias("seven"), F.col("id").alias("many"), F.lit(1).alias("one"),
        F.lit(None).cast("int").alias("none"), F.concat(F.lit("t"), F.col("id")).alias("texts"),
    )
    assert columns.infer_task_type(df, "two") == columns.Task("binary", ("0", "1"))
    assert columns.infer_task_type(df, "seven").kind == "multiclass"
    assert columns.infer_task_type(df, "many").kind == "regression"
    for name, override in (("one", "auto"), ("none", "auto"), ("texts", "auto"), ("seven", "binary"), ("two", "multiclass"), ("texts", "regression")):
        with pytest.raises(ValueError):
            columns.infer_task_type(df, name, override)


def test_quality_edges(spark):
    ref = spark.createDataFrame([("a", 1.0, 1, True)] * 8 + [("b", math.nan, None, False)] * 2, "c string, n double, gone int, flag boolean")
    cur = spark.createDataFrame([("a", 1.0, "x", True)] * 5 + [("z", None, "y", None)] * 5, "c string, n double, late string, flag boolean")
    rows = {r["column"]: r for r in quality.quality_table(pair_of(ref, cur), "c").collect()}
    assert list(rows) == ["c", "n", "gone", "flag", "late"]
    assert (rows["c"]["new_categories"], rows["c"]["status"], rows["c"]["is_target"]) == (1, "warning", True)
    assert rows["n"]["ref_missing_rate"] == 0.2 and rows["n"]["status"] == "danger"
    assert rows["gone"]["cur_missing_rate"] is None and rows["gone"]["cur_distinct"] == 0
    assert rows["gone"]["reason"] == rows["late"]["reason"] == "one_sided"
    retyped = quality.quality_table(pair_of(ref, cur.withColumn("n", F.col("n").cast("string")))).where("column = 'n'").first()
    assert retyped["reason"] == "type_changed"


def test_many_categories_are_not_called_new(spark):
    ref = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 101).alias("c"))
    cur = spark.range(1000).select(F.concat(F.lit("c"), F.col("id") % 101).alias("c"))
    assert quality.quality_table(pair_of(ref, cur)).first()["new_categories"] == 0  # 101 > 100


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (math.nan, None), (None, None), (2.0, "a")], "x double, y string")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 2


def test_leakage(spark):
    df = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("y"),
        F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("copy"),
        (F.col("id") % 2 * 3.0 + 1).alias("scaled"),
        F.col("id").alias("free"),
        F.when(F.col("id") < 29, F.col("id") % 2).alias("short"),
    )
    found = {r["column"]: r["reason"] for r in profile.leakage_candidates(df, "y").collect()}
    assert found == {"copy": "equality", "scaled": "correlation"}
    assert profile.leakage_candidates(df, "free").isEmpty()


def test_long_texts_count_as_their_own(spark):
    df = spark.createDataFrame([("x" * 5000,), ("x" * 5000,), ("x" * 4999 + "y",)], "text string")
    assert quality.column_stats(pair_from(df.withColumn("period", F.lit("reference")))).first()["ref_distinct"] == 2


def test_unknown_labels_and_probabilities(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 1.2)], "label string, p double")
    classes = prepare.class_table(df.where("label = 'a'"), "label")
    with pytest.raises(ValueError, match="b"):
        prepare.encode_multiclass(df, "label", classes, "i")
    with pytest.raises(ValueError, match="between 0 and 1"):
        prepare.logged_probability(df, "p")


# --- health -----------------------------------------------------------------------------------


def statuses(spark, values):
    return spark.createDataFrame([(v,) for v in values], "status string")


def test_health_without_labels(spark):
    parts = health.health_components(
        statuses(spark, ["stable", "warning", "danger"]), statuses(spark, ["stable", "warning"]), None, None, None, "binary"
    )
    rows = {r["component"]: r for r in parts.collect()}
    score = health.health_score(parts, 120).first()
    assert rows["quality"]["score"] == 75 and rows["stability"]["score"] == 94
    assert rows["performance"]["state"] == "unavailable"
    assert score["score"] == pytest.approx(round((75 * 0.15 + 94 * 0.25) / 0.40, 1)) and score["confidence"] == "low"


def test_empty_drift_has_no_stability(spark):
    row = health.health_stability(statuses(spark, [])).first()
    assert row["score"] is None
    assert health.health_quality(statuses(spark, [])).first()["score"] == 100


def test_scores_round_half_to_even(spark):
    parts = spark.createDataFrame([("quality", 50.25, 1.0)], "component string, score double, weight double")
    assert health.health_score(parts, 500).first()["score"] == 50.2


def test_quiet_report(spark):
    drift = spark.createDataFrame([("x", 0.01, "stable")], "column string, score double, status string")
    rows = report.findings(drift, None, None, None, "binary").collect()
    assert [(r["finding"], r["severity"]) for r in rows] == [("no_strong_signal", "low")]
    assert [r["ord"] for r in report.actions(drift, None, None, None, "binary").collect()] == [5]


def test_weak_group_order(spark):
    rows = [("current", "c", "a", 50, 0.5, "warning"), ("current", "c", "b", 50, 0.2, "danger"), ("current", "c", "d", 50, 0.3, "danger")]
    table = spark.createDataFrame(rows, "period string, segment_column string, segment_group string, n bigint, recall double, status string")
    assert "c=d" in report.finding_segment(table, "binary").first()["evidence"]
    assert "c=b" in report.finding_segment(table, "binary", worst_first=True).first()["evidence"]


def test_json_records(spark):
    df = spark.createDataFrame([(i, math.nan if i else 0.5) for i in range(30)], "i int, x double")
    row = report.json_records(df, ["i"], 2).first()
    assert row["n"] == 2 and row["records"] == '[{"i":0,"x":0.5},{"i":1,"x":null}]'


# --- the whole check --------------------------------------------------------------------------


def log(spark, seed, rows, drifted):
    """A small labelled table; the drifted one has other inputs, holes and another rule."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        size = rng.gauss(12, 3) + (4 if drifted else 0)
        kind = rng.choices("LMH", [68, 22, 10] if drifted else [45, 35, 20])[0]
        region = rng.choices(["north", "south", "new"], [40, 30, 30] if drifted else [60, 40, 0])[0]
        signal = rng.gauss(0, 1)
        y = int((signal if drifted else -signal) + (kind == "L") + rng.gauss(0, 0.4) > 0.3)
        tier = "low" if signal < -0.5 else "mid" if signal < 0.5 else "top"
        if drifted and kind == "L":
            tier = {"low": "mid", "mid": "top", "top": "low"}[tier]
        value = 100 + 10 * size - 20 * signal + (150 if drifted and region == "new" else 0) + rng.gauss(0, 5)
        data.append((i, size, kind, region, None if drifted and rng.random() < 0.15 else signal, y, tier, value))
    schema = "id bigint, size double, kind string, region string, signal double, y int, tier string, value double"
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def tables(spark):
    return log(spark, 1, 800, False), log(spark, 2, 500, False), log(spark, 3, 500, True)


@pytest.mark.parametrize("target,kind", [("y", "binary"), ("tier", "multiclass"), ("value", "regression")])
def test_worse_data_scores_lower(spark, tables, target, kind):
    reference, normal, drifted = (t.select("id", "size", "kind", "region", "signal", target) for t in tables)
    scores = []
    for current in (normal, drifted):
        result = analyze(reference, current, target, ["id"], excluded=["id"], trees=8)
        assert result.kind == kind and not result.performance.isEmpty()
        assert (result.sweep is not None) == (kind == "binary")
        scores.append(result.score.first()["score"])
    assert 0 <= scores[1] < scores[0] <= 100
    assert result.overview().where("section = 'drift' AND status = 'danger'").count() >= 1
    assert {r["column"]: r for r in result.quality.collect()}["region"]["new_categories"] == 1
    parts = result.profile("current")
    assert parts["summary"].first()["n_rows"] == 500 and parts["duplicates"].first()["duplicate_rows"] == 0
    assert [r["column"] for r in parts["ids"].collect()] == ["id"] and parts["constants"].isEmpty()


def test_without_current_labels(spark, tables, tmp_path):
    reference, normal, _ = tables
    columns_ = ["id", "size", "kind", "region", "signal"]
    result = analyze(reference.select(*columns_, "y"), normal.select(*columns_).limit(120), "y", ["id"], excluded=["id"], trees=5)
    assert result.performance is None and result.segments is None and result.calibration is None
    assert {r["limitation"] for r in result.limitations.collect()} >= {"no_current_labels", "fewer_than_200_current_rows"}
    assert result.score.first()["confidence"] == "low"
    assert len(result.metrics.where("period = 'reference'").collect()) == 8
    written = result.write_csv(str(tmp_path / "out"))
    assert {w.rsplit("/", 1)[1] for w in written} == {"components", "quality", "drift"}
    assert csv.read_csv(spark, written[0]).count() > 0


def test_logged_outputs_replace_the_model(spark, tables):
    reference, normal, _ = (t.select("id", "size", "kind", "y") for t in tables)
    current = normal.withColumn("p", F.lit(0.7)).withColumn("guess", F.col("y"))
    task = columns.infer_task_type(reference, "y")
    args = (reference, current, "y", task, ["id"], ["size"], ["kind"])
    by_prediction = surrogate.score_tables(*args, prediction_column="guess", trees=3)
    wrong = by_prediction.rows.where("period = 'current' AND y_true <> y_pred").count()
    assert wrong == 0 and by_prediction.source == "logged:guess"
    by_probability = surrogate.score_tables(*args, probability_column="p", threshold=0.8, trees=3)
    assert by_probability.rows.where("period = 'current' AND (y_pred <> 0 OR proba <> 0.7)").count() == 0


def test_guards(spark, tables):
    reference, normal, _ = (t.select("id", "size", "y") for t in tables)
    with pytest.raises(ValueError, match="80 rows"):
        analyze(reference.limit(79), normal, "y", ["id"], excluded=["id"], trees=2)
    with pytest.raises(ValueError, match="no feature"):
        analyze(reference, normal.select("id", "y"), "y", ["id"], excluded=["id"], trees=2)
    ordered = reference.orderBy("y").withColumn("id", F.when(F.col("y") == 0, F.col("id")).otherwise(F.col("id") + 10_000))
    mostly = ordered.where("y = 0").union(ordered.where("y = 1").limit(5))
    with pytest.raises(ValueError, match="single class"):
        analyze(mostly, normal, "y", ["id"], task="binary", excluded=["id"], trees=2)


def test_identical_tables_are_healthy(spark, tables):
    reference = tables[0]
    both = reference.withColumn("period", F.lit("reference")).union(reference.withColumn("period", F.lit("current")))
    scored = both.select("period", "kind", F.col("y").alias("y_true"), F.col("y").alias("y_pred"), (F.col("y") * 0.8 + 0.1).alias("proba"))
    result = analyze_scored(scored, pair_from(both.select("period", "size", "kind", "y")), "binary", ["size"], ["kind"], "y")
    parts = {r["component"]: r["score"] for r in result.components.collect()}
    assert parts["performance"] == 100 and parts["stability"] == 100 and parts["quality"] == 100
    assert [r["finding"] for r in result.findings.collect()] == ["no_strong_signal"]
    views = {r["view"]: r["n"] for r in result.json().collect()}
    assert views["drift"] == 2 and views["thresholds"] == 5


def test_exclusions_count_only_columns_near_the_gate(spark, monkeypatch):
    n = 20_000
    names = {"key": "id", "text_id": "concat('t', id)", "near": "concat('n', IF(id < 19000, id, 18999))", "under": "concat('u', IF(id < 18990, id, 0))", "few": "concat('f', id % 5)", "half_id": "id % 10000", "less_id": "id % 9990", "one": "1", "y": "id % 2"}
    df = spark.range(n).selectExpr(*[f"{v} AS {k}" for k, v in names.items()])
    counted, facts = [], columns._facts
    monkeypatch.setattr(columns, "_facts", lambda d, a=None: (counted.append((a, d.columns)), facts(d, a))[1])
    found = {r["column"]: r["reason"] for r in columns.suggested_exclusions(df, "y").collect()}
    assert found == {"key": "id", "text_id": "id", "near": "id", "half_id": "id", "one": "constant"}
    assert [set(c) for a, c in counted if a is None] == [{"near", "under", "half_id", "less_id"}]
    assert columns.excluded_names(df.limit(0), "y") == [r["column"] for r in columns.constant_columns(df.limit(0), ["y"]).collect()]
