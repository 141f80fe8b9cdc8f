"""Rows that are equal to the forest are fitted as one weighted unit, and scored once."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsecheck.operators import columns, surrogate


@pytest.fixture(scope="module")
def rows(spark):
    x = F.when(F.col("id") % 50 > 0, (F.col("id") * 37 % 101).cast("double"))
    odd = F.col("id") * 7919 % 97 < 12
    kind = F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))
    df = spark.range(6000).select("id", x.alias("x"), (F.col("id") % 4).cast("double").alias("few"), kind.alias("kind"))
    up = F.coalesce(F.col("x"), F.lit(50.0)) + 20 * (F.col("id") % 3) > 60
    return df.withColumn("y", (up != odd).cast("double")).withColumn("v", 3 * F.coalesce("x", F.lit(50.0)) + F.col("id") % 7 / 10)


def fitted(rows, label, kind, units, trees=10):
    task = columns.Task(kind, ["0", "1"]) if kind == "binary" else columns.infer_task_type(rows, label, kind)
    return surrogate.fit_surrogate(rows, label, task, ["x", "few"], ["kind"], trees=trees, units=units)


def test_cuts(spark, rows):
    odd = F.when(F.col("id") % 5 == 0, math.inf).when(F.col("id") % 5 == 1, -math.inf).otherwise(F.col("id") % 3 * 1.0)
    cuts, medians = surrogate.range_cuts(rows.withColumn("odd", odd).withColumn("none", F.lit(None).cast("double")), ["x", "few", "odd", "none"])
    assert len(cuts["x"]) == surrogate.BINS - 1 and cuts["few"] == [0.5, 1.5, 2.5] and cuts["none"] == []
    assert len(cuts["odd"]) == 3 and all(map(math.isfinite, cuts["odd"]))
    assert medians == {r["column"]: r["median"] for r in surrogate.median_values(rows.withColumn("odd", odd), ["x", "few", "odd"]).collect()}


@pytest.mark.parametrize("by_label", [True, False])
def test_units_hold_every_row(rows, by_label):
    label = "y" if by_label else "v"
    keyed = rows.select("kind", "few", label)
    found = surrogate.units_of(keyed, label, ["kind", "few"], 6000, 400, by_label).collect()
    expected, got = defaultdict(list), defaultdict(list)
    for r in keyed.collect():
        expected[r["kind"], r["few"], r[label] if by_label else None].append(r[label])
    for r in found:
        assert r["n"] <= 15
        got[r["kind"], r["few"], r[label] if by_label else None].append((r["n"], r[label]))
    assert got.keys() == expected.keys()
    for key, parts in got.items():
        assert sum(n for n, _ in parts) == pytest.approx(len(expected[key]))
        assert parts[0][1] == pytest.approx(sum(expected[key]) / len(expected[key]), rel=1e-12)


def test_missing_labels_are_not_averaged_away(rows):
    with pytest.raises(Exception, match="(?i)label"):
        fitted(rows.withColumn("v", F.when(F.col("id") != 77, F.col("v"))), "v", "regression", 500, 2)


def test_combined_fit_is_as_good(rows):
    for label, kind in (("y", "binary"), ("v", "regression")):
        errors = []
        for units in (10_000, 1500):
            model = fitted(rows, label, kind, units)
            assert (model.cuts is None) == (units == 10_000)
            scored = model.score(rows)
            assert scored.count() == 6000 and scored.columns[: len(rows.columns)] == rows.columns
            errors.append(scored.agg(F.avg(F.abs(F.col("model_pred") - F.col(label)))).first()[0])
        assert errors[1] <= errors[0] + (0.03 if kind == "binary" else 4.0), errors


def test_combined_fit_does_not_depend_on_partitions(rows):
    found = []
    for parts in (1, 7):
        model = fitted(rows.repartition(parts), "v", "regression", 1500, 5)
        found.append({r["id"]: r["model_pred"] for r in model.score(rows).collect()})
    assert found[0] == found[1]


def test_combined_fit_of_three_classes(rows):
    three = rows.withColumn("c", (F.col("id") % 3).cast("int"))
    model = surrogate.fit_surrogate(three, "c", columns.Task("multiclass", ("0", "1", "2")), ["x", "few"], ["kind"], trees=5, units=1500)
    found = model.score(three)
    off = F.abs(F.aggregate("model_proba", F.lit(0.0), lambda s, p: s + p) - 1.0) > 1e-9
    facts = found.agg(F.count("*").alias("n"), F.sum(off.cast("int")).alias("off"), F.avg((F.col("model_pred") == F.col("c")).cast("int")).alias("right")).first()
    assert (facts["n"], facts["off"]) == (6000, 0) and facts["right"] > 0.99


def test_kept_nodes_give_the_same_trees(rows, monkeypatch):
    for label, kind in (("y", "binary"), ("v", "regression")):
        found = []
        for most in (surrogate.NODE_IDS, 0):
            monkeypatch.setattr(surrogate, "NODE_IDS", most)
            model = fitted(rows, label, kind, 1500, 5)
            forest = model.model.stages[-1]
            assert forest.getOrDefault("cacheNodeIds") == (most > 0) and forest.getNumTrees == 5
            found.append(forest.toDebugString.split("\n", 1)[1])
        monkeypatch.undo()
        assert found[0] == found[1]


def test_fit_reads_rows_that_are_written(spark, rows, monkeypatch):
    """Not the tables and the split again for each of its passes."""
    read = []
    fit = surrogate.fit_surrogate
    monkeypatch.setattr(surrogate, "fit_surrogate", lambda train, *a, **k: read.append((train.columns, train.inputFiles(), train.count())) or fit(train, *a, **k))
    task = columns.Task("binary", ["0", "1"])
    named = rows.withColumn("y", F.col("y").cast("int"))
    got = surrogate.score_tables(named, named, "y", task, ["id"], ["x", "few"], ["kind"], trees=2)
    (names, files, n), = read
    assert names == ["x", "few", "kind", "__label"] and n == 4800
    assert files and all("/train-" in f for f in files)
    assert got.rows.count() == 7200


@pytest.mark.parametrize("kind", ["binary", "regression"])
def test_logged_outputs_are_checked_before_rows_are_scored(rows, monkeypatch, kind):
    order = []
    for of, name in ((surrogate, "logged_probability"), (surrogate, "refuse_missing"), (surrogate.Surrogate, "score")):
        monkeypatch.setattr(of, name, lambda *a, name=name, f=getattr(of, name), **k: order.append(name) or f(*a, **k))
    label = "y" if kind == "binary" else "v"
    task = columns.Task("binary", ["0", "1"]) if kind == "binary" else columns.infer_task_type(rows, label, kind)
    named = rows.where("id < 400").withColumn("y", F.col("y").cast("int")).withColumn("p", F.col("id") / 400)
    logged = dict(probability_column="p") if kind == "binary" else dict(prediction_column="p")
    got = surrogate.score_tables(named, named, label, task, ["id"], ["x"], ["kind"], trees=1, **logged).rows
    assert order == [{"binary": "logged_probability", "regression": "refuse_missing"}[kind], "score", "score"]
    out = "proba" if kind == "binary" else "y_pred"
    assert sorted(r[out] for r in got.where("period = 'current'").collect()) == [i / 400 for i in range(400)]


def test_forest_answers_once_for_all_tables(rows, monkeypatch):
    """What it says is written, and both tables look it up, broadcast or joined."""
    fit, settle, found = surrogate.fit_surrogate, surrogate.settle, []
    named = rows.withColumn("y", F.col("y").cast("int"))
    for most in (surrogate.ANSWERS, 0):
        written = []
        monkeypatch.setattr(surrogate, "ANSWERS", most)
        monkeypatch.setattr(surrogate, "fit_surrogate", lambda *a, **k: fit(*a, **k, units=1500))
        monkeypatch.setattr(surrogate, "settle", lambda df, name: written.append(name) or settle(df, name))
        got = surrogate.score_tables(named, named, "y", columns.Task("binary", ["0", "1"]), ["id"], ["x", "few"], ["kind"], trees=3)
        assert got.surrogate.cuts and written.count("answers") == 1
        found.append(sorted(map(str, got.rows.collect())))
    assert len(found[0]) == 7200 and found[0] == found[1]


def test_fit_holds_its_rows_and_lets_them_go(rows, monkeypatch):
    held, fit = [], surrogate.Pipeline.fit
    monkeypatch.setattr(surrogate.Pipeline, "fit", lambda self, df: held.append((df, df.is_cached)) or fit(self, df))
    fitted(rows, "y", "binary", 1500, 2)
    (df, during), = held
    assert during and not df.storageLevel.useMemory
