"""Slots of categories: the same as a list of labels gives, by ranges, by joins, and with a third of the rows on one value."""

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulsecheck.operators import categories, columns, surrogate


@pytest.fixture(scope="module")
def rows(spark):
    text = "IF(id % 3 = 0, 'hot', IF(id % 50 = 1, NULL, concat(substr('zaQé9 ', 1 + id % 5, 1), id * 7919 % 700)))"
    return spark.range(6000).selectExpr("id", f"{text} AS a", "IF(id % 2 = 0, 'x', 'y') AS b", "CAST(NULL AS STRING) AS c")


@pytest.mark.parametrize("listed,in_range,frequent", [(10_000, 100_000, 1_000), (0, 100_000, 5), (0, 40, 0), (100, 7, 50)])
def test_slots_are_places_in_the_order_of_texts(spark, monkeypatch, rows, listed, in_range, frequent):
    for name, value in (("LISTED", listed), ("IN_RANGE", in_range), ("FREQUENT", frequent)):
        monkeypatch.setattr(categories, name, value)
    train = rows.where("id < 4000")
    index = categories.category_index(train, ["a", "b", "c"])
    known = sorted({r["a"] for r in train.collect()} - {None})
    assert index.sizes == [len(known), 2, 0]
    assert set(index.listed) == ({0, 1} if listed > len(known) else {1} if listed else set())
    texts = rows.select("id", F.coalesce("a", F.lit("?")).alias("cat_0"), F.col("b").alias("cat_1"), F.col("c").alias("cat_2"))
    found = index.encoder(spark).transform(index.with_slots(texts))
    unseen = index.with_slots(texts.limit(1).select("id", *[F.lit("not seen").alias(f"cat_{i}") for i in range(3)])).first()
    assert [unseen[f"cat_{i}_index"] for i in range(3)] == index.sizes
    got = found.select("id", "cat_0", "cat_0_index", "cat_1_index", "cat_2_index", vector_to_array("cat_1_onehot").alias("one"), "cat_0_onehot").collect()
    assert len(got) == 6000
    place = {v: i for i, v in enumerate(known)}
    for r in got:
        slot = place.get(r["cat_0"], len(known))
        assert r["cat_0_index"] == slot and r["cat_1_index"] == r["id"] % 2 and r["cat_2_index"] == 0
        assert r["cat_0_onehot"].size == len(known) and list(r["cat_0_onehot"].indices) == ([slot] if slot < len(known) else [])
        assert r["one"] == [1.0 - r["id"] % 2, float(r["id"] % 2)]


def test_same_slots_as_the_indexer(rows):
    train = rows.where("a IS NOT NULL").select(F.col("a").alias("cat_0"))
    labels = StringIndexer(inputCol="cat_0", outputCol="i", stringOrderType="alphabetAsc").fit(train).labels
    assert categories.category_index(train, ["cat_0"]).listed[0] == list(labels)


def test_many_categories_do_not_go_through_the_driver(spark, monkeypatch):
    seen = []
    for name in ("literal_table", "local_table"):
        kept = getattr(categories, name)
        monkeypatch.setattr(categories, name, lambda *a, kept=kept: (found := kept(*a), seen.append(found.count()))[0])
    df = spark.range(300_000).selectExpr("concat('v', id) AS cat_0")
    index = categories.category_index(df, ["cat_0"])
    assert index.sizes == [300_000] and not index.listed
    found = index.with_slots(df).agg(F.count_distinct("cat_0_index"), F.min("cat_0_index"), F.max("cat_0_index")).first()
    assert tuple(found) == (300_000, 0.0, 299_999.0) and max(seen) <= 1_000
    plan = index.with_slots(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_forest_on_joined_categories(spark, monkeypatch):
    rows = spark.range(900).selectExpr("id", "concat('k', id % 30) AS kind", "IF(id % 30 < 15, 1, 0) AS y")
    task = columns.infer_task_type(rows, "y")
    shares = []
    for listed in (10_000, 0):
        monkeypatch.setattr(categories, "LISTED", listed)
        scored = surrogate.score_tables(rows.where("id < 600"), rows.where("id >= 600"), "y", task, ["id"], [], ["kind"], trees=20).rows
        shares.append(scored.agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double"))).first()[0])
    assert min(shares) > 0.9
