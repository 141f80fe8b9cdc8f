"""The stand-in model: fitted on the first part of the reference, scored on the rest and on current."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.config import CURRENT, MISSING, PERIOD, REFERENCE
from pulsecheck.functions.expressions import as_number, as_text, is_missing, quoted
from pulsecheck.functions.literal import local_table
from pulsecheck.operators.categories import CategoryIndex, category_index
from pulsecheck.operators.columns import Task
from pulsecheck.operators.drift import numeric_facts
from pulsecheck.operators.frequency import category_counts
from pulsecheck.operators.prepare import (
    apply_threshold,
    class_table,
    encode_binary,
    encode_multiclass,
    encode_regression,
    logged_probability,
    refuse_missing,
    unknown_labels,
)
from pulsecheck.operators.split import labels_complete, split_train_holdout
from pulsecheck.sources.pairs import pair_from
from pulsecheck.sources.shared import settle

TREES = 220
CLASSIFIER_DEPTH = 9
REGRESSOR_DEPTH = 10
MIN_LEAF = 4
SEED = 42
MIN_REFERENCE_ROWS = 80
#: Partitions of the rows to fit on, at least (even waves on 2, 3, 4, 6, 8 or 12 cores), and rows of one of them.
FIT_PARTITIONS, FIT_ROWS = 24, 1_000_000
#: Nodes of rows, one for each tree, that a fit keeps between levels (4 bytes each, two copies over all executors); beyond, rows go through
#: the trees anew for every level.
NODE_IDS = 1 << 28
#: Rows up to which each is a unit of the fit; beyond, rows that are equal to the forest are combined, up to rows / FIT_UNITS of them.
FIT_UNITS = 1 << 18
#: Sets of ranges and categories whose answers are broadcast (some 150 bytes each); more are joined by shuffling.
ANSWERS = 1 << 19
#: Ranges of values that a forest tells apart (maxBins).
BINS = 32


# --- imputation -------------------------------------------------------------------------------


def median_values(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median) of the columns that have a number: exact, and without moving the values."""
    pair = pair_from(train.withColumn(PERIOD, F.lit(REFERENCE)), list(columns))
    found = numeric_facts(pair, list(columns), {"ref": [0.5]})
    rows = [(name, facts.quantile("ref", 0.5)) for name, facts in zip(columns, found) if facts.n["ref"]]
    return local_table(train.sparkSession, rows, "column string, median double")


def mode_values(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, n_categories) over the values that are present; on ties the smallest text."""
    pair = pair_from(train.withColumn(PERIOD, F.lit(REFERENCE)), list(columns))
    counts = category_counts(pair, columns, labelled=False).where(F.col("value").isNotNull())
    key = F.struct((-F.col("n_ref")).alias("n"), F.col("value"))
    return counts.groupBy("column").agg(F.min(key)["value"].alias("mode"), F.count("*").alias("n_categories"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(class, n, weight): n_rows / (n_classes * n_class), so that every class weighs the same."""
    counts = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))  # one row
    weight = F.col("rows").cast("double") / (F.col("classes") * F.col("n")).cast("double")
    return counts.join(F.broadcast(total), F.lit(True)).select("class", "n", weight.alias("weight"))


# --- model ------------------------------------------------------------------------------------


@dataclass
class Surrogate:
    """Fitted preparation and forest. `score` adds y_pred and, for classes, probabilities."""

    task: Task
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    categories: CategoryIndex | None = None
    model: PipelineModel | None = None
    cuts: dict[str, list[float]] | None = None  # of the columns' ranges, if rows were combined; else the forest gets the values

    @property
    def keys(self) -> list[str]:
        """What the forest sees of a row."""
        return [*(f"cat_{i}_index" for i in range(len(self.categorical))), *(f"num_{i}" for i in range(len(self.numeric)))]

    def prepare(self, df: DataFrame) -> DataFrame:
        """Adds the filled inputs, and the slots of categories."""
        filled = [F.coalesce(as_number(df, c), F.lit(self.medians[c])).alias(f"num_{i}") for i, c in enumerate(self.numeric)]
        texts = [F.coalesce(as_text(df, c), F.lit(self.modes[c])).alias(f"cat_{i}") for i, c in enumerate(self.categorical)]
        rows = df.select("*", *filled, *texts)
        if self.cuts:
            names = [f"num_{i}" for i in range(len(self.numeric))]
            splits = [[-math.inf, *(self.cuts[c] or [0.0]), math.inf] for c in self.numeric]
            rows = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"{n}_bin" for n in names]).transform(rows)
            # Without the names of the ranges, which the forest would take for categories.
            rows = rows.withColumns({n: F.col(f"{n}_bin") + F.lit(0.0) for n in names}).drop(*[f"{n}_bin" for n in names])
        return self.categories.with_slots(rows) if self.categories else rows

    def _outputs(self) -> list[Column]:
        outputs = [F.col("prediction").alias("model_pred")]
        if self.task.kind != "regression":
            outputs.append(vector_to_array("probability").alias("model_proba"))
        return outputs

    def answers(self, *tables: DataFrame) -> DataFrame | None:
        """What the forest says to each set of ranges and categories of the tables, written once; none if rows were not combined."""
        if self.cuts is None:
            return None
        keys = self.keys
        sets = reduce(DataFrame.union, [self.prepare(df).select(*keys) for df in tables]).distinct()
        # In an order in which neighbours go the same way.
        said = self.model.transform(sets.sortWithinPartitions(*keys))
        return settle(said.select(*[F.col(k).alias(f"__{k}") for k in keys], *self._outputs()), "answers")

    def score(self, df: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        """`answers`: those to several tables of which `df` is one."""
        prepared = self.prepare(df)
        if self.cuts is None:
            return self.model.transform(prepared).select(*[quoted(c) for c in df.columns], *self._outputs())
        # Rows look the answer up. Where answers are too many, large groups of equal rows are split by adaptive execution.
        answers = self.answers(df) if answers is None else answers
        said = F.broadcast(answers) if answers.count() <= ANSWERS else answers
        same = [F.col(k) == F.col(f"__{k}") for k in self.keys]
        return prepared.join(said, same).select(*[quoted(c) for c in df.columns], *[c for c in answers.columns if c.startswith("model_")])


def _assembler(numeric: Sequence[str], categorical: Sequence[str]) -> VectorAssembler:
    if not numeric and not categorical:
        raise ValueError("there are no feature columns to fit a model on")
    inputs = [*(f"num_{i}" for i in range(len(numeric))), *(f"cat_{i}_onehot" for i in range(len(categorical)))]
    return VectorAssembler(inputCols=inputs, outputCol="features")


def _fill_values(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_categories: int | None = None, known: dict[str, float] | None = None
) -> tuple[dict, dict]:
    medians = dict.fromkeys(numeric, 0.0) | (known or {})
    modes = dict.fromkeys(categorical, MISSING)
    if numeric and known is None:
        medians |= {r["column"]: r["median"] for r in median_values(train, numeric).collect()}
    if categorical:
        for row in mode_values(train, categorical).collect():
            if max_categories is not None and row["n_categories"] > max_categories:
                raise ValueError(f"{row['column']} has more than {max_categories} categories; exclude it")
            modes[row["column"]] = row["mode"]
    return medians, modes


def range_cuts(train: DataFrame, columns: Sequence[str]) -> tuple[dict[str, list[float]], dict[str, float]]:
    """Cuts of each column into BINS ranges of equally many values, or between all its values if it has no more than BINS; and
    the medians of columns that have a number. Exact, and without moving the values."""
    pair = pair_from(train.withColumn(PERIOD, F.lit(REFERENCE)), list(columns))
    found = numeric_facts(pair, list(columns), {"ref": [i / BINS for i in range(1, BINS)]})
    medians = {name: facts.quantile("ref", 0.5) for name, facts in zip(columns, found) if facts.n["ref"]}
    number = [as_number(train, c) for c in columns]
    distinct = train.agg(*[F.approx_count_distinct(x, 0.02) for x in number]).first()
    few = [i for i, n in enumerate(distinct) if n <= 1.25 * BINS]
    # At most 1.25 * BINS values by the sketch, which errs by 2 %.
    values = dict(zip(few, train.agg(*[F.array_sort(F.collect_set(number[i])) for i in few]).first())) if few else {}
    cuts = {}
    for i, (name, facts) in enumerate(zip(columns, found)):
        if len(values.get(i, [])) in range(1, BINS + 1):
            between = [(a + b) / 2 for a, b in zip(values[i], values[i][1:])]
            points = [m if a < m <= b else b for a, b, m in zip(values[i], values[i][1:], between)]
        else:
            points = [facts.quantile("ref", i / BINS) for i in range(1, BINS)] if facts.n["ref"] else []
        cuts[name] = sorted({p for p in points if math.isfinite(p)})
    return cuts, medians


def units_of(rows: DataFrame, label: str, keys: Sequence[str], n_rows: int, units: int, by_label: bool) -> DataFrame:
    """(keys, label, n): rows that are equal in `keys`, and in the label if `by_label`, combined to units of at most n_rows / units
    rows each, so that draws of the forest still fall on many of them. A label that is a number becomes the mean of its rows."""
    most = -(-n_rows // units)
    if by_label:
        counted = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    else:
        # Whole numbers add up to the same in any order, so that the mean does not depend on the machine.
        largest = rows.agg(F.max(F.abs(F.col(label)))).first()[0]
        shift = max(min(51 - math.frexp(largest)[1], 1000), -970) if largest and math.isfinite(largest) else 0
        whole = F.rint(F.col(label) * F.lit(2.0**shift)).cast("bigint").cast("decimal(20,0)")
        # A label that is missing or no number stays one, for the forest to refuse.
        sound = F.col(label).isNotNull() & (F.abs(F.col(label)) < math.inf) & ~F.isnan(label)
        odd = F.max(F.when(~sound, F.struct(F.col(label).alias("label"))))
        found = rows.withColumn("__whole", F.when(sound, whole)).groupBy(*keys)
        counted = found.agg(
            F.count("*").alias("n"),
            F.when(odd.isNotNull(), odd["label"]).otherwise(F.sum("__whole").cast("double") / F.count("*") / F.lit(2.0**shift)).alias(label),
        )
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    return counted.select(*keys, label, (F.col("n") / parts).alias("n"), F.explode(F.sequence(F.lit(1), parts)).alias("unit")).drop("unit")


def fit_surrogate(
    train: DataFrame,
    label: str,
    task: Task,
    numeric: Sequence[str],
    categorical: Sequence[str],
    trees: int = TREES,
    seed: int = SEED,
    max_categories: int | None = None,
    units: int = FIT_UNITS,
) -> Surrogate:
    """`label` holds the class index or the number to predict.

    A forest keeps an integer for every slot of a row while it is fitted; `max_categories` makes more categories of a feature an error.

    A forest sees of a number only its range among BINS. Beyond `units` rows, those that agree in all ranges, categories and the class
    are one weighted unit of the fit (see `units_of`): every row counts, but the bootstrap draws units.
    """
    n_rows = train.count()
    combined = n_rows > units
    cuts, found = (range_cuts(train, numeric) if numeric else ({}, None)) if combined else (None, None)
    medians, modes = _fill_values(train, numeric, categorical, max_categories, found)
    assembler = _assembler(numeric, categorical)
    categories = category_index(train, categorical) if categorical else None
    blank = Surrogate(task, list(numeric), list(categorical), medians, modes, categories, cuts=cuts)
    encoders = [categories.encoder(train.sparkSession)] if categorical else []
    rows = blank.prepare(train)
    if combined:
        rows = settle(units_of(rows, label, blank.keys, n_rows, units, task.kind != "regression"), "fit-units")
    n_fitted = rows.count() if combined else n_rows
    # The trees are the same with and without kept nodes. Their ten levels need no checkpoint.
    kept = dict(cacheNodeIds=n_fitted * trees <= NODE_IDS, checkpointInterval=-1)
    common = dict(labelCol=label, numTrees=trees, minInstancesPerNode=MIN_LEAF, seed=seed, **kept)
    if task.kind == "regression":
        forest = RandomForestRegressor(maxDepth=REGRESSOR_DEPTH, featureSubsetStrategy="all", **common)
        if combined:
            forest = forest.setWeightCol("n")
    else:
        weights = class_weights(train, label)
        # one row per class
        rows = rows.join(F.broadcast(weights.select(F.col("class").alias(label), "weight")), label)
        if combined:
            rows = rows.withColumn("weight", F.col("weight") * F.col("n"))
        forest = RandomForestClassifier(
            maxDepth=CLASSIFIER_DEPTH, featureSubsetStrategy="sqrt", weightCol="weight", **common
        )
    # Draws of the forest follow the partitions: their number and order depend on the rows alone, not on the machine. Nothing
    # may come after the sort, or it is optimized away.
    spread = F.xxhash64(*[quoted(c) for c in rows.columns])
    rows = rows.withColumn("__spread", spread).repartition(max(FIT_PARTITIONS, -(-n_fitted // FIT_ROWS)), "__spread")
    if combined:
        # Neighbours go the same way through the trees, to counts that the processor still holds.
        rows = rows.sortWithinPartitions(*blank.keys, label, "n").drop("__spread")
    else:
        rows = rows.sortWithinPartitions("__spread", *[quoted(c) for c in train.columns if isinstance(train.schema[c].dataType, T.AtomicType)]).drop("__spread")
    # The fit asks for its rows five times, and holds more than them itself.
    rows = rows.persist()
    try:
        blank.model = Pipeline(stages=[*encoders, assembler, forest]).fit(rows)
    finally:
        rows.unpersist()
    return blank


# --- scored table -----------------------------------------------------------------------------


@dataclass
class Scored:
    rows: DataFrame  # period, features, y_true, y_pred and proba or probabilities
    classes: list[str]
    has_labels: bool
    source: str
    surrogate: Surrogate


def score_tables(
    reference: DataFrame,
    current: DataFrame,
    target: str,
    task: Task,
    order: Sequence[str],
    numeric: Sequence[str],
    categorical: Sequence[str],
    positive: str | None = None,
    threshold: float = 0.50,
    prediction_column: str | None = None,
    probability_column: str | None = None,
    trees: int = TREES,
    max_categories: int | None = None,
    baseline_prediction_column: str | None = None,
    labelled_only: bool = False,
) -> Scored:
    """Fit on the first 80 % of the reference (in `order`), score its last 20 % and all of current.

    Logged predictions or probabilities replace the model's on current; `baseline_prediction_column` names those of the
    reference's last 20 %, so that one model is compared with itself. `labelled_only`: where current has some labels, but not
    all, the rows that have one are judged instead of none. The scored table is written
    once, because running the forest again for every result would cost far more than reading it.
    """
    if reference.count() < MIN_REFERENCE_ROWS:
        raise ValueError("the reference needs at least 80 rows")
    parts = split_train_holdout(reference, target, order, out="__part")
    if labelled_only and target in current.columns:
        current = current.where(~is_missing(current, target))
    has_labels = target in current.columns and bool(labels_complete(current, target).first()["complete"])
    classes: list[str] = []
    kept = [PERIOD, *numeric, *categorical]
    label = "__label"

    def truth(df: DataFrame, labelled: bool = True) -> DataFrame:
        if not labelled:
            return df.withColumn(label, F.lit(None).cast("double" if task.kind == "regression" else "int"))
        if task.kind == "regression":
            return df.withColumn(label, encode_regression(df, target))
        if task.kind == "binary":
            return df.withColumn(label, encode_binary(df, target, classes[1]))
        return encode_multiclass(df, target, known, label)

    if task.kind == "binary":
        chosen = str(positive) if positive is not None else task.classes[-1]
        classes = [next(c for c in task.classes if c != chosen), chosen]
    elif task.kind == "multiclass":
        known = class_table(reference, target)
        classes = [r["class"] for r in known.orderBy("class_index").collect()]

    # Written once, as the fit reads its rows some ten times: columns that it needs, without the split and what the tables come from.
    train = truth(parts.where(F.col("__part") == "train")).select(*[quoted(c) for c in (*numeric, *categorical)], label)
    train = settle(train, "train")
    if task.kind != "regression" and train.select(label).distinct().count() < 2:
        raise ValueError("the training part of the reference has a single class")
    surrogate = fit_surrogate(train, label, task, numeric, categorical, trees, max_categories=max_categories)

    logged_pred = prediction_column if prediction_column in current.columns else None
    logged_proba = probability_column if task.kind == "binary" and probability_column in current.columns else None
    own_pred = baseline_prediction_column if baseline_prediction_column in reference.columns else None

    def with_logged(df: DataFrame, pred: str | None) -> DataFrame:
        if pred and task.kind != "binary":
            refuse_missing(df, pred, task.kind)
        if pred and task.kind == "multiclass":
            unknown = [r[0] for r in unknown_labels(df, pred, known).collect()]
            if unknown:
                raise ValueError(f"predictions unknown to the reference: {unknown}")
            return encode_multiclass(df, pred, known, "__logged")
        return df

    # Logged outputs are checked before the forest scores their rows, which would be scored for each check as well.
    baseline = with_logged(truth(parts.where(F.col("__part") == "holdout")).withColumn(PERIOD, F.lit(REFERENCE)), own_pred)
    recent = with_logged(truth(current, has_labels).withColumn(PERIOD, F.lit(CURRENT)), logged_pred)
    if logged_proba:
        logged_probability(recent, logged_proba)
    answers = surrogate.answers(baseline, recent)
    baseline, recent = surrogate.score(baseline, answers), surrogate.score(recent, answers)
    source = "surrogate"

    def outputs(df: DataFrame, pred: str | None, proba: str | None) -> DataFrame:
        columns: list[Column] = [F.col(c) if c == PERIOD else quoted(c) for c in kept]
        columns.append(F.col(label).alias("y_true"))
        if task.kind == "regression":
            value = encode_regression(df, pred) if pred else F.col("model_pred")
            return df.select(*columns, value.alias("y_pred"))
        if task.kind == "multiclass":
            value = F.col("__logged") if pred else F.col("model_pred").cast("int")
            return df.select(*columns, value.cast("int").alias("y_pred"), F.col("model_proba").alias("probabilities"))
        p = as_number(df, proba) if proba else F.get("model_proba", F.lit(1))
        value = encode_binary(df, pred, classes[1]) if pred else apply_threshold(p, threshold)
        return df.select(*columns, value.alias("y_pred"), p.alias("proba"))

    if logged_pred:
        source = f"logged:{logged_pred}"
    if logged_proba:
        source += f", probability:{logged_proba}"
    if own_pred:
        source += f", baseline:{own_pred}"
    rows = outputs(baseline, own_pred, None).unionByName(outputs(recent, logged_pred, logged_proba))
    return Scored(settle(rows, "scored"), classes, has_labels, source, surrogate)
