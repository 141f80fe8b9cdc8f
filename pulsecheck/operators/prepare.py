"""From raw columns to a scored table: `period, y_true, y_pred, proba` next to the features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsecheck.functions.expressions import as_number, as_text, count_where, quoted
from pulsecheck.functions.literal import local_table
from pulsecheck.operators.columns import MAX_CLASSES


def encode_binary(df: DataFrame, column: str, positive: str) -> Column:
    """1 where the text form equals the positive class, else 0, also for missing and unseen values."""
    return F.coalesce((as_text(df, column) == F.lit(str(positive))).cast("int"), F.lit(0))


def class_table(known: DataFrame, target: str) -> DataFrame:
    """(class, class_index) of the labels in `known`, ascending by text; at most 100 rows."""
    classes = known.select(as_text(known, target).alias("class")).where(F.col("class").isNotNull()).distinct()
    found = [r[0] for r in classes.limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError("more than 100 classes")
    numbered = [(name, i) for i, name in enumerate(sorted(found))]
    return local_table(known.sparkSession, numbered, "class string, class_index int")


def unknown_labels(df: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """Up to five labels, ascending, that `classes` does not have."""
    labels = df.select(as_text(df, column).alias("label")).where(F.col("label").isNotNull()).distinct()
    missing = labels.join(F.broadcast(classes), labels["label"] == classes["class"], "left_anti")
    return missing.orderBy("label").limit(5)


def encode_multiclass(df: DataFrame, column: str, classes: DataFrame, out: str) -> DataFrame:
    """Add `out`, the class index. A label outside `classes` is an error."""
    unknown = [r[0] for r in unknown_labels(df, column, classes).collect()]
    if unknown:
        raise ValueError(f"labels unknown to the reference: {unknown}")
    index = classes.select(F.col("class").alias("__class"), F.col("class_index").alias(out))
    return df.join(F.broadcast(index), as_text(df, column) == F.col("__class"), "left").drop("__class")


def encode_regression(df: DataFrame, column: str) -> Column:
    """Double; text that is no number stops the query."""
    value = as_number(df, column)
    wrong = quoted(column).isNotNull() & value.isNull() & ~quoted(column).cast("string").rlike(r"^\s*[+-]?[nN]a[nN]\s*$")
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"no number in {column}: "), quoted(column).cast("string"))).cast("double")).otherwise(value)


def probability_check(df: DataFrame, column: str) -> DataFrame:
    """One row: values, values outside [0, 1], rows without a value (null, NaN, no number), and whether all are valid."""
    p = as_number(df, column)
    facts = df.agg(F.count(p).alias("n_values"), count_where((p < 0) | (p > 1)).alias("n_outside"), count_where(p.isNull()).alias("n_missing"))
    return facts.withColumn("valid", (F.col("n_outside") == 0) & (F.col("n_missing") == 0))


def logged_probability(df: DataFrame, column: str) -> Column:
    found = probability_check(df, column).first()
    if found["n_outside"]:
        raise ValueError(f"probabilities in {column} must lie between 0 and 1; {found['n_outside']} do not")
    if found["n_missing"]:
        raise ValueError(f"{found['n_missing']} rows have no probability in {column}")
    return as_number(df, column)


def apply_threshold(probability: Column, threshold: float = 0.50) -> Column:
    """1 from the threshold on; 0 below it and for a missing probability (null or NaN)."""
    return F.coalesce(((probability >= F.lit(threshold)) & ~F.isnan(probability)).cast("int"), F.lit(0))


def logged_prediction(df: DataFrame, column: str, kind: str, positive: str | None = None) -> tuple[Column, str]:
    """The logged column as a prediction, and where it comes from.

    A binary label that is missing counts as the negative class; a missing class or number is an error.
    """
    source = f"logged:{column}"
    if kind != "binary":
        refuse_missing(df, column, kind)
    if kind == "regression":
        return encode_regression(df, column), source
    if kind == "binary":
        return encode_binary(df, column, str(positive)), source
    return as_text(df, column), source


def missing_predictions(df: DataFrame, column: str, kind: str = "binary") -> DataFrame:
    """One row: rows, and rows whose logged prediction is missing."""
    value = as_number(df, column) if kind == "regression" else as_text(df, column)
    return df.agg(F.count("*").alias("n_rows"), count_where(value.isNull()).alias("n_missing"))


def refuse_missing(df: DataFrame, column: str, kind: str) -> None:
    missing = missing_predictions(df, column, kind).first()["n_missing"]
    if missing:
        raise ValueError(f"{missing} rows have no prediction in {column}")


def scored_table(
    df: DataFrame,
    kind: str,
    target: str,
    prediction: str | None = None,
    probability: str | None = None,
    positive: str | None = None,
    threshold: float = 0.50,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Logged outputs of both periods as a scored table. Without a prediction column a binary
    prediction is the probability against the threshold."""
    if prediction is None and (kind != "binary" or probability is None):
        raise ValueError("a prediction column is needed, or for binary tasks a probability column")
    truth = {
        "binary": lambda: encode_binary(df, target, str(positive)),
        "multiclass": lambda: as_text(df, target),
        "regression": lambda: encode_regression(df, target),
    }[kind]()
    columns = [quoted("period"), *[quoted(c) for c in keep], truth.alias("y_true")]
    proba = logged_probability(df, probability) if kind == "binary" and probability else None
    predicted = logged_prediction(df, prediction, kind, positive)[0] if prediction else apply_threshold(proba, threshold)
    columns.append(predicted.alias("y_pred"))
    if proba is not None:
        columns.append(proba.alias("proba"))
    return df.select(*columns)
