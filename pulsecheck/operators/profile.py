"""Profile of one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.functions.expressions import as_category, as_number, as_text, is_missing, is_numeric, present
from pulsecheck.operators.columns import constant_columns, id_candidates

ZONED = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
MIN_COMPARABLE = 30
LEAK_LIMIT = 0.98


def profile_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns by kind, missing cells. One scan, one partial aggregate."""
    numeric = sum(is_numeric(f.dataType) for f in df.schema.fields)
    per_row = F.lit(0).cast("long")
    for name in df.columns:
        per_row = per_row + is_missing(df, name).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(per_row), F.lit(0)).alias("missing_cells")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(numeric).alias("n_numeric"),
        F.lit(len(df.columns) - numeric).alias("n_categorical"),
        "missing_cells",
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, and rows beyond the first of each identical group (missing equals missing).

    Rows are told apart by the SHA-256 of their cells, each with its length in front, so that what is shuffled does
    not depend on how wide a row is; copies combine before that.
    """
    cells = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType
        value = present(df, name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0)  # one zero
        if isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)  # not as text in the session's zone, where two instants can look the same
        text = value.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(F.struct(value), ZONED)
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    groups = df.groupBy(F.sha2(F.concat(*cells), 256).alias("row")).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")
    )


def _equal(df: DataFrame, name: str, target: str) -> Column:
    if is_numeric(df.schema[name].dataType) and is_numeric(df.schema[target].dataType):
        return as_number(df, name) == as_number(df, target)
    return as_text(df, name) == as_text(df, target)


def leakage_evidence(df: DataFrame, target: str) -> DataFrame:
    """(column, n_comparable, equality, correlation) of every column against a two-valued target.

    All columns in one aggregate; empty unless the target has exactly two values.
    """
    schema = "column string, n_comparable bigint, equality double, correlation double"
    ends = df.agg(
        F.count_distinct(present(df, target)).alias("n"), F.min(as_text(df, target)).alias("low")
    ).first()
    names = [c for c in df.columns if c != target]
    if ends["n"] != 2 or not names:
        return df.sparkSession.createDataFrame([], schema)
    low = as_text(df, target) == F.lit(ends["low"])
    y01 = F.when(low, F.lit(0.0)).when(~low, F.lit(1.0))
    tests = []
    for i, name in enumerate(names):
        both = ~is_missing(df, name) & ~is_missing(df, target)
        tests += [
            F.coalesce(F.sum(both.cast("long")), F.lit(0)).alias(f"n{i}"),
            F.avg(F.when(both, _equal(df, name, target).cast("double"))).alias(f"e{i}"),
        ]
        if is_numeric(df.schema[name].dataType):
            tests.append(F.corr(as_number(df, name), y01).alias(f"c{i}"))
        else:
            tests.append(F.max(F.lit(None).cast("double")).alias(f"c{i}"))
    parts = [part for i, c in enumerate(names) for part in (F.lit(c), F.col(f"n{i}"), F.col(f"e{i}"), F.col(f"c{i}"))]
    wide = df.agg(*tests)
    return wide.select(F.stack(F.lit(len(names)), *parts).alias("column", "n_comparable", "equality", "correlation"))


def leakage_candidates(df: DataFrame, target: str) -> DataFrame:
    """(column, reason, strength): equal to the target, or else nearly collinear with it."""
    strength = F.abs(F.nanvl("correlation", F.lit(None).cast("double")))
    found = leakage_evidence(df, target).where(F.col("n_comparable") >= MIN_COMPARABLE)
    reason = F.when(F.col("equality") >= LEAK_LIMIT, "equality").when(strength >= LEAK_LIMIT, "correlation")
    return (
        found.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("column", "reason", F.when(F.col("reason") == "equality", F.col("equality")).otherwise(strength).alias("strength"))
    )


def profile_data(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """All parts of the profile, each a table of its own."""
    excluded = [target] if target else []
    parts = {
        "summary": profile_summary(df),
        "duplicates": duplicate_rows(df),
        "ids": id_candidates(df, excluded),
        "constants": constant_columns(df, excluded),
    }
    if target:
        parts["leakage"] = leakage_candidates(df, target)
        parts["target"] = target_distribution(df, target)
    return parts


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(as_category(df, target).alias("value")).agg(F.count("*").alias("n"))
