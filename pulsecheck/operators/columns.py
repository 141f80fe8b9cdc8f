"""Column roles and the task type."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.config import ID_HINTS, PERIOD, REFERENCE, TARGET_HINTS
from pulsecheck.functions.expressions import as_text, count_where, is_missing, is_numeric, present, quoted, text_literal
from pulsecheck.functions.literal import literal_table, local_table
from pulsecheck.operators.frequency import approximate_stats, column_stats
from pulsecheck.sources.pairs import Pair, pair_from

MAX_CLASSES = 100


@dataclass(frozen=True)
class Task:
    kind: str
    classes: tuple[str, ...] = ()


def feature_columns(pair: Pair, target: str, excluded: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Shared columns but target and exclusions, as (numeric, categorical) by the reference's types."""
    left_out = {*excluded, target, PERIOD}
    shared = [c for c in pair.shared if c not in left_out]
    numeric = [c for c in shared if is_numeric(pair.reference_types[c])]
    return numeric, [c for c in shared if c not in numeric]


# --- task -------------------------------------------------------------------------------------


def task_facts(df: DataFrame, target: str) -> DataFrame:
    """One row: number of target values, of distinct ones, and the task kind they suggest."""
    value = present(df, target)
    facts = df.agg(F.count(value).alias("n_values"), F.count_distinct(value).alias("n_distinct"))
    many = F.greatest(F.lit(20), F.floor(F.col("n_values").cast("double") * F.lit(0.05)).cast("long"))
    numeric = F.lit(is_numeric(df.schema[target].dataType))
    kind = (
        F.when(F.col("n_distinct") < 2, F.lit(None).cast("string"))
        .when(F.col("n_distinct") == 2, "binary")
        .when(numeric & (F.col("n_distinct") > many), "regression")
        .otherwise("multiclass")
    )
    return facts.withColumn("kind", kind)


def infer_task_type(df: DataFrame, target: str, override: str = "auto") -> Task:
    facts = task_facts(df, target).first()
    if facts["n_values"] == 0:
        raise ValueError("the target column has no values")
    if facts["n_distinct"] < 2:
        raise ValueError("the target has a single value, so no model can be fitted or compared")
    kind = facts["kind"] if override == "auto" else override
    if kind == "binary" and facts["n_distinct"] != 2:
        raise ValueError("a binary task needs exactly two target values")
    if kind == "multiclass" and not 3 <= facts["n_distinct"] <= MAX_CLASSES:
        raise ValueError("a multiclass task needs 3 to 100 target values")
    if kind == "regression" and not is_numeric(df.schema[target].dataType):
        raise ValueError("a regression task needs a numeric target")
    if kind == "regression":
        return Task(kind)
    return Task(kind, tuple(r["class"] for r in class_list(df, target).orderBy("class_index").collect()))


def class_list(df: DataFrame, target: str) -> DataFrame:
    """(class, class_index, is_default_positive): distinct values by their text; the last is positive."""
    classes = df.select(present(df, target).cast("string").alias("class")).where(F.col("class").isNotNull()).distinct()
    found = sorted(r[0] for r in classes.limit(MAX_CLASSES + 1).collect())
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    rows = [(name, i, i == len(found) - 1) for i, name in enumerate(found)]
    return local_table(df.sparkSession, rows, "class string, class_index int, is_default_positive boolean")


# --- roles from the values of one table -------------------------------------------------------


def _facts(df: DataFrame, approximate: float | None = None) -> DataFrame:
    """column_stats of one table with positions and type classes: one row per column.

    With `approximate`, a relative error, distinct values are estimated by mergeable sketches and no value is shuffled.
    """
    # the table may have a `period` of its own
    own = "__own_period"
    marked = df.withColumnRenamed(PERIOD, own).withColumn(PERIOD, F.lit(REFERENCE))
    pair = pair_from(marked)
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    kinds = [
        (f.name, i, is_numeric(f.dataType), isinstance(f.dataType, times)) for i, f in enumerate(df.schema.fields)
    ]
    types = local_table(df.sparkSession, kinds, "column string, position int, numeric boolean, time boolean")
    stats = (column_stats(pair) if approximate is None else approximate_stats(pair, None, approximate)).select(
        F.when(F.col("column") == own, PERIOD).otherwise(F.col("column")).alias("column"),
        F.col("ref_rows").alias("n_rows"),
        F.col("ref_missing").alias("n_missing"),
        F.col("ref_distinct").alias("n_distinct"),
    )
    return types.join(F.broadcast(stats), "column", "left").na.fill(0, ["n_rows", "n_missing", "n_distinct"])


def _named_like(hints: Sequence[str]) -> Column:
    return F.lower("column").rlike("|".join(hints))


def target_candidates(df: DataFrame) -> DataFrame:
    """(column, hint, n_distinct): hinted names first, then few values, then by name."""
    facts = _facts(df).select("column", _named_like(TARGET_HINTS).alias("hint"), "n_distinct")
    return facts.orderBy(F.desc("hint"), "n_distinct", "column")


def _is_id() -> Column:
    share = F.col("n_distinct").cast("double") / F.greatest(F.col("n_rows"), F.lit(1)).cast("double")
    filled = F.col("n_rows") > F.col("n_missing")
    return filled & (
        F.col("time") | (~F.col("numeric") & (share >= 0.95)) | (_named_like(ID_HINTS) & (share >= 0.5))
    )


def _is_constant() -> Column:
    return F.col("n_distinct") + F.when(F.col("n_missing") > 0, 1).otherwise(0) <= 1


def _outside(excluded: Sequence[str]) -> Column:
    return ~F.col("column").isin(*excluded) if excluded else F.lit(True)


def id_candidates(df: DataFrame, excluded: Sequence[str] = (), approximate: float | None = None) -> DataFrame:
    facts = _facts(df, approximate).where(_outside(excluded) & _is_id())
    return facts.select("position", "column", "n_distinct", "n_rows").orderBy("position")


def constant_columns(df: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Columns with one value, or with none: told by their least and largest value, without a shuffle of values."""
    names = [c for c in df.columns if c not in excluded]
    if not names:
        return local_table(df.sparkSession, [], "position int, column string, n_distinct bigint, n_missing bigint")
    tests = []
    for i, name in enumerate(names):
        value = as_text(df, name) if not _orderable(df.schema[name].dataType) else present(df, name)
        tests += [
            F.min(value).eqNullSafe(F.max(value)).alias(f"one{i}"),
            F.count(value).alias(f"n{i}"),
            count_where(is_missing(df, name)).alias(f"m{i}"),
        ]
    parts = ", ".join(f"{df.columns.index(c)}, {text_literal(c)}, one{i}, n{i}, m{i}" for i, c in enumerate(names))
    facts = df.agg(*tests).selectExpr(f"STACK({len(names)}, {parts}) AS (position, column, one, n, n_missing)")
    kept = facts.where("(one AND n > 0 AND n_missing = 0) OR n = 0")
    return kept.selectExpr("position", "column", "IF(n > 0, 1L, 0L) AS n_distinct", "n_missing").orderBy("position")


def _orderable(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.AtomicType) and not isinstance(data_type, T.VariantType)


def suggested_exclusions(
    df: DataFrame, target: str, prediction: str | None = None, probability: str | None = None
) -> DataFrame:
    """(rank, column, reason): ids, then constants, then logged outputs; a column appears once."""
    positions = {c: i for i, c in enumerate(df.columns)}
    found = [(c, positions[c], "id") for c in _certain_ids(df, [target])]
    found += [(r["column"], positions[r["column"]] + 1_000_000, "constant") for r in constant_columns(df, [target]).collect()]
    found += [(c, 2_000_000 + i, "logged_output") for i, c in enumerate([prediction, probability]) if c]
    first: dict[str, tuple[int, str]] = {}
    for column, rank, reason in sorted(found, key=lambda f: f[1]):
        first.setdefault(column, (rank, reason))
    rows = [(column, rank, reason) for column, (rank, reason) in first.items()]
    return local_table(df.sparkSession, rows, "column string, rank int, reason string")


#: Relative error of the sketch of distinct values, and how many of them its estimate is allowed to be off.
SKETCH_ERROR, ERRORS = 0.005, 6


def _certain_ids(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Columns that `_is_id` holds for. A sketch decides where all that its estimate allows lies on one side of the gate; only the
    values of the other columns are counted, so that keys and other near-unique columns are not shuffled."""
    names = [c for c in df.columns if c not in excluded]
    if not names:
        return []
    known = literal_table(_facts(df.select(*[quoted(c) for c in names]), SKETCH_ERROR))
    bounds = [known.withColumn("n_distinct", F.col("n_distinct") * (1 + sign * ERRORS * SKETCH_ERROR)) for sign in (-1, 1)]
    surely, perhaps = ({r["column"] for r in b.where(_is_id()).collect()} for b in bounds)
    unsure = [c for c in names if c in perhaps and c not in surely]
    if unsure:
        surely |= {r["column"] for r in _facts(df.select(*[quoted(c) for c in unsure])).where(_is_id()).collect()}
    return [c for c in names if c in surely]


def excluded_names(df: DataFrame, target: str, prediction: str | None = None, probability: str | None = None) -> list[str]:
    return [r["column"] for r in suggested_exclusions(df, target, prediction, probability).collect()]


