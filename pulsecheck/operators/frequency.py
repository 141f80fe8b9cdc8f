"""Value counts of many columns in one shuffle: the base of profile, quality and categorical drift."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.config import MISSING
from pulsecheck.functions.expressions import category_sql, missing_sql, number_sql, present_sql, quote, text_literal, text_sql
from pulsecheck.sources.pairs import Pair, exact_name

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)


IS_REF = "period = 'reference' AS is_ref"
SIDES = ("SUM(IF(is_ref, 1L, 0L)) AS n_ref", "SUM(IF(is_ref, 0L, 1L)) AS n_cur")


#: Texts of up to so many bytes stand for themselves when they are counted; a SHA-256 in hexadecimal is longer.
SHORT = 40
#: Types whose text tells their values apart.
TEXTUAL = (T.StringType, T.BooleanType, T.DateType)


def _identity(df: DataFrame, name: str, as_text: bool = False) -> str:
    """SQL of (text, num, whole): one of them carries the value without a costly cast to text.

    Long texts are carried as their SHA-256, so that whole documents are not shuffled just to be counted. `as_text`: as
    text, though another form would do.
    """
    data_type = df.schema[name].dataType
    value = present_sql(df, name)
    text, num, whole = "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS BIGINT)"
    if as_text:
        text = _short(f"CAST({value} AS STRING)")
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        num = f"CAST({value} AS DOUBLE) + 0.0D"
        if exact_name(name) in df.columns:
            text = quote(exact_name(name))
            num = f"IF({text} IS NULL, {num}, NULL)"
    elif isinstance(data_type, T.DateType):
        whole = f"CAST(UNIX_DATE({value}) AS BIGINT)"
    elif isinstance(data_type, T.TimestampType):
        # as text in the session's zone, the two instants of a repeated clock hour look the same
        whole = f"UNIX_MICROS({value})"
    elif isinstance(data_type, WHOLE):
        whole = f"CAST({value} AS BIGINT)"
    else:
        text = _short(f"CAST({value} AS STRING)")
    return f"{text}, {num}, {whole}"


def _short(text: str) -> str:
    return f"IF(OCTET_LENGTH({text}) <= {SHORT}, {text}, SHA2({text}, 256))"


def stacked(columns: Sequence[str], cells: Sequence[str], names: str) -> str:
    """SQL generator: one output row per column, led by its number. Numbers instead of names keep the
    shuffled rows short; `named` puts the names back afterwards."""
    parts = ", ".join(f"{i}, {cell}" for i, cell in enumerate(cells))
    return f"STACK({len(columns)}, {parts}) AS ({names})"


def named(columns: Sequence[str]) -> str:
    """SQL: the name for the column number `column_no`."""
    return f"ELEMENT_AT(ARRAY({', '.join(map(text_literal, columns))}), column_no + 1) AS column"


def distinct_values(pair: Pair, columns: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """(column_no, text, num, whole, n_ref, n_cur), one row per distinct value; missing is a value. `texts`: columns to be
    carried as text."""
    cells = [_identity(pair.rows, c, c in texts) for c in columns]
    long = pair.rows.selectExpr(IS_REF, stacked(columns, cells, "column_no, text, num, whole"))
    return long.groupBy("column_no", "text", "num", "whole").agg(*map(F.expr, SIDES))


def column_stats(pair: Pair, columns: Sequence[str] | None = None, categorical: Sequence[str] = ()) -> DataFrame:
    """Per column and period: rows, missing cells, distinct values; and the values only current has.

    From the same counts, for the columns in `categorical` (of TEXTUAL types): `js`, the divergence of both sides' shares in
    bits, and `ref_mode` and `cur_mode`, the most frequent categories (a long one as its SHA-256); missing is a category.
    """
    columns = list(columns or pair.columns)
    missing = "text IS NULL AND num IS NULL AND whole IS NULL"
    figures = [
        "SUM(n_ref) AS ref_rows",
        "SUM(n_cur) AS cur_rows",
        f"SUM(IF({missing}, n_ref, 0L)) AS ref_missing",
        f"SUM(IF({missing}, n_cur, 0L)) AS cur_missing",
        f"SUM(IF(NOT ({missing}) AND n_ref > 0, 1L, 0L)) AS ref_distinct",
        f"SUM(IF(NOT ({missing}) AND n_cur > 0, 1L, 0L)) AS cur_distinct",
        f"SUM(IF(NOT ({missing}) AND n_ref = 0 AND n_cur > 0, 1L, 0L)) AS new_values",
    ]
    values = distinct_values(pair, columns, categorical)
    if not categorical:
        totals = values.groupBy("column_no").agg(*map(F.expr, figures))
        return totals.selectExpr(named(columns), *[c for c in totals.columns if c != "column_no"])
    # One row a column; the counts come from the same exchange.
    rows = values.groupBy("column_no").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))
    label = text_literal(MISSING)
    # A value that reads like the label of the missing ones is one category with them.
    labelled = f"(text IS NULL OR text = {label})"
    figures += [
        f"SUM(IF({labelled}, 0D, {divergence('n_ref', 'n_cur')})) AS js",
        *[f"SUM(IF({labelled}, n_{s}, 0L)) AS label_{s}" for s in ("ref", "cur")],
        *[f"MIN(IF({labelled} OR n_{s} = 0, NULL, STRUCT(-n_{s} AS n, text AS value))) AS first_{s}" for s in ("ref", "cur")],
        "MAX(all_ref) AS all_ref",
        "MAX(all_cur) AS all_cur",
    ]
    totals = values.join(F.broadcast(rows), "column_no").groupBy("column_no").agg(*map(F.expr, figures))
    is_category = f"column_no IN ({', '.join(str(columns.index(c)) for c in categorical)})"
    modes = [
        f"IF({is_category}, LEAST(first_{s}, IF(label_{s} > 0, STRUCT(-label_{s} AS n, {label} AS value), NULL)).value, NULL) AS {s}_mode" for s in ("ref", "cur")
    ]
    kept = [f.split(" AS ")[-1] for f in figures[:7]]
    return totals.selectExpr(named(columns), *kept, f"IF({is_category}, js + {divergence('label_ref', 'label_cur')}, NULL) AS js", *modes)


def divergence(ref: str, cur: str) -> str:
    """SQL: what one category of `ref` and `cur` rows, of `all_ref` and `all_cur`, adds to the Jensen-Shannon divergence in bits."""
    p, q = (f"(CAST({n} AS DOUBLE) / NULLIF(CAST({total} AS DOUBLE), 0D))" for n, total in ((ref, "all_ref"), (cur, "all_cur")))
    middle = f"(({p} + {q}) / 2.0D)"
    halves = [f"CASE WHEN {n} > 0 AND all_ref > 0 AND all_cur > 0 THEN 0.5D * {x} * LOG2({x} / {middle}) WHEN all_ref > 0 AND all_cur > 0 THEN 0.0D END" for n, x in ((ref, p), (cur, q))]
    return f"({halves[0]} + {halves[1]})"


def cell_stats(pair: Pair, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column and period: rows and missing cells. One aggregate row a task, whatever the values."""
    columns = list(columns or pair.columns)
    counts = [F.sum(F.expr(f"IF({missing_sql(pair.rows, c)}, 1L, 0L)")).alias(f"m{i}") for i, c in enumerate(columns)]
    per_period = pair.rows.selectExpr("*", IS_REF).groupBy("is_ref").agg(F.count("*").alias("n"), *counts)
    long = per_period.selectExpr("is_ref", "n", stacked(columns, [f"m{i}" for i in range(len(columns))], "column_no, missing"))
    sides = [
        F.coalesce(F.sum(F.when(F.col("is_ref") == side, F.col(value))), F.lit(0)).alias(f"{name}_{what}")
        for what, value in (("rows", "n"), ("missing", "missing"))
        for name, side in (("ref", True), ("cur", False))
    ]
    return long.groupBy("column_no").agg(*sides).selectExpr(named(columns), "ref_rows", "cur_rows", "ref_missing", "cur_missing")


def approximate_stats(pair: Pair, columns: Sequence[str] | None = None, error: float = 0.02) -> DataFrame:
    """`cell_stats` with estimated distinct values of each period (`ref_distinct`, `cur_distinct`)."""
    columns = list(columns or pair.columns)
    # a sketch of 2^bits places errs by 0.83 / sqrt(2^bits)
    bits = min(21, max(4, math.ceil(2 * math.log2(0.83 / error))))
    estimates = []
    for i, c in enumerate(columns):
        value = f"CAST({present_sql(pair.rows, c)} AS STRING)"
        for name, side in (("ref", "is_ref"), ("cur", "NOT is_ref")):
            sketch = F.hll_sketch_agg(F.expr(f"IF({side}, {value}, NULL)"), F.lit(bits))
            estimates.append(F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).alias(f"{name}{i}"))
    wide = pair.rows.selectExpr("*", IS_REF).agg(*estimates)
    parts = stacked(columns, [f"ref{i}, cur{i}" for i in range(len(columns))], "column_no, ref_distinct, cur_distinct")
    found = wide.selectExpr(parts).selectExpr(named(columns), "ref_distinct", "cur_distinct")
    return cell_stats(pair, columns).join(F.broadcast(found), "column")


def category_counts(pair: Pair, columns: Sequence[str], labelled: bool = True) -> DataFrame:
    """(column, value, n_ref, n_cur) of categorical columns, missing as its own category: under its label, or, if not
    `labelled`, as null, which no value can be mistaken for."""
    cells = [category_sql(pair.rows, c) if labelled else text_sql(pair.rows, c) for c in columns]
    long = pair.rows.selectExpr(IS_REF, stacked(columns, cells, "column_no, value"))
    counts = long.groupBy("column_no", "value").agg(*map(F.expr, SIDES))
    return counts.selectExpr(named(columns), "value", "n_ref", "n_cur")


def numeric_cells(pair: Pair, columns: Sequence[str]) -> DataFrame:
    """(column_no, is_ref, value), one row per cell that holds a number."""
    cells = [number_sql(pair.rows, c) for c in columns]
    return pair.rows.selectExpr(IS_REF, stacked(columns, cells, "column_no, value")).where("value IS NOT NULL")
