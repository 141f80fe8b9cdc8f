"""Small column expressions used throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.config import DANGER, MISSING, STABLE, WARNING


#: Text that is a number, blanks around it aside; Java's suffixes (12d, 3f) are not part of one.
NUMBER = r"^\\s*[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?|[nN]a[nN])\\s*$"

# The expressions over many columns are SQL text: building them piece by piece costs a round trip to
# the JVM per piece, which adds up to seconds on wide tables.


def quote(name: str) -> str:
    """The exact column name in SQL, dots and spaces included."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    return F.col(quote(name))


def is_numeric(data_type: T.DataType) -> bool:
    """Booleans are categorical here, as in the profile."""
    return isinstance(data_type, T.NumericType)


def _floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def missing_sql(df: DataFrame, name: str) -> str:
    """Null, and NaN on floating columns: both mean "no value"."""
    column = quote(name)
    return f"({column} IS NULL OR ISNAN({column}))" if _floating(df, name) else f"({column} IS NULL)"


def present_sql(df: DataFrame, name: str) -> str:
    """The column with NaN turned into null."""
    column = quote(name)
    return f"CASE WHEN NOT ISNAN({column}) THEN {column} END" if _floating(df, name) else column


def number_sql(df: DataFrame, name: str) -> str:
    """Double value; text that is no number, null and NaN all become null.

    Adding zero folds -0.0 into 0.0, so that equal numbers group together.
    """
    data_type = df.schema[name].dataType
    column = quote(name)
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        value = f"CAST({column} AS DOUBLE)"
    else:
        value = f"CASE WHEN {column} RLIKE '{NUMBER}' THEN TRY_CAST({column} AS DOUBLE) END"
    exact = isinstance(data_type, (T.IntegralType, T.DecimalType, T.BooleanType))
    return value if exact else f"CASE WHEN NOT ISNAN({value}) THEN {value} + 0.0D END"


def text_sql(df: DataFrame, name: str) -> str:
    """Text form; missing stays null."""
    return f"CAST({present_sql(df, name)} AS STRING)"


def category_sql(df: DataFrame, name: str) -> str:
    """Text form in which missing is a category of its own."""
    return f"COALESCE({text_sql(df, name)}, {text_literal(MISSING)})"


def is_missing(df: DataFrame, name: str) -> Column:
    return F.expr(missing_sql(df, name))


def present(df: DataFrame, name: str) -> Column:
    return F.expr(present_sql(df, name))


def as_number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def as_text(df: DataFrame, name: str) -> Column:
    return F.expr(text_sql(df, name))


def as_category(df: DataFrame, name: str) -> Column:
    return F.expr(category_sql(df, name))


def safe_div(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, 0 where the denominator is 0."""
    bottom = denominator.cast("double")
    return F.when(bottom == 0, F.lit(0.0)).otherwise(numerator.cast("double") / bottom)


def status_of(score: Column, warning: float, danger: float) -> Column:
    return (
        F.when(score >= F.lit(danger), F.lit(DANGER))
        .when(score >= F.lit(warning), F.lit(WARNING))
        .otherwise(F.lit(STABLE))
    )


def clip_score(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))
