"""Splitting one table into periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.config import CURRENT, PERIOD, REFERENCE
from pulsecheck.functions.expressions import is_missing, is_numeric, present, quoted
from pulsecheck.functions.literal import local_table
from pulsecheck.functions.ordering import precedes_rank

MIN_PARSED = 0.8

CLOCK = "[ h:m[:s] a][ H:m[:s[.SSSSSS][.SSS]]]"
# The ways dates are written that are read beside ISO 8601, by name: what a text looks like, and its pattern.
# Of two that differ in the place of the month, the first is meant where the days settle nothing.
WRITTEN = {
    "year/month/day": (r"^\d{4}/", f"y/M/d{CLOCK}"),
    "year.month.day": (r"^\d{4}\.", f"y.M.d{CLOCK}"),
    "yearmonthday": (r"^\d{8}( |$)", f"yyyyMMdd{CLOCK}"),
    "yearmonthdaytime": (r"^\d{14}$", "yyyyMMddHHmmss"),
    "month/day/year": (r"^\d{1,2}/\d{1,2}/\d{4}", f"M/d/y{CLOCK}"),
    "day/month/year": (r"^\d{1,2}/\d{1,2}/\d{4}", f"d/M/y{CLOCK}"),
    "month-day-year": (r"^\d{1,2}-\d{1,2}-\d{4}", f"M-d-y{CLOCK}"),
    "day-month-year": (r"^\d{1,2}-\d{1,2}-\d{4}", f"d-M-y{CLOCK}"),
    "month.day.year": (r"^\d{1,2}\.\d{1,2}\.\d{4}", f"M.d.y{CLOCK}"),
    "day.month.year": (r"^\d{1,2}\.\d{1,2}\.\d{4}", f"d.M.y{CLOCK}"),
    "name day, year": (r"^[A-Za-z]{3} \d{1,2},? ", f"MMM d[,] y{CLOCK}"),
    "fullname day, year": (r"^[A-Za-z]{3,9} \d{1,2},? ", f"MMMM d[,] y{CLOCK}"),
    "day name year": (r"^\d{1,2}[ -][A-Za-z]{3}[ -]", f"d[ ][-]MMM[ ][-]y{CLOCK}"),
    "day fullname year": (r"^\d{1,2}[ -][A-Za-z]{3,9}[ -]", f"d[ ][-]MMMM[ ][-]y{CLOCK}"),
}
#: The same texts with the day in front, by the name with the month in front.
TURNED = {"month/day/year": "day/month/year", "month-day-year": "day-month-year", "month.day.year": "day.month.year"}
ISO = "iso"


def _is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def read_time(df: DataFrame, column: str, written: str = ISO) -> Column:
    """The column as a time, or, if it is a number, as that number; what is no time becomes null. `written`: ISO or a
    name of WRITTEN."""
    if _is_time(df, column):
        return quoted(column)
    if is_numeric(df.schema[column].dataType):
        return present(df, column)
    text = F.trim(quoted(column).cast("string"))
    if written == ISO:
        return F.try_to_timestamp(text)
    looks, pattern = WRITTEN[written]
    # Texts of another look are not tried: a failed try is slow.
    return F.when(text.rlike(looks), F.try_to_timestamp(F.initcap(text) if "MMM" in pattern else text, F.lit(pattern)))


def time_written(df: DataFrame, column: str) -> tuple[str, int, int, bool]:
    """How the times of a column are written, rows, rows that can be read so, and whether day and month could be meant
    the other way round in every row. One aggregate over all ways; the whole column is read in one of them."""
    text = not _is_time(df, column) and not is_numeric(df.schema[column].dataType)
    ways = [ISO, *(WRITTEN if text else ())]
    counts = df.agg(F.count("*").alias("rows"), *[F.count(read_time(df, column, w)).alias(f"n{i}") for i, w in enumerate(ways)]).first()
    found = {w: counts[f"n{i}"] for i, w in enumerate(ways)}
    best = max(ways, key=lambda w: found[w])  # the first of those that read as many
    ambiguous = found[best] > 0 and best in TURNED and found[TURNED[best]] == found[best]
    return best, counts["rows"], found[best], ambiguous


def time_parse_share(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, rows whose time parses, their share, and whether the column may order rows; then how times are
    written, and whether day and month could be turned round."""
    written, rows, parsed, ambiguous = time_written(df, column)
    share = float(parsed) / float(rows) if rows else None
    row = (rows, parsed, share, share is not None and share >= MIN_PARSED, written, ambiguous)
    return local_table(df.sparkSession, [row], "n_rows long, n_parsed long, share double, accepted boolean, written string, ambiguous boolean")


def split_periods(
    df: DataFrame,
    order: Sequence[str],
    ratio: float = 0.60,
    time_column: str | None = None,
) -> tuple[DataFrame, str | None]:
    """Add `period`: the first int(n * ratio) rows are the reference. Returns the table and a warning.

    Rows go by `time_column` where at least 80 % of it parses in one way of writing, ties by `order`; otherwise by `order`
    alone, which must therefore name a key. Where no day is above 12, the month is taken to stand first, with a warning. The split is a comparison with literals: nothing is
    sorted or shuffled, and the table streams through one filter.
    """
    if not 0.30 <= ratio <= 0.85:
        raise ValueError("the reference share must lie between 30 % and 85 %")
    warning = None
    if time_column and time_column in df.columns:
        written, rows, parsed, ambiguous = time_written(df, time_column)
        accepted = rows > 0 and float(parsed) / float(rows) >= MIN_PARSED
        warning = "time_not_parsed" if not accepted else "day_and_month_unclear" if ambiguous else None
    else:
        rows, accepted, warning = df.count(), False, "no_time_column"
    if rows < 100:
        raise ValueError("at least 100 rows are needed to compare two periods")
    keys = list(order)
    working = df
    if accepted:
        working = df.withColumn("__time", read_time(df, time_column, written))
        keys = ["__time", *keys]
    first = precedes_rank(working, keys, int(rows * ratio))
    labelled = working.withColumn(PERIOD, F.when(first, REFERENCE).otherwise(CURRENT))
    return labelled.drop("__time"), warning


def split_train_holdout(
    reference: DataFrame, target: str, order: Sequence[str], share: float = 0.8, out: str = "part"
) -> DataFrame:
    """Rows with a target, labelled `out` = train for the first 80 %, holdout for the rest."""
    clean = reference.where(~is_missing(reference, target))
    rows = clean.count()
    cut = min(rows - 1, max(1, int(rows * share)))
    first = precedes_rank(clean, order, cut)
    return clean.withColumn(out, F.when(first, "train").otherwise("holdout"))


def labels_complete(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, labelled rows, and whether every row has its label (false for no rows)."""
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum((~is_missing(df, target)).cast("long")), F.lit(0)).alias("n_labelled"),
    )
    return counts.withColumn("complete", (F.col("n_rows") > 0) & (F.col("n_rows") == F.col("n_labelled")))
