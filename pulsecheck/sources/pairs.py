"""The reference / current pair as one DataFrame with a `period` column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.config import CURRENT, PERIOD, REFERENCE
from pulsecheck.functions.expressions import is_numeric, quoted


OWN_PERIOD = "period (column)"
#: Whole numbers up to here are doubles too.
EXACT = 1 << 53


def exact_name(column: str) -> str:
    """Beside a column that is whole on one side and floating on the other: the text of whole numbers that are no doubles."""
    return f"__exact {column}"


FLOATING = (T.DoubleType, T.FloatType)


@dataclass(frozen=True)
class Pair:
    """`rows` holds both periods, so that one scan serves both sides of every comparison."""

    rows: DataFrame
    reference_types: dict[str, T.DataType]
    current_types: dict[str, T.DataType]

    @property
    def columns(self) -> list[str]:
        """Reference order, then the columns only current has."""
        return list(dict.fromkeys([*self.reference_types, *self.current_types]))

    @property
    def shared(self) -> list[str]:
        return [c for c in self.reference_types if c in self.current_types]

    def only(self, columns: list[str]) -> Pair:
        def keep(types: dict[str, T.DataType]) -> dict[str, T.DataType]:
            return {c: t for c, t in types.items() if c in columns}

        kept = [c for c in self.columns if c in columns]
        rows = self.rows.select(PERIOD, *[quoted(c) for c in kept], *[quoted(exact_name(c)) for c in kept if exact_name(c) in self.rows.columns])
        return Pair(rows, keep(self.reference_types), keep(self.current_types))

    def period(self, name: str) -> DataFrame:
        types = self.reference_types if name == REFERENCE else self.current_types
        return self.rows.where(F.col(PERIOD) == name).select(*[quoted(c) for c in types])


def _with_exact(df: DataFrame, name: str, data_type: T.DataType) -> DataFrame:
    beyond = (quoted(name) > EXACT) | (quoted(name) < -EXACT)
    text = F.lit(None) if isinstance(data_type, FLOATING) else F.when(beyond, quoted(name).cast("string"))
    return df.withColumn(exact_name(name), text.cast("string"))


def pair_of(reference: DataFrame, current: DataFrame) -> Pair:
    """Two tables side by side. Columns of one side only are null on the other.

    A column of the tables that has the name of the side marker is kept as OWN_PERIOD.
    """
    reference, current = (df.withColumnRenamed(PERIOD, OWN_PERIOD) for df in (reference, current))
    ref_types = {f.name: f.dataType for f in reference.schema.fields}
    cur_types = {f.name: f.dataType for f in current.schema.fields}
    for name, data_type in ref_types.items():
        other = cur_types.get(name, data_type)
        if data_type != other and not (is_numeric(data_type) and is_numeric(other)):
            reference = reference.withColumn(name, quoted(name).cast("string"))
            current = current.withColumn(name, quoted(name).cast("string"))
        elif data_type != other and isinstance(data_type, FLOATING) != isinstance(other, FLOATING):
            reference, current = _with_exact(reference, name, data_type), _with_exact(current, name, other)
    rows = reference.withColumn(PERIOD, F.lit(REFERENCE)).unionByName(
        current.withColumn(PERIOD, F.lit(CURRENT)), allowMissingColumns=True
    )
    return Pair(rows, ref_types, cur_types)


def pair_from(rows: DataFrame, columns: list[str] | None = None) -> Pair:
    """A table that already has its `period` column."""
    columns = [c for c in (columns or rows.columns) if c != PERIOD]
    types = {c: rows.schema[c].dataType for c in columns}
    return Pair(rows.select(PERIOD, *[quoted(c) for c in columns]), types, types)
