"""Small tables that are part of the plan itself."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A handful of given rows as a local relation: no job, and foldable by the optimizer."""
    struct = T.StructType.fromDDL(schema)
    columns = [[row[i] for row in rows] for i in range(len(struct.fields))]
    arrow = to_arrow_schema(struct)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), struct).coalesce(1)


def literal_table(df: DataFrame) -> DataFrame:
    """Run `df` once and keep its rows as a local relation.

    Only for results whose size does not grow with the data: one row per column, metric, class,
    threshold, range or kept segment group.
    """
    # one partition, so that aggregates and joins over these few rows need no shuffle
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema).coalesce(1)
