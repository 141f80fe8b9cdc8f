"""The prediction log that the registered queries run on, derived from `lineitem` alone.

The text runs unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCORED = """
WITH base AS (
  SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus,
         l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' AS is_cur,
         CAST((l_orderkey * 37 + l_linenumber * 101 + l_partkey * 13) % 1000 AS DOUBLE)
           / CAST(1000 AS DOUBLE) AS noise,
         l_quantity / CAST(50 AS DOUBLE) AS q
  FROM {lineitem})
SELECT l_orderkey, l_linenumber, l_shipdate,
  CASE WHEN is_cur THEN 'current' ELSE 'reference' END AS period,
  CASE WHEN is_cur THEN l_quantity + 6 ELSE l_quantity END AS usage,
  CASE WHEN is_cur THEN l_extendedprice * CAST(1.38 AS DOUBLE) ELSE l_extendedprice END AS amount,
  CASE WHEN is_cur AND l_linenumber = 7 THEN NULL ELSE l_discount END AS discount,
  CASE WHEN is_cur AND l_linenumber = 6 AND l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS tax,
  CASE WHEN is_cur AND l_returnflag = 'N' AND l_linestatus = 'O' THEN 'X' ELSE l_returnflag END AS flag,
  l_linestatus AS line_status,
  CASE WHEN (CASE WHEN is_cur AND l_returnflag = 'R' THEN 1 - q ELSE q END)
            * CAST(0.6 AS DOUBLE) + noise * CAST(0.4 AS DOUBLE) > CAST(0.55 AS DOUBLE)
       THEN 1 ELSE 0 END AS y_true,
  q * CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE) AS proba,
  CASE WHEN q * CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE) >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pred,
  CASE WHEN q * CAST(0.7 AS DOUBLE) + noise * CAST(0.3 AS DOUBLE) < CAST(0.33 AS DOUBLE) THEN 'Basic'
       WHEN q * CAST(0.7 AS DOUBLE) + noise * CAST(0.3 AS DOUBLE) < CAST(0.66 AS DOUBLE) THEN 'Plus'
       ELSE 'Premium' END AS tier,
  CASE WHEN (CASE WHEN is_cur AND l_returnflag = 'A' THEN 1 - q ELSE q END) < CAST(0.33 AS DOUBLE) THEN 'Basic'
       WHEN (CASE WHEN is_cur AND l_returnflag = 'A' THEN 1 - q ELSE q END) < CAST(0.66 AS DOUBLE) THEN 'Plus'
       ELSE 'Premium' END AS pred_tier,
  1000 + 50 * l_quantity + 400 * (noise - CAST(0.5 AS DOUBLE))
    + CASE WHEN is_cur AND l_returnflag = 'R' THEN 600 ELSE 0 END AS y_value,
  1000 + 50 * l_quantity AS pred_value
FROM base
"""

NUMERIC = ["usage", "amount", "discount", "tax"]
CATEGORICAL = ["flag", "line_status"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED, lineitem=table(spark, sf_dir, "lineitem"))
