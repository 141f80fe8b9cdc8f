"""Global order without a global sort task.

ROC, PR, KS, exact quantiles and time splits all need ranks over a whole table. A window without
PARTITION BY would send every row to one task, and a sampled range partitioning may come out
differently when a lost executor is recomputed. Here the ranges are cut at *literal* points that one
sketch job picks beforehand. The points only balance the work: any points give the same result, and
recomputing a partition always rebuilds the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsecheck.functions.expressions import quote, quoted
from pulsecheck.functions.literal import literal_table


FEW_EDGES = 16


def locate(df: DataFrame, value: Column, edges: Column, longest: int, out: str, strict: bool = False) -> DataFrame:
    """Add `out` = number of entries of the ascending array `edges` that are <= value (< if strict).

    `edges` holds at most `longest` entries. Short ones are compared one by one; long ones go through
    an unrolled binary search of about log2(longest) comparisons a row. Both are generated code.
    """
    value_name, edges_name = f"__{out}_value", f"__{out}_edges"
    if longest <= FEW_EDGES:
        named = df.withColumns({value_name: value, edges_name: edges})
        sign = "<" if strict else "<="
        hits = " + ".join(f"IF(GET({edges_name}, {i}) {sign} {value_name}, 1, 0)" for i in range(longest))
        return named.withColumn(out, F.expr(hits)).drop(value_name, edges_name)
    df = df.withColumns({value_name: value, edges_name: edges, out: F.lit(0)})
    step = 1 << max(longest, 1).bit_length()
    while step > 1:
        step >>= 1
        sign = "<" if strict else "<="
        probe = f"GET({edges_name}, {out} + {step - 1}) {sign} {value_name}"
        df = df.withColumn(out, F.expr(f"{out} + IF({probe}, {step}, 0)"))
    return df.drop(value_name, edges_name)


def partition_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_count(df: DataFrame, n_keys: int = 1) -> int:
    """How many ranges to cut each key into: two per shuffle partition over all keys, to even out the hashing, so
    that the table of cut points stays small however many keys there are."""
    return max(8, -(-2 * partition_count(df) // n_keys))


def cut_points(value: str, ranges: int) -> Column:
    """Aggregate: ascending points that split the numeric column `value` into about equal ranges."""
    shares = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    return F.expr(f"SORT_ARRAY(ARRAY_DISTINCT(PERCENTILE_APPROX({quote(value)}, ARRAY({shares}), {max(10_000, 20 * ranges)})))")


def collect_cuts(rows: DataFrame, keys: Sequence[str], value: str, share: float = 1 / 64, n_keys: int = 1) -> DataFrame:
    """(keys, cuts) as a literal table of #keys x #ranges values, whatever the size of `rows`.

    A thin draw is enough, since the points only balance the work; where the draw comes out too
    small to balance anything, the table is small too.
    """
    sketch = rows.sample(share, seed=11).groupBy(*keys).agg(cut_points(value, range_count(rows, n_keys)).alias("cuts"))
    return literal_table(sketch)


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: dict[str, Column],
    cuts: DataFrame | None = None,
    n_keys: int = 1,
) -> DataFrame:
    """One row per distinct (keys, value): the counts, their running sums in ascending order of
    `value` (`cum_*`, own row included) and their totals per key (`all_*`).

    Repeated values are combined before the shuffle, so a hot value is one row afterwards, and each
    window partition holds one range of one key. `n_keys`: about how many keys there are.
    """
    keys = list(keys)
    if cuts is None:
        cuts = collect_cuts(rows, keys, value, n_keys=n_keys)
    grouped = rows.groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()])
    located = locate(
        grouped.join(F.broadcast(cuts), keys, "left"), F.col(value), F.col("cuts"), range_count(rows, n_keys), "range_id"
    )
    return accumulate(located.drop("cuts"), keys, value, list(counts))


def accumulate(grouped: DataFrame, keys: list[str], value: str, counts: list[str]) -> DataFrame:
    """Running sums over rows that already carry their `range_id` and are distinct by (keys, value).

    The rows move once, into their ranges. The totals per range come from the rows as they lie before that: each task
    sends one row a range.
    """
    key = ", ".join(quote(k) for k in keys)
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    # this window runs over #keys x #ranges rows
    up_to = f"OVER (PARTITION BY {key} ORDER BY range_id {so_far})"
    offsets = grouped.groupBy(*keys, "range_id").agg(*[F.sum(n).alias(n) for n in counts]).selectExpr(
        *map(quote, keys),
        "range_id",
        *[f"SUM({n}) {up_to} - {n} AS __before_{n}" for n in counts],
        *[f"SUM({n}) OVER (PARTITION BY {key}) AS all_{n}" for n in counts],
    )
    in_range = f"OVER (PARTITION BY {key}, range_id ORDER BY {quote(value)} {so_far})"
    inside = grouped.repartition(*keys, "range_id").selectExpr("*", *[f"SUM({n}) {in_range} AS __in_{n}" for n in counts])
    return inside.join(F.broadcast(offsets), [*keys, "range_id"]).selectExpr(
        *map(quote, [*keys, value]),
        "range_id",
        *counts,
        *[f"__before_{n} + __in_{n} AS cum_{n}" for n in counts],
        *[f"all_{n}" for n in counts],
    )


# --- selecting the row at a rank, without moving the table ------------------------------------


def _as_literal(text: str | None, data_type: T.DataType) -> Column:
    return F.lit(text).cast(data_type)


def _literal_array(texts: Sequence[str], data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.array(*[F.lit(t) for t in texts])
    # one literal instead of hundreds keeps the plan small; no number or time holds a bar
    return F.split(F.lit("|".join(texts)), r"\|").cast(T.ArrayType(data_type))


def _split_points(rows: DataFrame, name: str, data_type: T.DataType, total: int) -> list[str]:
    """A few hundred values of `name`, as text, that divide `rows` into ranges."""
    ranges = 256
    thin = min(1.0, 4000.0 * ranges / total)
    drawn = rows.sample(thin, seed=17) if thin < 1 else rows
    if isinstance(data_type, T.StringType):
        # of the values that fall into each of 256 hash buckets the one with the least second hash: values at random
        bucket = F.expr(f"pmod(xxhash64({quote(name)}), {ranges})")
        found = rows.groupBy(bucket).agg(F.min_by(name, F.xxhash64(F.lit("point"), F.col(name))).alias("point")).collect()
        return sorted(r["point"] for r in found)
    shares = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    sketch = f"PERCENTILE_APPROX({quote(name)}, ARRAY({shares}), 10000)"
    row = drawn.agg(F.expr(f"CAST(ARRAY_DISTINCT({sketch}) AS ARRAY<STRING>)").alias("points")).first()
    return list(row["points"] or [])


def value_at_rank(rows: DataFrame, name: str, rank: int) -> tuple[str, int, int]:
    """The value at 0-based `rank` of the non-null column `name`, as text, with the number of rows
    strictly below it and equal to it.

    Narrows a bracket: cut it into ranges, count each range, go on inside the one that holds the rank.
    Each step is two scans with map-side aggregation; no row is shuffled.
    """
    data_type = rows.schema[name].dataType
    rows = rows.select(name).where(F.col(name).isNotNull())
    spread = [F.count("*").alias("n"), F.min(name).cast("string").alias("low"), F.max(name).cast("string").alias("high")]
    piece = rows.agg(*spread).first()
    below = 0
    while piece["low"] != piece["high"]:
        # each point is a range of its own, so that a hot value comes off in one step; `high` as a
        # point makes sure that every step separates something
        points = list(dict.fromkeys([*_split_points(rows, name, data_type, piece["n"]), piece["high"]]))
        edges = F.sort_array(_literal_array(points, data_type))
        located = locate(rows, F.col(name), edges, len(points), "range_id")
        at_point = F.get(edges, F.col("range_id") - 1).eqNullSafe(F.col(name)).cast("int")
        counted = located.groupBy((2 * F.col("range_id") - at_point).alias("place")).agg(*spread)
        for piece in sorted(counted.collect(), key=lambda r: r["place"]):
            if rank < below + piece["n"]:
                break
            below += piece["n"]
        low, high = _as_literal(piece["low"], data_type), _as_literal(piece["high"], data_type)
        rows = rows.where((F.col(name) >= low) & (F.col(name) <= high))
    return piece["low"], below, piece["n"]


def precedes_rank(rows: DataFrame, order: Sequence[str], rank: int) -> Column:
    """Condition that holds for exactly the first `rank` rows in ascending order of the columns
    `order` (nulls last). The order must decide every row near the cut, so end it with a key.

    Instants are handled as microseconds: as text in the session's zone, two of them can look the same.
    """
    levels: list[tuple[str, T.DataType, str | None]] = []
    instants = {c for c in order if isinstance(rows.schema[c].dataType, T.TimestampType)}
    scope = rows.select(*[(F.unix_micros(quoted(c)) if c in instants else quoted(c)).alias(c) for c in order])
    left = rank
    for name in order:
        data_type = scope.schema[name].dataType
        filled = scope.agg(F.count(quoted(name))).first()[0]
        if left >= filled:
            left -= filled
            levels.append((name, data_type, None))
            scope = scope.where(quoted(name).isNull())
        else:
            text, below, equal = value_at_rank(scope, name, left)
            left -= below
            levels.append((name, data_type, text))
            if left == 0:
                break
            scope = scope.where(quoted(name) == _as_literal(text, data_type))
    if left:
        raise ValueError(f"rows tie on {list(order)} at the cut; add a key column to the order")
    condition = F.lit(False)
    for name, data_type, text in reversed(levels):
        column = quoted(name)
        if text is None:
            condition = column.isNotNull() | condition
        else:
            pivot = F.timestamp_micros(F.lit(int(text))) if name in instants else _as_literal(text, data_type)
            condition = F.coalesce(column < pivot, F.lit(False)) | (column.eqNullSafe(pivot) & condition)
    return condition
