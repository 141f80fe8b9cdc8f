"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order in which the pivots stand to it, nearest first: the rank of every pivot. It is
posted in the inverted files of its `posted` nearest pivots. A query visits the files of its own `visited` nearest
pivots, ranks what it finds by the footrule distance of the two orders (the sum of the differences of ranks), and
reranks the better `share` of every file (at least `least` vectors) by the inner product. A vector that a query meets
in several files is looked at in the one whose pivot is nearest to the query. With more files visited than posted
in, the queries travel more often than the vectors, of which there are more.

Pivots are a bounded sample of distinct vectors. Equal vectors are one entry that carries its `k` + 1 smallest ids: no
result can hold more of them. A file of more than `block` entries is dealt into blocks, and so are its queries.

Vectors that are null, zero, of another length than most or that hold null, NaN or infinite components take no
part, nor do null ids. Rows that share the query's id are its own. Repeated rows (id and vector) count once. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from pulsecheck.llm.common import batch_of
from pulsecheck.sources.shared import settle

#: Pivots; nearest pivots under which a vector is posted, and whose files a query visits.
PIVOTS, POSTED, VISITED = 128, 3, 48
#: The share of a file, and the least number of its entries, that the inner product reranks.
SHARE, LEAST = 0.2, 300
#: Entries, and queries, of one block of a file.
BLOCK = 20_000


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector of the rows that take part."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    rows = rows.where("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('Infinity')) AND exists(vector, x -> x <> 0)")
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))


def _ranks(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots by nearness (largest inner product, ties to the first), and the rank of each."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    return order, ranks.astype(np.uint8)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _filed(entries: DataFrame, pivots: np.ndarray, posted: int, visited: int, rows: bool) -> DataFrame:
    """pivot and visits, for each posting and each visit; with `rows` also the entry's columns and ranks."""
    held = entries.sparkSession.sparkContext.broadcast(pivots)
    schema = StructType([StructField("pivot", LongType()), StructField("visits", BooleanType())])
    if rows:
        schema = StructType([*schema.fields, *(f for f in entries.schema.fields if f.name != "asks")]).add("ranks", "binary")

    def post(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                order, ranks = _ranks(_matrix(part.column("vector")), held.value)
                asks = np.flatnonzero(part.column("asks").to_numpy(zero_copy_only=False))
                row = np.concatenate([np.repeat(np.arange(part.num_rows), posted), np.repeat(asks, visited)])
                pivot = np.concatenate([order[:, :posted].reshape(-1), order[asks, :visited].reshape(-1)]).astype(np.int64)
                out = [("pivot", pivot), ("visits", np.arange(len(row)) >= part.num_rows * posted)]
                if rows:
                    taken = part.take(pa.array(row))
                    lines = [r.tobytes() for r in ranks]
                    out += [(n, taken.column(n)) for n in part.schema.names if n != "asks"]
                    out.append(("ranks", pa.array([lines[i] for i in row], pa.binary())))
                yield batch_of(*out)

    return entries.mapInArrow(post, schema)


def _search(k: int, posted: int, share: float, least: int):
    """The function for one block of a pivot's file: its entries and queries to pairs with their inner product."""

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        pivot = group.column("pivot")[0].as_py()
        visits = group.column("visits").to_numpy()
        entry, first = group.column("entry").to_numpy(), group.column("first").to_numpy()
        vectors = _matrix(group.column("vector").chunk(0))
        ranks = np.frombuffer(b"".join(group.column("ranks").to_pylist()), dtype=np.uint8).reshape(len(entry), -1).astype(np.int16)
        there, queries = np.flatnonzero(~visits), np.flatnonzero(visits)
        vectors_e, ranks_e, first_e = vectors[there], ranks[there], first[there]
        found = []
        for q in queries if len(there) else ():
            rank = ranks[q]
            nearer = np.flatnonzero(rank < rank[pivot])
            here = np.flatnonzero((ranks_e[:, nearer] >= posted).all(axis=1))
            top = max(least, int(np.ceil(share * len(there))))
            if top < len(here):
                footrule = np.abs(ranks_e[here] - rank).sum(axis=1, dtype=np.int32)
                here = here[np.argsort(footrule, kind="stable")[:top]]
            near = vectors_e[here] @ vectors[q]
            best = np.lexsort((first_e[here], -near))[: k + 1]
            found.append((np.full(len(best), q), there[here[best]], near[best]))
        q, e, near = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query": entry[q], "query_first": first[q], "entry": entry[e], "first": first[e], "near": near})

    return search


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, posted: int = POSTED, visited: int = VISITED, share: float = SHARE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """query_id, rank, the neighbour as `key`, score: for each row whose id `every` divides, its k nearest found."""
    if not 0 < pivots <= 256:
        raise ValueError("1 to 256 pivots")
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector).withColumn("asks", F.expr(f"id % {every} = 0"))
    # Equal vectors: k + 1 ids of each kind (queries or not) are enough, and ranking keeps that many in each task.
    own = Window.partitionBy("vector", "asks").orderBy("id")
    few = rows.withColumn("nth", F.dense_rank().over(own)).where(F.col("nth") <= k + 1)
    grouped = few.groupBy("vector").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    # An entry is known by its vector's hash and its smallest id.
    entries = settle(grouped.withColumn("entry", F.xxhash64("vector")).withColumn("first", F.col("ids")[0]), "entries")
    table = np.array([r["vector"] for r in entries.orderBy("entry", "first").limit(pivots).select("vector").collect()] or [[0.0]], dtype=float)
    posted, visited = min(posted, len(table)), min(visited, len(table))
    slim = entries.select("entry", "first", "vector", "asks")
    counts = _filed(slim, table, posted, visited, False).groupBy("pivot").agg(F.count_if(~F.col("visits")).alias("n"), F.count_if("visits").alias("q")).collect()
    blocks = spark.createDataFrame([(r["pivot"], -(-max(r["n"], 1) // block), -(-max(r["q"], 1) // block)) for r in counts], "pivot long, parts int, turns int")
    filed = _filed(slim, table, posted, visited, True).join(F.broadcast(blocks), "pivot")
    # Postings stand in one part for all turns of queries, visits in one turn for all parts.
    filed = filed.withColumn("part", F.explode(F.expr("IF(visits, sequence(0, parts - 1), array(CAST(pmod(entry, parts) AS INT)))")))
    filed = filed.withColumn("turn", F.explode(F.expr("IF(visits, array(CAST(pmod(entry, turns) AS INT)), sequence(0, turns - 1))"))).drop("parts", "turns")
    pairs = StructType([StructField(n, LongType()) for n in ("query", "query_first", "entry", "first")]).add("near", DoubleType())
    met = filed.groupBy("pivot", "part", "turn").applyInArrow(_search(k, posted, share, least), pairs)
    # Of each query's entries the best k + 1, ties to the smaller first id, hold its k nearest ids.
    order = Window.partitionBy("query", "query_first").orderBy(F.desc("near"), "first", "entry")
    best = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    asked = entries.where("asks").select(F.col("entry").alias("query"), F.col("first").alias("query_first"), F.col("vector").alias("asked"))
    scored = best.join(entries.select("entry", "first", "ids", "vector"), ["entry", "first"]).join(asked, ["query", "query_first"])
    scored = scored.select("query", "query_first", F.explode("ids").alias("id"), inner_product("asked", "vector").alias("score"))
    lists = scored.groupBy("query", "query_first").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("found"))
    asking = rows.where("asks").distinct().select("id", "vector").join(entries.where("asks").select("vector", F.col("entry").alias("query"), F.col("first").alias("query_first")), "vector")
    own_out = F.expr(f"slice(array_distinct(filter(found, f -> f.id <> id)), 1, {k})")
    out = asking.join(lists, ["query", "query_first"]).select(F.col("id").alias("query_id"), F.posexplode(own_out).alias("place", "f"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("f.id").alias(key), (-F.col("f.minus")).alias("score"))


def inner_product(a: str, b: str):
    """In double precision, component by component in their order."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)")
