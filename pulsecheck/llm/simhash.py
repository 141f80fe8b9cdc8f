"""SimHash near-duplicates, found with the pigeonring principle.

Fingerprints of 64 bits stand for 8 segments of 8 bits on a ring. If two differ in at most 3 bits, some chain of
segments on the ring keeps its running difference within the proportional budget 3/8 a segment all the way: none
after one and two segments, at most 1 after three to five, 2 after six and seven, 3 after eight. So a
link is found at a start where two segments are equal and the next three (24 bits) differ in one bit at most: of
those three, two are equal. The index therefore holds, for each of the 8 starts and each choice of two among the
three, 32 equal bits: 24 entries a fingerprint. Pairs that meet under a key pass the chain's budgets before the
full Hamming check.

Only distinct fingerprints are indexed, so groups of copies weigh one. A key under which more than BLOCK of them
meet is dealt out by pairs of blocks. Of each block's links a spanning forest is kept: it has the same components.
Components come from alternating large-star and small-star steps, whose edges are written between steps.

Null text counts as empty, and a text without words has fingerprint zero, linked like any other. Rows with one
doc_id and different texts are rows of their own. A null doc_id never is a component's id, unless the whole
component has no other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pulsecheck.llm.common import batch_of, byte_texts, fields, per_slice, pick
from pulsecheck.sources.shared import settle

SEGMENTS, BITS, DISTANCE = 8, 8, 3
#: Fingerprints under one key that are compared in one place.
BLOCK = 8192


def fingerprint_bits(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprint(text: bytes, size: int = 3) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), 42) if words else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -size] + 1))
    hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())]
    return fingerprint_bits(np.array(hashes, dtype="<u8"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the fingerprint as a signed long."""
    rows = pick(docs, key, text)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([text_fingerprint(t) for t in byte_texts(batch.column("text"))], dtype=np.uint64)
            return batch_of(("key", batch.column("key")), ("fp", found.view(np.int64)))

        return step

    return per_slice(rows, make, fields(rows, "key", ("fp", "long")))


def _mask(first: int, count: int) -> int:
    """The bits of `count` segments on the ring from segment `first`."""
    return sum(((1 << BITS) - 1) << (BITS * ((first + i) % SEGMENTS)) for i in range(count))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: For each entry of the index: the start of its chain and the mask of its equal bits.
ENTRIES = [(s, _mask(s, 2) | _mask(s + a, 1) | _mask(s + b, 1)) for s in range(SEGMENTS) for a, b in combinations((2, 3, 4), 2)]


def _near(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether a and b keep the budgets of the chain from `start` and differ in at most DISTANCE bits."""
    x = a ^ b
    near = np.ones(x.shape, dtype=bool)
    for count in (3, 5, 7):
        mask = np.array([_mask(s, count) for s in range(SEGMENTS)], dtype=np.uint64)[start]
        near &= np.bitwise_count(x & mask) <= count * DISTANCE // SEGMENTS
    near[near] = np.bitwise_count(x[near]) <= DISTANCE
    return near


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _links(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Places of a spanning forest of the links within one key's fingerprints."""
    forest, out = _Forest(len(fp)), []
    for i in range(len(fp) - 1):
        for j in np.flatnonzero(_near(fp[i + 1 :], fp[i], start)) + i + 1:
            if forest.join(i, int(j)):
                out.append((i, int(j)))
    return out


def _linked(batches):
    """Sorted rows (entry, bucket, low, high, fp) to links (a, b). A key's rows may run over several batches."""
    held = None

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        entry, bucket, low, high, fp = rows
        start = np.array([s for s, _ in ENTRIES])[entry]
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (np.diff(entry) != 0) | (np.diff(bucket) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(fp)))
        a, b = [], []
        # Two under a key, by far the most, go at once.
        two = at[size == 2]
        near = _near(fp[two], fp[two + 1], start[two])
        a.append(fp[two[near]])
        b.append(fp[two[near] + 1])
        for i, n in zip(at[size > 2].tolist(), size[size > 2].tolist()):
            found = _links(fp[i : i + n], int(start[i]))
            if found:
                pairs = np.array(found) + i
                a.append(fp[pairs[:, 0]])
                b.append(fp[pairs[:, 1]])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return batch_of(("a", np.minimum(a, b)), ("b", np.maximum(a, b)))

    for batch in batches:
        rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("entry", "bucket", "low", "high", "fp")]
        rows[4] = rows[4].view(np.uint64)
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = np.all([c == c[-1] for c in rows[:4]], axis=0)
        cut = int(np.argmax(last))
        held = [c[cut:] for c in rows]
        if cut:
            yield links([c[:cut] for c in rows])
    if held is not None:
        yield links(held)


def near_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints (`fp`) whose components are those of all links."""
    entries = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for _, m in ENTRIES))).alias("entry", "bucket")
    index = distinct.select("fp", entries)
    met = index.withColumn("n", F.count("*").over(Window.partitionBy("entry", "bucket"))).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = met.withColumn("blocks", blocks).withColumn("own", F.expr("CAST(pmod(xxhash64(fp), blocks) AS INT)"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select("entry", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    ordered = keyed.repartition("entry", "bucket", "low", "high").sortWithinPartitions("entry", "bucket", "low", "high", "fp")
    return ordered.mapInArrow(_linked, StructType([StructField("a", LongType()), StructField("b", LongType())])).distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node, root: the smallest node reachable, of every node with an edge, by large-star and small-star steps."""

    def smallest(pairs: DataFrame) -> DataFrame:
        """u, v and m, the smallest of u and its neighbours, for both directions of every edge."""
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return both.join(least, "u")

    now = settle(edges, name)
    while True:
        # Large-star: larger neighbours go to the smallest. Small-star: smaller ones and the node itself do.
        large = settle(smallest(now).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), name)
        down = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        moved = large.join(down, large["b"] == down["u"]).select(F.col("m").alias("x"), F.col("a").alias("y"))
        small = down.select(F.col("m").alias("a"), F.col("u").alias("b")).union(moved.select("x", "y")).where("a <> b").distinct()
        after = settle(small, name)
        # Done when every node has one edge, to a node that has none downwards.
        ends = after.groupBy("b").agg(F.count("*").alias("n"))
        again = ends.where("n > 1").limit(1).count() or after.join(ends.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        now = after
        if not again:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a"), F.col("a")).distinct())


def component_of(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp, root, component_id: the component and the smallest key reachable, of every distinct fingerprint of `prints`
    (key, fp)."""
    distinct = settle(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    roots = components(near_links(distinct, block))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.join(whole, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (hex), component_id of every row."""
    prints = settle(fingerprints(docs, key, text), "prints")
    return prints.join(component_of(prints), "fp").select(F.col("key").alias(key), hex_of("fp").alias("fingerprint"), "component_id")


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with one document of each component: the one with the smallest key, a null key last.

    Repeated rows with that key leave one. Rows whose keys are all null are told apart by their text's fingerprint.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    source = rows.select("row", F.col("row").getField(key).alias("key"), F.col("row").getField(text).cast("string").alias("text"))
    schema = StructType([*source.select("row", "key").schema.fields, StructField("fp", LongType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([text_fingerprint(t) for t in byte_texts(batch.column("text"))], dtype=np.uint64)
            return batch_of(("row", batch.column("row")), ("key", batch.column("key")), ("fp", found.view(np.int64)))

        return step

    wide = settle(per_slice(source, make, schema), "printed")
    prints = wide.select("key", "fp")
    by_fp = prints.groupBy("fp", "key").agg(F.count("*").alias("copies"))
    # The fingerprint that holds the component's smallest key; the smallest such fingerprint if several rows share it.
    held = component_of(prints).join(by_fp, "fp").where("key <=> component_id")
    chosen = held.groupBy("root").agg(F.min(F.struct("fp", "key", "copies")).alias("one")).select("one.*")
    kept = wide.join(chosen.select(F.col("fp").alias("fp_"), F.col("key").alias("key_"), "copies"), F.expr("fp = fp_ AND key <=> key_"))
    single = kept.where("copies = 1").select("row")
    first = F.row_number().over(Window.partitionBy("fp", "key").orderBy(F.to_json("row")))
    repeated = kept.where("copies > 1").withColumn("nth", first).where("nth = 1").select("row")
    return single.union(repeated).select(*(F.col("row").getField(c).alias(c) for c in columns))
