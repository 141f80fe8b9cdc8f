"""Hard negatives: rows of another label that score almost as high with an anchor as its best rows of the same label.

Each vector is cut into segments, of which mean and deviation are kept. With segments of w components, an inner product lies
within sum(w * (mean * mean' - dev * dev')) and sum(w * (mean * mean' + dev * dev')). Segments are refined in levels, each cutting
the segments of the one before; what the bounds of a level leave out is not looked at on the next, and only what is left
after the last is scored exactly. A few rows of the highest middles are scored before each cut, so that the bar is high early.

Components count as floor(scale * x), so scores are whole numbers and exact; a score beyond 64 bits is an error. Anchors
are met with all rows in blocks: a block of rows and a block of anchors are one task's work, and the best of all blocks of rows
are put together by anchor. Every row is scored or ruled out by its bounds; there is no cap on candidates.

Rows with a null id or label, a null or empty vector, one of another length than most, or one that holds null, NaN or infinite
components take no part. Repeated rows count once; of several rows with one id only the one with the smallest label (then vector)
counts. Ties go to the smaller id. An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecheck.sources.shared import settle

#: Components of a segment on the last level, and how many segments of a level make one of the level before.
FINEST, FACTOR = 2, 4
#: Rows and anchors of one block.
ROWS, ANCHORS = 8192, 8192
#: Rows scored before each cut, for each one asked for.
PROBES = 8
#: Room for the rounding of bounds, as a share of the product of both norms.
SLACK = 1e-9
EXACT = 2.0**53


def whole_rows(vectors: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """id, label and vector (whole numbers as doubles) of the rows that take part, one row an id."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    rows = rows.where("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    rows = rows.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))
    # rint() of a floor keeps it a double: floor() alone would stop at 64 bits.
    rows = rows.withColumn("vector", F.expr(f"transform(vector, x -> rint(x * {scale}) - IF(rint(x * {scale}) > x * {scale}, 1D, 0D))"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class Summaries:
    """Mean and deviation of the segments of each vector, on each level from one segment to the finest."""

    def __init__(self, vectors: np.ndarray):
        width = FINEST
        while width < vectors.shape[1]:
            width *= FACTOR
        # Zeros behind a vector add nothing to a product.
        padded = np.zeros((len(vectors), width))
        padded[:, : vectors.shape[1]] = vectors
        self.levels = []
        while width >= FINEST:
            parts = padded.reshape(len(vectors), -1, width)
            # The root of the width is taken into both, so that a product of two is the segment's share.
            self.levels.append((parts.mean(axis=2) * width**0.5, parts.std(axis=2) * width**0.5))
            width //= FACTOR


class Block:
    """Rows of one block, ready for anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.summaries = Summaries(self.vectors)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.met = self.scored = 0

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products as 64-bit integers."""
        self.scored += len(rows)
        if self.largest * np.abs(anchor).sum() < EXACT:
            return (self.vectors[rows] @ anchor).astype(np.int64)
        whole = [int(x) for x in anchor]
        found = [sum(int(x) * y for x, y in zip(self.vectors[r], whole)) for r in rows]
        if any(abs(s) >= 1 << 63 for s in found):
            raise ValueError("a score is beyond 64 bits")
        return np.array(found, dtype=np.int64)

    def likely(self, rows: np.ndarray, anchor: np.ndarray, summary: list, n: int, bar, ceiling: float = np.inf) -> np.ndarray:
        """Of `rows` those that may score `bar(exact scores of some rows)` or more, and `ceiling` or less."""
        self.met += len(rows)
        low_bar, norm = bar(np.zeros(0, dtype=np.int64)), float(np.sqrt((anchor**2).sum()))
        for (mean, dev), (own_mean, own_dev) in zip(self.summaries.levels, summary):
            if len(rows) <= n * PROBES:
                break
            middle, room = mean[rows] @ own_mean, dev[rows] @ own_dev
            room = room + SLACK * (1 + norm * self.norms[rows])
            probes = rows[np.argpartition(-middle, n * PROBES)[: n * PROBES]]
            low_bar = max(low_bar, bar(self.scores(probes, anchor)))
            rows = rows[(middle + room >= low_bar) & (middle - room <= ceiling)]
        return rows


def _best(scores: np.ndarray, n: int) -> float:
    return float(np.partition(scores, -n)[-n]) if len(scores) >= n else -np.inf


def _positives(block: Block, anchors: pa.Table, n: int) -> dict:
    """anchor, id and score of each anchor's best rows of its label in the block."""
    by_label = {x: np.flatnonzero(block.labels == x) for x in np.unique(block.labels).tolist()}
    vectors = _matrix(anchors.column("vector"))
    levels = Summaries(vectors).levels
    out: list[tuple] = []
    for i, (own, label) in enumerate(zip(anchors.column("id").to_pylist(), anchors.column("label").to_pylist())):
        rows = by_label.get(label, np.zeros(0, dtype=np.int64))
        rows = rows[block.ids[rows] != own]
        rows = block.likely(rows, vectors[i], [(m[i], d[i]) for m, d in levels], n, lambda s: _best(s, n))
        scores = block.scores(rows, vectors[i])
        best = np.lexsort((block.ids[rows], -scores))[:n]
        out.append((np.full(len(best), own), block.ids[rows[best]], scores[best]))
    return _columns(out, ("anchor_id", "id", "score"))


def _within(scores: np.ndarray, positive: int, share: tuple[int, int]) -> np.ndarray:
    """share[0] * positive <= share[1] * score <= share[1] * positive, without leaving 64 bits."""
    low, high = -(-share[0] * positive // share[1]), positive
    return (scores >= low) & (scores <= high)


def _negatives(block: Block, anchors: pa.Table, n: int, share: tuple[int, int]) -> dict:
    """anchor, positive, its score, id and score of the best rows of other labels in the block, for each positive."""
    others = {x: np.flatnonzero(block.labels != x) for x in set(anchors.column("label").to_pylist())}
    vectors = _matrix(anchors.column("vector"))
    levels = Summaries(vectors).levels
    out: list[tuple] = []
    for i, (own, label, positives) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("id", "label", "positives")))):
        known = [p["score"] for p in positives if p["score"] >= 0]  # below zero no score lies between
        if not known:
            continue

        def bar(scores: np.ndarray) -> float:
            return min(max(share[0] * p / share[1] * (1 - SLACK) - 1, _best(scores[scores <= p], n)) for p in known)

        rows = others[label]
        rows = rows[block.ids[rows] != own]
        rows = block.likely(rows, vectors[i], [(m[i], d[i]) for m, d in levels], n, bar, max(known))
        scores = block.scores(rows, vectors[i])
        order = np.lexsort((block.ids[rows], -scores))
        for p in positives:
            best = order[_within(scores[order], p["score"], share)][:n]
            out.append((np.full(len(best), own), np.full(len(best), p["id"]), np.full(len(best), p["score"]), block.ids[rows[best]], scores[best]))
    return _columns(out, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))


def _columns(found: list[tuple], names: tuple[str, ...]) -> dict:
    return {n: np.concatenate([*(f[i] for f in found), np.zeros(0, dtype=np.int64)]).astype(np.int64) for i, n in enumerate(names)}


def _met(rows: DataFrame, anchors: DataFrame, search, schema: str, parts: int, turns: int) -> DataFrame:
    """`search(block, anchors)` for each block of rows with each block of anchors."""

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks")
        there, asking = group.filter(pa.compute.invert(asks)), group.filter(asks)
        if not there.num_rows or not asking.num_rows:
            return pa.table(_columns([], tuple(c.split()[0] for c in schema.split(", "))))
        block = Block(there.column("id").to_numpy(), there.column("label").to_numpy(), _matrix(there.column("vector")))
        return pa.table(search(block, asking))

    part, turn = F.pmod(F.xxhash64("id"), F.lit(parts)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(turns))
    every_turn, every_part = F.sequence(F.lit(0), F.lit(turns - 1)), F.sequence(F.lit(0), F.lit(parts - 1))
    there = rows.select("id", "label", "vector", F.lit(False).alias("asks"), part.cast("int").alias("part"), F.explode(every_turn).alias("turn"))
    asking = anchors.withColumn("asks", F.lit(True)).withColumn("part", F.explode(every_part)).withColumn("turn", turn.cast("int"))
    return there.unionByName(asking, allowMissingColumns=True).groupBy("part", "turn").applyInArrow(run, schema)


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", block: int = ROWS, anchors_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id `every` divides, their positives their best rows of the same label; of the rows of other
    labels that score at least `share` (a fraction) of the positive, but not more than it, the best are returned.
    """
    own_label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = settle(whole_rows(vectors, key, vector, own_label, scale), "rows")
    asked = rows.where(F.col("id") % every == 0)
    n_rows, n_anchors = rows.count(), asked.count()
    parts, turns = max(1, -(-n_rows // block)), max(1, -(-n_anchors // anchors_block))

    met = _met(rows, asked, lambda b, a: _positives(b, a, n_positives), "anchor_id long, id long, score long", parts, turns)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    best = met.withColumn("place", place).where(F.col("place") <= n_positives)
    positives = best.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asking = settle(asked.join(positives, asked["id"] == positives["anchor_id"]).drop("anchor_id"), "anchors")

    found = _met(rows, asking, lambda b, a: _negatives(b, a, n_negatives, share), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", parts, turns)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
