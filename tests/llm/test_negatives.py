"""Hard negatives against every score worked out in plain integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsecheck.llm import negatives
from pulsecheck.llm.negatives import Block, Summaries, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, part string"


def plain(rows, every=100, n=5):
    size = max(sorted({len(v) for _, v, _ in rows}), key=lambda s: sum(len(v) == s for _, v, _ in rows), default=0)
    own = {}
    for i, v, label in rows:
        if len(v) == size:
            whole = (label, [math.floor(256 * x) for x in v])
            own[i] = min(own.get(i, whole), whole)
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in own.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:n]:
            near = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:n]
            out += [(a, p, r, s[1], -minus, -s[0]) for r, s in enumerate(near, 1)]
    return sorted(out)


def planted(n, size, seed, step):
    """Vectors on a coarse grid, so that scores tie, with copies."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-4, 4) / step for _ in range(size)], rng.randint(0, 3)) for i in range(n)]
    return rows + [(n + i, rows[7][1], rng.randint(0, 3)) for i in range(n // 5)]


@pytest.mark.parametrize("size,block", [(5, 8192), (16, 64), (64, 200)])
def test_equals_plain_integers(spark, size, block):
    rows = planted(600, size, size, 8)
    df = spark.createDataFrame([(i, v, label, 3, "x") for i, v, label in rows], SCHEMA).repartition(4)
    got = hard_negatives(df, every=20, block=block, anchors_block=10)
    assert sorted(map(tuple, got.collect())) == plain(rows, 20)


def test_rows_that_take_no_part(spark):
    rows = planted(200, 4, 1, 4)
    bad = [(None, [1.0] * 4, 1), (1001, None, 1), (1002, [1.0] * 4, None), (1003, [1.0, None, 1.0, 1.0], 1), (1004, [math.nan, 1.0, 1.0, 1.0], 1), (1005, [math.inf] * 4, 1), (1006, [9.0] * 3, 1), (1007, [], 1)]
    again = [rows[0], rows[3], (5, [-9.0] * 4, 0)]
    df = spark.createDataFrame([(i, v, label, 0, "") for i, v, label in rows + bad + again], SCHEMA)
    assert sorted(map(tuple, hard_negatives(df, every=10).collect())) == plain(rows + again, 10)
    assert hard_negatives(df.limit(0)).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2.0**19)) for _ in range(6)], i % 2) for i in range(60)]
    df = spark.createDataFrame([(i, v, label, 0, "") for i, v, label in rows], SCHEMA)
    assert sorted(map(tuple, hard_negatives(df, every=10).collect())) == plain(rows, 10)
    huge = spark.createDataFrame([(i, [1e30, 1.0], 0, 0, "") for i in range(3)], SCHEMA)
    with pytest.raises(Exception, match="beyond 64 bits"):
        hard_negatives(huge).collect()


def test_bounds_hold_on_every_level_and_prune():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(size=(500, 64)) * 32)
    own = Summaries(vectors).levels
    assert [m.shape[1] for m, _ in own] == [1, 4, 16] or len(own) > 2
    scores = vectors @ vectors.T
    rooms = []
    for mean, dev in own:
        middle, room = mean @ mean.T, dev @ dev.T
        assert (np.abs(scores - middle) <= room * (1 + 1e-9) + 1e-6).all()
        rooms.append(room.mean())
    assert rooms == sorted(rooms, reverse=True)
    block = Block(np.arange(500), np.zeros(500, dtype=int), vectors)
    kept = block.likely(np.arange(500), vectors[0], [(m[0], d[0]) for m, d in own], 1, lambda s: negatives._best(s, 1))
    assert 0 in kept and block.scored + len(kept) < 500


def test_anchors_below_zero_and_labels_by_rule(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 0, ""), (1, [-1.0], 0, 0, ""), (2, [-1.0], 1, 0, ""), (100, [0.0], 0, 0, ""), (7, [0.5], 0, 0, "")], SCHEMA)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = [(0, [1.0], 1), (1, [-1.0], 0), (2, [-1.0], 1), (100, [0.0], 0), (7, [0.5], 1)]
    assert sorted(map(tuple, hard_negatives(df, label=shifted).collect())) == plain(own)
