"""Nearest neighbours against brute force: recall, exact scores, ties, odd vectors."""

import numpy as np

from pulsecheck.llm.neighbours import nearest
from pulsecheck.llm.queries import op10_neighbours

SF = "/root/testdata/sf0.01"


def slow(ids, x, k=20, every=20):
    out = {}
    for i in np.unique(ids[ids % every == 0]):
        for q in np.flatnonzero(ids == i):
            score = x @ x[q]
            order = np.lexsort((ids, -score))
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order if ids[j] != i][:k]
    return out


def test_recall_and_scores(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.stack(frame.embedding).astype(float)
    truth = slow(frame.vec_id.to_numpy(), x)
    got = op10_neighbours(spark, SF).toPandas()
    place = {i: n for n, i in enumerate(frame.vec_id)}
    hits = 0
    for query, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, 21)) and query not in set(rows.vec_id)
        assert np.allclose(rows.score, [x[place[query]] @ x[place[i]] for i in rows.vec_id], atol=1e-12)
        assert (np.diff(rows.score) <= 0).all()
        hits += len({i for i, _ in truth[query]} & set(rows.vec_id))
    assert len(truth) == got.query_id.nunique() and hits >= 0.9 * 20 * len(truth)


def test_copies_ties_and_odd_vectors(spark):
    """Small enough that every entry is reranked: the result is exact."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (120, 4)).astype(np.float32)
    x[40:100] = x[20]
    x[(x == 0).all(axis=1)] = 1
    rows = [(i, x[i].tolist(), "c") for i in range(120)]
    rows += [rows[7], rows[60], (200, None, "c"), (220, [0.0] * 4, "c"), (240, [1.0, None, 1.0, 1.0], "c"), (260, [float("nan"), 1.0, 1.0, 1.0], "c"), (280, [float("inf"), 1.0, 1.0, 1.0], "c"), (300, [1.0, 2.0], "c"), (None, [1.0] * 4, "c"), (320, [], "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").repartition(6)
    truth = slow(np.arange(120), x.astype(float))
    for block in (20_000, 10):
        got = {}
        for r in nearest(frame, pivots=8, posted=8, visited=8, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == truth
    assert nearest(frame.limit(0)).count() == 0
    one = nearest(frame.where("vec_id = 0"))
    assert one.count() == 0
