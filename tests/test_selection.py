"""Order statistics and the largest gap against sorted lists, with ranges cut again and again."""

import math
import random

import numpy as np
import pytest

from pulsecheck.functions import selection
from pulsecheck.functions.selection import at_place, place_of, select
from tests import brute

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def columns(seed):
    rng = random.Random(seed)
    smooth = [[rng.gauss(0, 1) for _ in range(700)], [rng.gauss(0.3, 1) for _ in range(500)]]
    wide = [[math.exp(rng.uniform(-300, 300)) * rng.choice([-1, 1]) for _ in range(300)], [math.exp(rng.uniform(-200, 300)) for _ in range(300)]]
    hot = [[3.0] * 400 + [rng.uniform(2.999999, 3.000001) for _ in range(50)], [3.0] * 300 + [rng.uniform(2, 4) for _ in range(50)]]
    ends = [[math.inf, -math.inf, 1e308, -1e308, 0.0, -0.0, 5e-324] * 9, [math.inf] * 20 + [0.0] * 5]
    return [smooth, wide, hot, ends, [[7.0] * 30, [7.0] * 30], [[], [1.0]], [[1.0], []], [[], []], [list(map(float, range(90))), list(map(float, range(90)))]]


@pytest.mark.parametrize("ranges,points,moved", [(1024, 1 << 18, 2_000_000), (8, 1 << 12, 0), (8, 1 << 12, 60), (8, 64, 10)])
def test_equals_sorted_lists(spark, monkeypatch, ranges, points, moved):
    for name, value in (("RANGES", ranges), ("POINTS", points), ("MOVED", moved), ("FINER", 2)):
        monkeypatch.setattr(selection, name, value)
    data = columns(ranges + moved)
    rows = [(i, side == 0, v + 0.0) for i, pair in enumerate(data) for side in (0, 1) for v in pair[side]]
    df = spark.createDataFrame(rows, "column_no int, is_ref boolean, value double").repartition(5)

    def cells(numbers):
        numbers = list(numbers)
        own = spark.createDataFrame([(n, k) for k, n in enumerate(numbers)], "column_no int, k int")
        return df.join(own, "column_no").selectExpr("k AS column_no", "is_ref", "value")

    found = select(cells, lambda: df.sample(0.3, seed=1), len(data), {"ref": SHARES, "cur": [0.5]}, gap=True)
    for facts, (ref, cur) in zip(found, data):
        assert facts.n == {"ref": len(ref), "cur": len(cur)}
        for side, values, shares in (("ref", ref, SHARES), ("cur", cur, [0.5])):
            for share in shares:
                got = facts.quantile(side, share)
                want = brute.quantile(values, share) if values else None
                assert got == want or math.isnan(want) or got == pytest.approx(want, rel=1e-12), (share, got, want)
        if ref and cur:
            assert facts.gap == max(abs(sum(v <= x for v in ref) / len(ref) - sum(v <= x for v in cur) / len(cur)) for x in {*ref, *cur})
        else:
            assert facts.gap == 0.0


def test_few_values_are_moved(spark, monkeypatch):
    n, seen = 200_000, []
    monkeypatch.setattr(selection, "MOVED", 20_000)
    finish = selection._finish
    monkeypatch.setattr(selection, "_finish", lambda s, c, f, opened, *a: (seen.append(sum(sum(r.rows.values()) for x in opened.values() for r in x)), finish(s, c, f, opened, *a)))
    df = spark.range(n).selectExpr("0 AS column_no", "id % 2 = 0 AS is_ref", "sqrt(id * 7919 % 200000) + IF(id % 2 = 0, 0, 5) AS value")
    facts = select(lambda _: df, lambda: df.sample(1 / 64, seed=3), 1, {"ref": [i / 10 for i in range(11)]}, gap=True)[0]
    values = np.sqrt(np.arange(n) * 7919 % n)
    ref, cur = np.sort(values[::2]), np.sort(values[1::2] + 5)
    every = np.concatenate([ref, cur])
    assert facts.gap == np.abs(np.searchsorted(ref, every, "right") / len(ref) - np.searchsorted(cur, every, "right") / len(cur)).max()
    assert [facts.quantile("ref", i / 10) for i in range(11)] == pytest.approx(np.quantile(ref, np.linspace(0, 1, 11)).tolist(), rel=1e-12)
    assert seen and seen[0] <= 20_000


def test_places_of_doubles():
    values = [-math.inf, -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, math.inf]
    assert [place_of(v) for v in values] == sorted(place_of(v) for v in values)
    assert all(at_place(place_of(v)) == v for v in values) and at_place(place_of(1.0) + 1) == math.nextafter(1.0, 2)


def test_search_of_a_value_is_not_repeated(spark, monkeypatch):
    """The plan holds each step of the search for a value's range a few times, not twice as often as the step before."""
    plans = []
    monkeypatch.setattr(selection, "settle", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    df = spark.range(20000).selectExpr("0 AS column_no", "id % 2 = 0 AS is_ref", "hash(id) / 7D AS value")
    shares = [i / 32 for i in range(33)]
    (facts,) = select(lambda numbers: df, lambda: df.sample(0.05, seed=1), 1, {"ref": shares})
    values = sorted(r["value"] for r in df.where("is_ref").collect())
    assert [facts.quantile("ref", s) for s in shares] == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)
    assert len(plans) == 1 and plans[0].count("range_id_edges") + plans[0].count("points#") < 60, plans
