"""Exact order statistics and the largest gap of two distributions, with few values moved.

A pass counts both sides of all columns by ranges of values. Most ranges cannot matter: they hold no rank that is asked for, and
the gap between the two running shares cannot grow inside them beyond the largest one seen at a border. Ranges that can matter are cut
finer and counted again, and at the end only the values of those that are left are moved, each range to its own place. What a
counting pass moves is one row for a range and task, however many rows the table has.
"""

from __future__ import annotations

import bisect
import math
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecheck.functions.literal import local_table
from pulsecheck.functions.ordering import cut_points, locate
from pulsecheck.sources.shared import settle

#: Ranges of a column in the first pass, cut points of one pass over all columns, and into how many a range is cut at least.
RANGES, POINTS, FINER = 1024, 1 << 18, 16
#: Rows of open ranges from which they are cut once more, and passes.
MOVED, PASSES = 2_000_000, 6
SIDES = ("ref", "cur")
COUNTS = ("SUM(IF(is_ref, 1L, 0L)) AS ref", "SUM(IF(is_ref, 0L, 1L)) AS cur")


def place_of(x: float) -> int:
    """Doubles by number, in their order; neighbours differ by one."""
    bits = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def at_place(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n))[0] if n >= 0 else -struct.unpack("<d", struct.pack("<q", -n))[0]


@dataclass
class Range:
    """Values from `low` to `high`, both of which occur, with the rows of both sides in it and before it."""

    low: float
    high: float
    rows: dict[str, int]
    before: dict[str, int] = field(default_factory=dict)


@dataclass
class Facts:
    """One column: rows and sums by side, the largest gap, and the value at each rank that was asked for."""

    n: dict[str, int]
    total: dict[str, float]
    gap: float = 0.0
    at_rank: dict[tuple[str, int], float] = field(default_factory=dict)
    below: dict[tuple[str, float], int] = field(default_factory=dict)

    def mean(self, side: str) -> float | None:
        return self.total[side] / self.n[side] if self.n[side] else None

    def quantile(self, side: str, share: float) -> float | None:
        """Linear between the two values next to the place."""
        if not self.n[side]:
            return None
        rank, part = _place(self.n[side], share)
        low, high = self.at_rank[side, rank], self.at_rank[side, min(rank + 1, self.n[side] - 1)]
        return high - (high - low) * (1.0 - part) if part >= 0.5 else low + (high - low) * part


def _place(n: int, share: float) -> tuple[int, float]:
    place = float(n - 1) * share
    return math.floor(place), place - math.floor(place)


def _ranks(n: int, shares: Sequence[float]) -> set[int]:
    found = {_place(n, s)[0] for s in shares} if n else set()
    return found | {min(r + 1, n - 1) for r in found}


def select(
    cells: Callable[[Sequence[int]], DataFrame],
    thin: Callable[[], DataFrame],
    n_columns: int,
    shares: dict[str, Sequence[float]],
    gap: bool = False,
    edges: Callable[[Facts], Sequence[float]] | None = None,
) -> list[Facts]:
    """Facts of columns 0 to `n_columns` - 1. `edges`, if given, are points that follow from a column's quantiles: the rows of each side
    below every one are counted too (`below`).

    `cells(numbers)` gives (column_no, is_ref, value) of the columns with these numbers, `thin()` a thin draw of all of them, of which
    nothing depends but how well ranges are balanced.
    """
    spark = thin().sparkSession
    per_column = max(8, min(RANGES, POINTS // max(1, n_columns)))
    drawn = thin().groupBy("column_no").agg(cut_points("value", per_column).alias("points")).collect()
    points = {r["column_no"]: r["points"] or [] for r in drawn}
    counted = _count(spark, cells(range(n_columns)), {i: points.get(i, []) for i in range(n_columns)}, sums=True)
    facts = []
    ranges: dict[int, list[Range]] = {}
    for i in range(n_columns):
        rows = sorted(counted.get(i, []), key=lambda r: r["range_id"])
        facts.append(Facts({s: sum(r[s] for r in rows) for s in SIDES}, {s: sum(r[f"{s}_sum"] for r in rows) for s in SIDES}))
        ranges[i] = _placed([Range(r["low"], r["high"], {s: r[s] for s in SIDES}) for r in rows], dict.fromkeys(SIDES, 0))
    leaves = dict(ranges)
    wanted = {i: {(s, r) for s in shares for r in _ranks(facts[i].n[s], shares[s])} for i in range(n_columns)}
    opened = {i: _settle(facts[i], ranges[i], wanted[i], gap) for i in range(n_columns)}
    for _ in range(PASSES):
        opened = {i: found for i, found in opened.items() if found}
        rows, n_open = (sum(f(r) for found in opened.values() for r in found) for f in (lambda r: sum(r.rows.values()), lambda r: 1))
        finer = min(RANGES, POINTS // max(1, n_open))
        if rows <= MOVED or finer < FINER:
            break
        order = list(opened)
        cut = {k: sorted(_cuts(opened[i], finer)) for k, i in enumerate(order)}
        counted = _count(spark, cells(order), cut)
        for k, i in enumerate(order):
            parts = _inside(opened[i], counted.get(k, []))
            whole = {id(r) for r in opened[i]}
            leaves[i] = sorted([r for r in leaves[i] if id(r) not in whole] + parts, key=lambda r: r.low)
            opened[i] = _settle(facts[i], parts, wanted[i], gap)
    opened = {i: found for i, found in opened.items() if found}
    moved = _finish(spark, cells, facts, opened, wanted, gap) if opened else None
    if edges:
        _count_below(spark, cells, facts, leaves, opened, moved, edges)
    return facts


def _placed(ranges: list[Range], before: dict[str, int]) -> list[Range]:
    """Ranges in order, each with the rows before it."""
    before = dict(before)
    for r in ranges:
        r.before = dict(before)
        for s in SIDES:
            before[s] += r.rows[s]
    return ranges


def _cuts(opened: Sequence[Range], finer: int) -> set[float]:
    """Points that cut every open range into `finer` parts, equal in number of doubles, and part it from what lies above."""
    points: set[float] = set()
    for r in opened:
        low, high = place_of(r.low), place_of(r.high)
        points |= {at_place(low + (high - low) * k // finer) for k in range(finer)} | {r.low, r.high}
        if r.high < math.inf:
            points.add(at_place(high + 1))
    return points


def _count(spark, cells: DataFrame, points: dict[int, Sequence[float]], sums: bool = False) -> dict[int, list]:
    """By column: rows of both sides, least and largest value of every range between the points that holds a value."""
    longest = max(map(len, points.values()), default=0)
    table = local_table(spark, [(i, list(p)) for i, p in points.items()], "column_no int, points array<double>")
    figures = [*COUNTS, "MIN(value) AS low", "MAX(value) AS high"]
    if sums:
        figures += ["SUM(IF(is_ref, value, 0D)) AS ref_sum", "SUM(IF(is_ref, 0D, value)) AS cur_sum"]
    # At most POINTS points over all columns.
    located = locate(cells.join(F.broadcast(table), "column_no"), F.col("value"), F.col("points"), max(1, longest), "range_id")
    found: dict[int, list] = {}
    for row in located.groupBy("column_no", "range_id").agg(*map(F.expr, figures)).collect():
        found.setdefault(row["column_no"], []).append(row)
    return found


def _inside(opened: Sequence[Range], counted: Sequence) -> list[Range]:
    """The counted ranges that lie in an open one, each with the rows before it."""
    rows = sorted(counted, key=lambda r: r["low"])
    out, k = [], 0
    for r in opened:
        own = []
        while k < len(rows) and rows[k]["low"] <= r.high:
            if rows[k]["low"] >= r.low:
                own.append(Range(rows[k]["low"], rows[k]["high"], {s: rows[k][s] for s in SIDES}))
            k += 1
        out += _placed(own, r.before)
    return out


def _settle(facts: Facts, ranges: Sequence[Range], wanted: set[tuple[str, int]], gap: bool) -> list[Range]:
    """Note what the ranges tell, and return those that have to be looked into."""
    n, m = (facts.n[s] for s in SIDES)
    compared = gap and n > 0 and m > 0
    if compared:
        for r in ranges:
            after = abs((r.before["ref"] + r.rows["ref"]) / n - (r.before["cur"] + r.rows["cur"]) / m)
            facts.gap = max(facts.gap, after)
    opened = []
    for r in ranges:
        here = {(s, k) for s, k in wanted if r.before[s] <= k < r.before[s] + r.rows[s]}
        if r.low == r.high:
            facts.at_rank.update(dict.fromkeys(here, r.low))
            continue
        f, g = r.before["ref"] / n if n else 0.0, r.before["cur"] / m if m else 0.0
        most = max(abs(f + r.rows["ref"] / n - g), abs(f - g - r.rows["cur"] / m)) if compared else 0.0
        if here or (compared and most > facts.gap * (1 - 1e-12)):
            opened.append(r)
    return opened


def _finish(spark, cells, facts: list[Facts], opened: dict[int, list[Range]], wanted, gap: bool) -> DataFrame:
    """Move the values of the open ranges, each range to its own window; returns their counts."""
    order = list(opened)
    points, table = {}, []
    for k, i in enumerate(order):
        points[k] = [p for r in opened[i] for p in (r.low, at_place(place_of(r.high) + 1) if r.high < math.inf else math.nan)]
        points[k] = [p for p in points[k] if not math.isnan(p)]
        before = [r.before for r in opened[i]]
        ranks = sorted((s, k2) for s, k2 in wanted[i] if (s, k2) not in facts[i].at_rank)
        table.append((k, points[k], [b["ref"] for b in before], [b["cur"] for b in before], facts[i].n["ref"], facts[i].n["cur"], [r for s, r in ranks if s == "ref"], [r for s, r in ranks if s == "cur"]))
    schema = "column_no int, points array<double>, before_ref array<long>, before_cur array<long>, all_ref long, all_cur long, ranks_ref array<long>, ranks_cur array<long>"
    known = F.broadcast(local_table(spark, table, schema))
    located = locate(cells(order).join(known.select("column_no", "points"), "column_no"), F.col("value"), F.col("points"), max(map(len, points.values())), "range_id")
    # By a join, as a condition on the place would be pushed below the search and repeat it for each of its steps. One row an open range.
    places = local_table(spark, [(k, 2 * n + 1, n) for k, i in enumerate(order) for n in range(len(opened[i]))], "column_no int, range_id int, range_no int")
    inside = located.join(F.broadcast(places), ["column_no", "range_id"]).select("column_no", "range_no", "is_ref", "value")
    counts = settle(inside.groupBy("column_no", "range_no", "value").agg(*map(F.expr, COUNTS)), "open-values")
    so_far = "OVER (PARTITION BY column_no, range_no ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    running = counts.selectExpr("column_no", "range_no", "value", "ref", "cur", *[f"SUM({s}) {so_far} AS in_{s}" for s in SIDES])
    totals = running.join(known, "column_no").selectExpr(
        "column_no", "value", "ref", "cur", "all_ref", "all_cur", "ranks_ref", "ranks_cur", *[f"before_{s}[range_no] + in_{s} AS cum_{s}" for s in SIDES]
    )
    share = "CAST(cum_{s} AS DOUBLE) / CAST(all_{s} AS DOUBLE)"
    # A rank's value is the one whose own rows hold it.
    held = [f"FILTER(ranks_{s}, r -> r >= cum_{s} - {s} AND r < cum_{s})" for s in SIDES]
    at_a_rank = " ".join(["STRUCT(value,", ", ".join(f"{h} AS at_{s}" for h, s in zip(held, SIDES)), ") AS found"])
    # One row a column: the largest gap, and the values that hold a rank, of which there are no more than ranks.
    largest = f"MAX(ABS({share.format(s='ref')} - {share.format(s='cur')})) AS gap" if gap else "CAST(NULL AS DOUBLE) AS gap"
    held_only = "COLLECT_LIST(IF(SIZE(found.at_ref) + SIZE(found.at_cur) > 0, found, NULL)) AS found"
    for row in totals.selectExpr("*", at_a_rank).groupBy("column_no").agg(F.expr(largest), F.expr(held_only)).collect():
        own = facts[order[row["column_no"]]]
        if row["gap"] is not None and min(own.n.values()) > 0:
            own.gap = max(own.gap, row["gap"])
        for found in row["found"]:
            for s in SIDES:
                own.at_rank.update({(s, r): found["value"] for r in found[f"at_{s}"]})
    return counts


def _count_below(spark, cells, facts: list[Facts], leaves, opened, moved: DataFrame | None, edges) -> None:
    """Rows below each edge: from the counts before the range it falls into, and, inside an open one, from the values that were moved.
    Only for an edge inside another range the table is read once more."""
    numbers = {i: k for k, i in enumerate(opened)}
    asked, left = [], {}
    for i, own in enumerate(facts):
        highs = [r.high for r in leaves[i]]
        places = {id(r): n for n, r in enumerate(opened.get(i, ()))}
        for edge in edges(own):
            at = bisect.bisect_left(highs, edge)
            if at == len(highs) or edge <= leaves[i][at].low:
                before = own.n if at == len(highs) else leaves[i][at].before
                own.below.update({(s, edge): before[s] for s in SIDES})
            elif id(leaves[i][at]) in places:
                own.below.update({(s, edge): leaves[i][at].before[s] for s in SIDES})
                asked.append((numbers[i], places[id(leaves[i][at])], edge))
            else:
                left.setdefault(i, []).append(edge)
    if asked:
        order = list(opened)
        points = F.broadcast(local_table(spark, asked, "column_no int, range_no int, edge double"))  # edges of columns
        found = moved.join(points, ["column_no", "range_no"]).where("value < edge").groupBy("column_no", "edge").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
        for row in found.collect():
            for s in SIDES:
                facts[order[row["column_no"]]].below[s, row["edge"]] += row[s]
    if left:
        order = list(left)
        points = {k: sorted(left[i]) for k, i in enumerate(order)}
        counted = _count(spark, cells(order), points)
        for k, i in enumerate(order):
            for n, edge in enumerate(points[k]):
                for s in SIDES:
                    facts[i].below[s, edge] = sum(r[s] for r in counted.get(k, []) if r["range_id"] <= n)
