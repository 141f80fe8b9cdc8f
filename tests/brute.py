"""Slow, plain versions of the statistics, for comparison on small frames."""

import math

import numpy as np


def quantile(values, share):
    """Linear between the two values next to the place."""
    values = sorted(values)
    place = (len(values) - 1) * share
    below = int(place // 1)
    above = min(below + 1, len(values) - 1)
    return values[below] + (values[above] - values[below]) * (place - below)


def psi(ref, cur, bins=10):
    sides = [[v for v in side if v == v and v is not None] for side in (ref, cur)]
    cuts = {quantile(sides[0], i / bins) for i in range(bins + 1)} if min(map(len, sides)) >= 20 else set()
    if len(cuts) < 3:
        return 0.0
    (ref, cur), edges = sides, sorted(cuts)
    inner = edges[1:-1]
    total = 0.0
    for b in range(len(inner) + 1):
        r = sum(1 for v in ref if sum(e <= v for e in inner) == b) / len(ref)
        c = sum(1 for v in cur if sum(e <= v for e in inner) == b) / len(cur)
        r, c = max(r, 1e-6), max(c, 1e-6)
        total += (c - r) * math.log(c / r)
    return total


def ks(ref, cur):
    ref = [v for v in ref if v is not None and not math.isnan(v)]
    cur = [v for v in cur if v is not None and not math.isnan(v)]
    if len(ref) < 20 or len(cur) < 20:
        return 0.0
    return max(abs(sum(v <= x for v in ref) / len(ref) - sum(v <= x for v in cur) / len(cur)) for x in set(ref) | set(cur))


def score_points(y, p):
    """(score, tp, fp) per distinct score, high to low."""
    return [(s, sum(1 for a, b in zip(y, p) if b >= s and a == 1), sum(1 for a, b in zip(y, p) if b >= s and a == 0)) for s in sorted(set(p), reverse=True)]


def roc(y, p):
    """(threshold, fpr, tpr) without the points inside straight runs."""
    points = score_points(y, p)
    pos, neg = sum(y), len(y) - sum(y)
    kept = []
    for i, (s, tp, fp) in enumerate(points):
        if 0 < i < len(points) - 1:
            before, after = points[i - 1], points[i + 1]
            if (tp - before[1], fp - before[2]) == (after[1] - tp, after[2] - fp):
                continue
        kept.append((s, fp / neg, tp / pos))
    return [(None, 0.0, 0.0), *kept]


def auc(y, p):
    pairs = [(a, b) for a, ya in zip(p, y) if ya == 1 for b, yb in zip(p, y) if yb == 0]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


def average_precision(y, p):
    pos, last, total = sum(y), 0.0, 0.0
    for _, tp, fp in score_points(y, p):
        recall = tp / pos
        total += (recall - last) * tp / (tp + fp)
        last = recall
    return total


def macro(y, p):
    labels = sorted(set(y) | set(p))
    precision, recall, f1 = [], [], []
    for label in labels:
        tp = sum(a == label and b == label for a, b in zip(y, p))
        a, b = sum(v == label for v in y), sum(v == label for v in p)
        precision.append(tp / b if b else 0.0)
        recall.append(tp / a if a else 0.0)
        f1.append(2 * tp / (a + b) if a + b else 0.0)
    balanced = [r for label, r in zip(labels, recall) if label in y]
    return [np.mean(v) for v in (precision, recall, f1)] + [np.mean(balanced)]
