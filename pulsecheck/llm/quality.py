"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Features of a line are its character shares, length and repetition, and the same of the lines before and after it.
Forward and backward sums give every line's marginal probability of being good; a document's quality is their mean,
weighted by the lines' lengths.

Fitted in numpy (Adam on the conditional log-likelihood) on at most `sample` labelled documents of each class and at
most `lines` lines of each of them, numbers that do not depend on the table; each line of a labelled document is
taken to have its label, and the classes are weighted back to their shares in the labelled rows.

Null text counts as empty; an empty text is one empty line. Without labels of both classes the score is the share of
good labels (1 without any). Repeated rows are scored each. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecheck.llm.common import batch_of, byte_texts, fields, per_slice, pick
from pulsecheck.llm.samples import by_class, labelled, remainder

#: Labelled documents of each class, lines of each of them, steps.
SAMPLE, LINES, STEPS = 1500, 200, 150

#: Bytes by kind: a line's share of each is a feature.
KINDS = {
    "small": b"abcdefghijklmnopqrstuvwxyz",
    "capital": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+<=>@[\\]^_`{}~/",
    "beyond": bytes(range(128, 256)),
}
FEATURES = len(KINDS) + 7


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS), dtype=np.int64)
    for i, of in enumerate(KINDS.values()):
        table[list(of)] = i
    return table


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, 3 * FEATURES + 1) of all lines of all texts, their lengths, and the first line of each text
    (with the number of lines at the end)."""
    split = [t.split(b"\n") for t in texts]
    first = np.concatenate(([0], np.cumsum([len(s) for s in split])))
    lines = [line for s in split for line in s]
    length = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    codes = _kind_table()[np.frombuffer(b"".join(lines), dtype=np.uint8)]
    row = np.repeat(np.arange(len(lines)), length)
    counts = np.bincount(row * (len(KINDS) + 1) + codes, minlength=len(lines) * (len(KINDS) + 1)).reshape(len(lines), -1)[:, : len(KINDS)]
    size = np.maximum(length, 1)
    words, distinct, seen = np.zeros(len(lines)), np.ones(len(lines)), np.zeros(len(lines))
    for t, own in enumerate(split):
        met: set[bytes] = set()
        for i, line in enumerate(own, int(first[t])):
            parts = line.split()
            words[i] = len(parts)
            distinct[i] = len(set(parts)) / len(parts) if parts else 1.0
            if line in met:
                seen[i] = 1.0
            met.add(line)
    share = counts / size[:, None]
    own = np.column_stack(
        [
            share,
            np.log1p(length) / 5,
            np.log1p(words) / 5,
            np.where(words > 0, length / np.maximum(words, 1), 0) / 20,
            1 - distinct,
            (1 - distinct > 0.5) & (words > 3),
            seen,
            share[:, 1] > 0.5,
        ]
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1][first[:-1] < len(lines)]] = 0
    after[first[1:] - 1] = 0
    return np.column_stack([own, before, after, np.ones(len(lines))]), length, first


def marginals(unary: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward sums over all chains at once: each line's log-potentials (lines, 2) and those of the
    transitions (2, 2) to probabilities of the states, sums of probabilities of the transitions, and the sum of the
    logarithms of the chains' totals. Chains are followed in step; those that have ended drop out."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, count = first[:-1][order], n[order]
    forward, backward = np.empty_like(unary), np.zeros_like(unary)
    longest = int(count[0]) if len(count) else 0
    live = [int(np.searchsorted(-count, -t, side="left")) for t in range(longest + 1)]  # chains of more than t lines
    forward[start] = unary[start]
    for t in range(1, longest):
        at = start[: live[t]] + t
        forward[at] = unary[at] + np.logaddexp(forward[at - 1, :1] + change[0], forward[at - 1, 1:] + change[1])
    moves = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        ahead = unary[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(change[:, 0] + ahead[:, :1], change[:, 1] + ahead[:, 1:])
    last = first[1:] - 1
    total = np.logaddexp(forward[last, 0], forward[last, 1])
    each = np.repeat(total, n)
    state = np.exp(forward + backward - each[:, None])
    inner = np.ones(len(unary), dtype=bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    if len(at):
        ahead = unary[at + 1] + backward[at + 1]
        for a in (0, 1):
            for b in (0, 1):
                moves[a, b] = np.exp(forward[at, a] + change[a, b] + ahead[:, b] - each[at])[:].sum()
    return state, moves, float(total.sum())


def gradient(weights: np.ndarray, change: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, importance: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of lines that all have their document's label, and its gradients; one importance for all."""
    unary = np.column_stack([np.zeros(len(x)), x @ weights])
    state, moves, total = marginals(unary, change, first)
    n = np.diff(first)
    label = np.repeat(y, n)
    stays = np.zeros((2, 2))
    for c in (0, 1):
        stays[c, c] = (n[y == c] - 1).sum()
    value = unary[np.arange(len(x)), label].sum() + (stays * change).sum() - total
    return importance * value, importance * (x.T @ (label - state[:, 1])), importance * (stays - moves)


def fit(x: list[np.ndarray], first: list[np.ndarray], share: list[float], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """x and first of each class (bad, good), and the classes' shares."""
    width = x[0].shape[1]
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lines = [len(f) - 1 for f in first]
    for step in range(1, steps + 1):
        slope = -0.002 * theta
        for c in (0, 1):
            _, gw, gt = gradient(theta[:width], theta[width:].reshape(2, 2), x[c], first[c], np.full(lines[c], c), share[c] / lines[c])
            slope += np.concatenate([gw, gt.reshape(-1)])
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2
        theta += 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:width], theta[width:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, lines: int = LINES) -> tuple[np.ndarray, np.ndarray]:
    """The line weights and transitions, from labelled rows with crc32(key) mod 4 other than 2."""
    rows = labelled(docs, labels, label, key, text).where(remainder("key", 4) != 2)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = [counts.get(c, 0) / max(1, sum(counts.values())) for c in (0, 1)]
    width = 3 * FEATURES + 1
    if len(counts) < 2:
        # No choice to learn: the last feature is constant, and lines do not depend on each other.
        weights = np.zeros(width)
        weights[-1] = np.log((share[1] + 1e-9) / (share[0] + 1e-9)) if counts else 20.0
        return weights, np.zeros((2, 2))
    chosen = by_class(rows, "label", "key", sample).select("key", "label", F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n", -1), 1, lines), "\n").alias("text")).toArrow()
    texts, of = byte_texts(chosen.column("text").combine_chunks()), chosen.column("label").to_numpy()
    made = [line_features([t for t, c in zip(texts, of) if c == cls]) for cls in (0, 1)]
    return fit([m[0] for m in made], [m[2] for m in made], share)


def quality(docs: DataFrame, weights: np.ndarray, change: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """key, score, predicted and lines (g or b for each line) of every row."""
    rows = pick(docs, key, text)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, length, first = line_features(byte_texts(batch.column("text")))
            state, _, _ = marginals(np.column_stack([np.zeros(len(x)), x @ weights]), change, first)
            weight = length + 1.0
            score = np.add.reduceat(state[:, 1] * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
            letters = np.where(state[:, 1] >= 0.5, "g", "b")
            lines = ["".join(letters[a:b]) for a, b in zip(first[:-1], first[1:])]
            return batch_of(("key", batch.column("key")), ("score", np.clip(score, 0, 1)), ("lines", pa.array(lines, pa.string())))

        return step

    out = per_slice(rows, make, fields(rows, "key", ("score", "double"), ("lines", "string")))
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "lines")
