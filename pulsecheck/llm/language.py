"""Language identification by a bidirectional gated recurrent network over bytes.

The network runs over the bytes of each word between blanks, forwards and backwards, and gives every position a
probability of each language from both states. A document's probabilities are the means over all its positions.
As a state starts anew with each word, a word that a worker has met before need not be run again.

Trained in numpy by backpropagation through time (Adam) on the words of all labelled documents: Spark counts them by
language, and the random batches are drawn from all of them, a word as often as its counts say. Every position of a word
is to tell the languages in which the word occurs. The languages are those of the labelled rows.

Null text, and text without a letter, is `und` with score 0. Without any labelled row every document is `und`.
Repeated rows are judged each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsecheck.llm.common import batch_of, byte_texts, fields, per_slice, pick, slices
from pulsecheck.llm.samples import remainder
from pulsecheck.sources.shared import settle

#: States in each direction, steps, words in a step.
STATES, STEPS, BATCH = 16, 400, 256
#: A word longer than this runs in parts of this many bytes. Words kept by a worker: to name languages, to tell noise, to count.
LONGEST, KEPT, KEPT_NOISE, KEPT_COUNTS = 32, 400_000, 150_000, 100_000
#: Words that run at once, and bytes of text that are judged at once.
RUN, READ_BYTES = 1_024, 1 << 20
UNKNOWN = "und"


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Gates r and z, candidate h; parameters for both directions in the leading axis."""

    def __init__(self, classes: int, states: int = STATES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.states, self.classes = states, classes
        self.p = {
            "embed": rng.normal(0, 0.3, (2, 256, 3 * states)),
            "gate": rng.normal(0, 0.3, (2, states, 2 * states)),
            "cand": rng.normal(0, 0.3, (2, states, states)),
            "out": rng.normal(0, 0.3, (2 * states, classes)),
            "bias": np.zeros(classes),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, codes: np.ndarray, length: np.ndarray, keep: bool = False):
        """codes (words, time), 0 beyond a word's length. Log-probabilities (words, time, classes), and what the way back needs."""
        n, time = codes.shape
        s = self.states
        inside = np.arange(time)[None, :] < length[:, None]
        turned = np.where(inside, length[:, None] - 1 - np.arange(time)[None, :], 0)
        both = np.stack([codes, np.take_along_axis(codes, turned, 1)])
        states = np.zeros((2, time + 1, n, s), dtype=np.float32)
        trace = []
        for t in range(time):
            before = states[:, t]
            x = np.stack([self.p["embed"][d][both[d, :, t]] for d in (0, 1)])
            gates = _sigmoid(x[..., : 2 * s] + before @ self.p["gate"])
            r, z = gates[..., :s], gates[..., s:]
            cand = np.tanh(x[..., 2 * s :] + (r * before) @ self.p["cand"])
            now = z * before + (1 - z) * cand
            live = inside[None, :, t, None]
            states[:, t + 1] = np.where(live, now, before)
            if keep:
                trace.append((r, z, cand))
        forward = states[0, 1:].transpose(1, 0, 2)
        backward = np.take_along_axis(states[1, 1:].transpose(1, 0, 2), turned[..., None], 1)
        top = np.concatenate([forward, backward], axis=2)
        logits = top @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return logp, (both, inside, turned, states, trace, top)

    def gradient(self, codes, length, target):
        """Loss of every position against its word's target (words, classes), and the gradients through time."""
        logp, (both, inside, turned, states, trace, top) = self.run(codes, length, keep=True)
        n, time = codes.shape
        s, p = self.states, self.p
        weight = inside[..., None] / inside.sum()
        loss = -(weight * target[:, None] * logp).sum()
        d_logits = ((np.exp(logp) - target[:, None]) * weight).astype(np.float32)
        g = {"out": np.einsum("nts,ntc->sc", top, d_logits), "bias": d_logits.sum((0, 1))}
        d_top = d_logits @ p["out"].T
        d_state = np.zeros((2, time, n, s), dtype=np.float32)
        d_state[0] = d_top[..., :s].transpose(1, 0, 2)
        # The backward run's step of place i is length - 1 - i, the same turning as before.
        d_state[1] = (np.take_along_axis(d_top[..., s:], turned[..., None], 1) * inside[..., None]).transpose(1, 0, 2)
        g["embed"], g["gate"], g["cand"] = np.zeros_like(p["embed"]), np.zeros_like(p["gate"]), np.zeros_like(p["cand"])
        carry = np.zeros((2, n, s), dtype=np.float32)
        for t in range(time - 1, -1, -1):
            live = inside[None, :, t, None]
            d = carry + d_state[:, t]
            r, z, cand = trace[t]
            before = states[:, t]
            d_now = np.where(live, d, 0)
            d_cand = d_now * (1 - z) * (1 - cand**2)
            d_z = d_now * (before - cand) * z * (1 - z)
            d_in = d_cand @ p["cand"].transpose(0, 2, 1)
            d_r = d_in * before * r * (1 - r)
            d_gates = np.concatenate([d_r, d_z], axis=2)
            g["cand"] += (r * before).transpose(0, 2, 1) @ d_cand
            g["gate"] += before.transpose(0, 2, 1) @ d_gates
            d_x = np.concatenate([d_gates, d_cand], axis=2)
            for way in (0, 1):
                np.add.at(g["embed"][way], both[way, :, t], d_x[way])
            carry = np.where(live, d_now * z + d_in * r + d_gates @ p["gate"].transpose(0, 2, 1), d)
        return float(loss), g


def as_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words with a blank at both ends; the longest decides the width."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    width = int(length.max())
    flat = np.frombuffer(b"".join((b" " + w + b" ").ljust(width, b"\0") for w in words), dtype=np.uint8)
    return flat.reshape(len(words), width), length


def fit(words: list[bytes], targets: np.ndarray, weights: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over random batches, a word as often as its weight says."""
    net = Network(targets.shape[1], seed=seed)
    rng = np.random.default_rng(seed)
    times = np.floor(weights * (steps * BATCH / weights.sum()) + rng.random(len(words))).astype(np.int64)
    drawn = np.resize(rng.permutation(np.repeat(np.arange(len(words)), times)), (steps, BATCH))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        chosen = drawn[step - 1]
        codes, length = as_codes([words[i] for i in chosen])
        _, g = net.gradient(codes, length, targets[chosen])
        rate = 0.02 * (1 - step / (steps + 1))
        for k in net.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def word_parts(text: bytes) -> list[bytes]:
    """The words between blanks, ASCII letters made small; a very long one in parts."""
    words = text.lower().split()
    if len(text) <= LONGEST or max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def counted(rows: DataFrame) -> DataFrame:
    """label, word, n: how often each word stands in the texts of each label."""
    schema = StructType([rows.schema["label"]]).add("word", "binary").add("n", "long")

    def count(batches):
        from collections import Counter, defaultdict

        def told() -> pa.RecordBatch:
            labels = pa.array([name for name, words in found.items() for _ in words], kind)
            words, n = ([x for of in found.values() for x in take(of)] for take in (Counter.keys, Counter.values))
            return batch_of(("label", labels), ("word", pa.array(words, pa.binary())), ("n", pa.array(n, pa.int64())))

        found, kind = defaultdict(Counter), None
        for batch in batches:
            kind = batch.column("label").type
            for part in slices(batch, limit=READ_BYTES):
                for t, name in zip(byte_texts(part.column("text")), part.column("label").to_pylist()):
                    found[name].update(word_parts(t))
                if sum(map(len, found.values())) > KEPT_COUNTS:
                    yield told()
                    found.clear()
        if found:
            yield told()
        found.clear()
        pa.default_memory_pool().release_unused()

    return rows.select("label", "text").mapInArrow(count, schema).groupBy("label", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", learn: str | None = None, noise: bool = False) -> tuple[list[str], Network | None]:
    """The languages, sorted, and the network. `learn`: SQL condition of the rows to learn from, all of which are counted. With `noise` the
    network has one class more, behind the languages, for strings of bytes that follow no language."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").alias("label"), (F.expr(learn) if learn else F.lit(True)).alias("learn"))
    words = settle(counted(rows.where("learn AND label IS NOT NULL")), "words")
    total = words.groupBy("label").agg(F.sum("n").alias("total"))
    names = sorted(r["label"] for r in total.collect())
    if not names:
        return [], None
    # Each language weighs the same.
    share = words.join(F.broadcast(total), "label").select("word", "label", (F.col("n") / F.col("total")).alias("share"))
    by_word = share.groupBy("word").agg(F.sqrt(F.sum("share")).alias("weight"), F.collect_list(F.struct("label", "share")).alias("of"))
    by_word = settle(by_word, "weights")
    # Of all words those that the batches take, a word as often as its weight says; what is left of a whole number by the word's hash.
    draws = STEPS * BATCH * len(names) / (len(names) + 1 if noise else len(names))
    sum_ = by_word.agg(F.sum("weight")).collect()[0][0]
    by_hash = F.shiftrightunsigned(F.xxhash64("word"), 11) / F.lit(float(1 << 53))
    drawn = by_word.withColumn("times", F.floor(F.col("weight") * F.lit(draws / sum_) + by_hash)).where("times > 0").select("word", "times", "of").collect()
    drawn.sort(key=lambda r: r["word"])
    place = {n: i for i, n in enumerate(names)}
    chosen, weights = [bytes(r["word"]) for r in drawn], np.array([r["times"] for r in drawn], dtype=float)
    targets = np.zeros((len(drawn), len(names)))
    for i, r in enumerate(drawn):
        for name, x in r["of"]:
            targets[i, place[name]] = x
    targets = (targets / targets.sum(axis=1, keepdims=True)).astype(np.float32)
    if noise:
        strings = noise_like(chosen, weights)
        targets = np.concatenate([np.pad(targets, ((0, 0), (0, 1))), np.tile(np.eye(len(names) + 1, dtype=np.float32)[-1:], (len(strings), 1))])
        # Noise weighs as much as a language.
        weights = np.concatenate([weights, np.full(len(strings), weights.sum() / len(names) / max(1, len(strings)))])
        chosen = chosen + strings
    return names, fit(chosen, targets, weights)


def noise_like(words: list[bytes], weights: np.ndarray, seed: int = 11) -> list[bytes]:
    """As many strings as words, of the words' lengths: half of them of bytes as frequent as in the words, half of printable
    bytes at random. None is a word."""
    rng = np.random.default_rng(seed)
    length = np.array([len(w) for w in rng.choice(np.array(words, dtype=object), size=len(words), p=weights / weights.sum())])
    share = np.zeros(256)
    for w, x in zip(words, weights):
        np.add.at(share, np.frombuffer(w, dtype=np.uint8), x)
    printable = np.arange(33, 127)
    drawn = rng.choice(256, size=length.sum(), p=share / share.sum()).astype(np.uint8)
    uniform = rng.choice(printable, size=length.sum()).astype(np.uint8)
    ends = np.cumsum(length)
    known = set(words)
    strings = [(drawn if i % 2 else uniform)[e - n : e].tobytes() for i, (e, n) in enumerate(zip(ends.tolist(), length.tolist()))]
    return [x for x in strings if x not in known]


class Judge:
    """Position sums of words, kept in one matrix, and the pooling over documents."""

    def __init__(self, net: Network, kept: int = KEPT):
        self.net, self.kept = net, kept
        self.forget()

    def forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.sums = np.zeros((0, self.net.classes + 1))

    def learn(self, words: set[bytes]) -> None:
        if len(self.row) > self.kept:
            self.forget()
        new = sorted((w for w in words if w not in self.row), key=len)
        parts = [self.sums]
        for i in range(0, len(new), RUN):
            codes, length = as_codes(new[i : i + RUN])
            logp, _ = self.net.run(codes, length)
            inside = np.arange(codes.shape[1])[None, :, None] < length[:, None, None]
            parts.append(np.column_stack([(np.exp(logp) * inside).sum(axis=1), length]))
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        self.sums = np.concatenate(parts)

    def rows(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each text the rows of its words, which are learnt before."""
        split = [word_parts(t) for t in texts]
        seen: set[bytes] = set()
        for words in split:
            seen.update(words)
        self.learn(seen)
        return [np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words)) for words in split]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions; zeros without words."""
        return self._pooled(self.rows(texts))

    def _pooled(self, of: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(of), self.net.classes))
        for i, rows in enumerate(of):
            if len(rows):
                total = self.sums[rows].sum(axis=0) if len(rows) < 1 << 16 else np.bincount(rows, minlength=len(self.sums)) @ self.sums
                out[i] = total[:-1] / total[-1]
        return out

    def noise(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the mean probability of the last class over all positions, its deviation from word to word, and the words."""
        of = self.rows(texts)
        pooled = self._pooled(of)[:, -1]
        spread, n = np.zeros(len(texts)), np.zeros(len(texts))
        for i, rows in enumerate(of):
            n[i] = len(rows)
            if len(rows):
                spread[i] = (self.sums[rows, -2] / self.sums[rows, -1]).std()
        return pooled, spread, n


def _judging(names: list[str], net: Network | None):
    """A function from an Arrow column of texts to (languages, scores)."""
    from regex import compile as pattern

    letter = pattern(r"\p{L}")
    judge = Judge(net) if net else None

    def judged(column: pa.Array) -> tuple[list[str], list[float]]:
        texts = byte_texts(column)
        pooled = judge.pooled(texts) if judge else None
        languages, scores = [], []
        for i, t in enumerate(texts):
            if judge is None or not letter.search(t.decode()):
                languages.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(pooled[i].argmax())  # of equal ones the first by name
                languages.append(names[best])
                scores.append(min(1.0, float(pooled[i, best])))
        return languages, scores

    return judged


def identify(docs: DataFrame, names: list[str], net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of every row."""
    rows = pick(docs, key, text)

    def make():
        judged = _judging(names, net)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            languages, scores = judged(batch.column("text"))
            return batch_of(("key", batch.column("key")), ("lang_pred", pa.array(languages, pa.string())), ("score", pa.array(scores, pa.float64())))

        return step

    return per_slice(rows, make, fields(rows, "key", ("lang_pred", "string"), ("score", "double")), size=READ_BYTES).withColumnRenamed("key", key)


#: A document is told from text of the languages learnt by so many standard errors of its words at least.
ERRORS = 4.0
#: The share of noise below which no bar is set.
LEAST_NOISE = 0.25


class Spoken:
    """Whether a text is in the languages that a network with a class for noise has learnt."""

    def __init__(self, net: Network):
        self.net = net
        self.bar, self.spread = np.inf, 0.0

    def judge(self):
        """A function from an Arrow column of texts to whether they are spoken; texts without a letter are not."""
        from regex import compile as pattern

        letter, judge = pattern(r"\p{L}"), Judge(self.net, KEPT_NOISE)

        def spoken(column: pa.Array) -> list[bool]:
            texts = byte_texts(column)
            share, spread, n = judge.noise(texts)
            # A text of few words is given the errors of its length.
            error = np.maximum(spread, self.spread) / np.sqrt(np.maximum(n, 1))
            fits = share - ERRORS * error <= self.bar
            return [bool(f) and letter.search(t.decode()) is not None for f, t in zip(fits, texts)]

        return spoken


def spoken(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", label: str = "lang") -> Spoken:
    """The bar is what the network takes for noise in the noisiest of the labelled texts of the contract's fold, none of which it was
    trained on, and a quarter at least: less is far more language than noise, whatever the texts."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").alias("label"), held_out(key).alias("held"))

    def make():
        from regex import compile as pattern

        letter, judge = pattern(r"\p{L}"), Judge(net, KEPT_NOISE)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t for t in byte_texts(batch.column("text")) if letter.search(t.decode())]
            share, spread, _ = judge.noise(texts)
            return batch_of(("most", np.array([share.max(initial=0.0)])), ("spread", np.array([spread.sum()])), ("n", np.array([len(texts)])))

        return step

    schema = StructType().add("most", "double").add("spread", "double").add("n", "long")
    found = per_slice(rows.where("held AND label IS NOT NULL").select("text"), make, schema, size=READ_BYTES)
    most, spread, n = found.agg(F.max("most"), F.sum("spread"), F.sum("n")).collect()[0]
    out = Spoken(net)
    if n:
        out.bar, out.spread = max(LEAST_NOISE, most), spread / n
    return out


def in_known_language(docs: DataFrame, model: Spoken, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text is spoken; all columns as they were."""
    columns = docs.columns
    at = columns.index(text)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))

    def judge(batches):
        judged = None
        for batch in batches:
            judged = judged or model.judge()
            row = batch.column("row")
            for part in slices(batch_of(("row", row), ("text", row.field(at).cast(pa.string()))), limit=READ_BYTES):
                yield batch_of(("row", part.column("row").filter(pa.array(judged(part.column("text")), pa.bool_()))))
            pa.default_memory_pool().release_unused()

    kept = rows.mapInArrow(judge, StructType([rows.schema["row"]]))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in columns))


def held_out(key: str = "doc_id") -> Column:
    """The fold of the contract."""
    return F.coalesce(remainder(key, 5) == 0, F.lit(False))
