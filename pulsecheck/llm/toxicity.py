"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text.

Both have three levels: word pairs of the class, words of the class by the number of different words before them
(continuations), and the continuations of both classes together, which smooth what is rare in either. What falls
short of the absolute discounts - and so every rare expression - is left to the level below, up to the shared one,
where both classes agree. A pair counts once in a distinct text, as copies and repetitions of a text should not speak
twice. The discounts of pairs and of continuations and the length of a passage are those under which the score fits
best on a fold that the counts have not seen, as they have to follow the amount and the kind of text.

A text is compared by the difference of the log-likelihoods a word: over the whole text, and in its most toxic
passage. A logistic regression makes a score of the two; it is fitted on a bounded sample of labelled texts of that
fold. The models that score are then counted over all the folds.

Counts are exact and stay in tables that Spark writes to the shared folder, so they grow with the text. Texts stay
where they are but for copies. Words that are frequent in a sample have a number instead of a hash, which takes less
room and tells what to deal over several tasks; results do not depend on it. What scoring needs of them is a table of evidence: words and pairs for which the classes differ (below the discounts they
agree, and the difference is one constant). Up to HOT rows of it, the most frequent, are broadcast, and half a key (4 bytes)
of each of the others: the words and pairs of a text whose half keys are among these are joined to them.

Null text counts as empty and is scored like a text with no evidence. Without labels of both classes the score is the
share of toxic labels (0 without any). Repeated rows are scored each. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from pulsecheck.llm.common import batch_of, byte_texts, per_slice, pick, words_of
from pulsecheck.llm.samples import SENT, by_class, labelled, moves, remainder
from pulsecheck.sources.shared import settle

#: Discounts of pairs and of continuations, and words of a passage, among which the fit chooses.
PAIR_DISCOUNTS, WORD_DISCOUNTS, PASSAGES = (0.75, 1.5, 3.0, 6.0, 12.0, 24.0, 48.0, 96.0), (0.75, 1.5, 3.0, 6.0, 12.0, 24.0), (1, 2, 3)
#: Texts of each class on which the score is fitted.
SAMPLE = 2000
#: Rows of evidence that are broadcast (16 bytes each); further ones are joined.
HOT = 1_000_000
#: Multipliers that spread pairs over 64 bits.
SPREAD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
START = 1
#: Words of the sample that get a number instead of a hash; the most frequent, whose pairs are dealt over several tasks; words a task remembers.
LISTED, COMMON, KNOWN = 65_000, 1_024, 400_000
#: Bytes of text whose pairs are combined before they move.
COUNTED_BYTES = 8 << 20
#: Bytes of text that are scored at once.
READ_BYTES = 1 << 20


def frequent_words(texts: DataFrame) -> dict[bytes, int]:
    """Numbers from START + 1 for the most frequent words of `texts`: short codes of what is written most often."""

    def count(batches):
        for batch in batches:
            n = Counter()
            for text in byte_texts(batch.column("text")):
                n.update(words_of(text))
            yield batch_of(("word", pa.array(list(n), pa.binary())), ("n", pa.array(list(n.values()), pa.int64())))

    counted = texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(LISTED).select("word").toArrow().column("word").to_pylist()
    return {word: START + 1 + i for i, word in enumerate(top)}


class Coder:
    """Codes of the words of texts: numbers of the listed ones, 64-bit hashes of the others."""

    def __init__(self, listed: dict[bytes, int]):
        self.listed, self.known = listed, dict(listed)

    def codes(self, text: bytes) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known, words = self.known, words_of(text)
        for w in words:
            if w not in known:
                known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def of(self, column: pa.Array) -> list[np.ndarray]:
        if len(self.known) > KNOWN:
            self.known = dict(self.listed)
        return [self.codes(t) for t in byte_texts(column)]


def before(codes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.array([START], np.uint64), codes[:-1]))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key of a pair; of a word, with b = 0."""
    x = (a ^ (a >> np.uint64(31))) * SPREAD + b
    return (x ^ (x >> np.uint64(29))) * MIX


def pair_counts(texts: DataFrame, listed: dict[bytes, int]) -> DataFrame:
    """before, word, n0, n1, h0, h1: in how many ordinary and toxic texts of `texts` (text, label, fitting) a pair
    occurs, those to count and those to fit.

    Most pairs are rare, so what moves is one row for all words that follow a word equally often in a slice. Pairs are dealt
    by their first word; those of common first words in several parts.
    """
    names = ("n0", "n1", "h0", "h1")
    kinds = {"before": LongType(), "part": IntegerType(), "which": IntegerType(), "n": LongType(), "words": ArrayType(LongType())}
    schema = StructType([StructField(n, t) for n, t in kinds.items()])
    spark = texts.sparkSession
    parts = max(1, isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    held = spark.sparkContext.broadcast(listed)

    def make():
        coder = Coder(held.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            which = batch.column("label").to_numpy(zero_copy_only=False) + 2 * batch.column("fitting").to_numpy(zero_copy_only=False)
            a, b, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for codes, c in zip(coder.of(batch.column("text")), which.tolist()):
                if len(codes):
                    _, at = np.unique(mixed(first := before(codes), codes), return_index=True)
                    a.append(first[at])
                    b.append(codes[at])
                    of.append(np.full(len(at), c, np.int64))
            a, b, of = np.concatenate(a), np.concatenate(b), np.concatenate(of)
            _, at, n = np.unique(mixed(mixed(a, b), of.view(np.uint64)), return_index=True, return_counts=True)
            a, b, of = a[at], b[at], of[at]
            part = np.where(a <= START + COMMON, b % np.uint64(parts), np.uint64(0)).astype(np.int64)
            alike = (n * 4 + of) * parts + part
            order = np.lexsort((alike, a))
            a, alike = a[order], alike[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (alike[1:] != alike[:-1]))))
            words = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), pa.array(b[order].view(np.int64)))
            part, of, n = (x[order][first] for x in (part, of, n))
            return batch_of(("before", a[first].view(np.int64)), ("part", part.astype(np.int32)), ("which", of.astype(np.int32)), ("n", n), ("words", words))

        return step

    dealt = per_slice(texts.select("text", "label", "fitting"), make, schema, size=COUNTED_BYTES).repartition("before", "part")
    each = [F.sum(F.when(F.col("which") == i, F.col("n")).otherwise(0)).alias(n) for i, n in enumerate(names)]
    pairs = dealt.select("before", "part", "which", "n", F.explode("words").alias("word"))
    return pairs.groupBy("before", "part", "word").agg(*each).drop("part")


def _over(n: Column, discount: float) -> Column:
    return F.greatest(n - F.lit(float(discount)), F.lit(0.0))


@dataclass
class Level:
    """The level of words: sums over all words, by class; what continuations leave to the shared ones, by discount."""

    follows: list[float]
    rest: dict[float, list[float]]
    shared: float

    def usable(self) -> bool:
        return all(f > 0 for f in self.follows)


def _level(words: DataFrame, names: tuple[str, str, str], discounts: tuple[float, ...]) -> Level:
    f0, f1, both = names
    sums = [F.sum(f0), F.sum(f1), F.sum(both), F.count_if(F.col(both) > 0)]
    sums += [F.sum(_over(F.col(f), d)) for d in discounts for f in (f0, f1)]
    got = [float(x or 0) for x in words.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).collect()[0]]
    follows = got[:2]
    rest = {d: [follows[c] - got[4 + 2 * i + c] for c in (0, 1)] for i, d in enumerate(discounts)}
    return Level(follows, rest, got[2] + 0.5 * (got[3] + 1))


@dataclass
class Models:
    """Counts in shared tables: pairs, and words by their continuations; the folds that fit and all folds."""

    pairs: DataFrame
    words: DataFrame

    @classmethod
    def count(cls, texts: DataFrame, listed: dict[bytes, int]) -> Models:
        pairs = settle(pair_counts(texts, listed), "pairs")
        n, every = ("n0", "n1"), ("n0 + h0", "n1 + h1")
        counts = [F.count_if(F.expr(f"{of} > 0")).alias(name) for name, of in zip(("f0", "f1", "f", "g0", "g1"), (*n, "n0 + n1", *every))]
        return cls(pairs, settle(pairs.groupBy("word").agg(*counts, F.count("*").alias("g")), "words"))

    def evidence(self, pair_discount: float, word_discount: float) -> tuple[DataFrame, float]:
        """a, b, u, v, texts, and a constant. A word's row has it as a and b = 0: u is the difference of its
        log-likelihoods less the constant, v what it adds to the word after it. A pair's has u, what it adds to both."""
        level = _level(self.words, ("g0", "g1", "g"), (word_discount,))
        rest = level.rest[word_discount]
        constant = float(np.log(rest[1] / level.follows[1]) - np.log(rest[0] / level.follows[0]))
        shared = (F.col("g") + 0.5) / level.shared
        likely = [((_over(F.col(f"g{c}"), word_discount) + rest[c] * shared) / level.follows[c]).alias(f"w{c}") for c in (0, 1)]
        words = self.words.select("word", "g", *likely, (F.greatest("g0", "g1") > word_discount).alias("differs"))
        every = self.pairs.select("before", "word", *((F.col(f"n{c}") + F.col(f"h{c}")).alias(f"n{c}") for c in (0, 1)))
        kept = [_over(F.col(f"n{c}"), pair_discount).alias(f"k{c}") for c in (0, 1)]
        first = every.groupBy("before").agg(*(F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)), *(F.sum(k).alias(f"l{c}") for c, k in enumerate(kept)))
        first = first.where("l0 > 0 OR l1 > 0")
        left = [F.when(F.col(f"t{c}") > 0, (F.col(f"t{c}") - F.col(f"l{c}")) / F.col(f"t{c}")).otherwise(1.0) for c in (0, 1)]
        none = F.lit(0.0)
        of_word = words.where("differs").select(F.col("word").alias("a"), (F.log("w1") - F.log("w0") - constant).alias("u"), none.alias("v"), F.col("g").alias("texts"))
        of_first = first.select(F.col("before").alias("a"), none.alias("u"), (F.log(left[1]) - F.log(left[0])).alias("v"), (F.col("t0") + F.col("t1")).alias("texts"))
        single = of_word.union(of_first).groupBy("a").agg(F.sum("u").alias("u"), F.sum("v").alias("v"), F.max("texts").alias("texts")).select("a", F.lit(0).cast("long").alias("b"), "u", "v", "texts")
        some = every.where(F.greatest("n0", "n1") > pair_discount).select("before", "word", *kept, (F.col("n0") + F.col("n1")).alias("texts"))
        both = some.join(first, "before").join(words.select("word", "w0", "w1"), "word")
        more = [F.log1p(F.when(F.col(f"k{c}") > 0, F.col(f"k{c}") / ((F.col(f"t{c}") - F.col(f"l{c}")) * F.col(f"w{c}"))).otherwise(0.0)) for c in (0, 1)]
        pair = both.select(F.col("before").alias("a"), F.col("word").alias("b"), (more[1] - more[0]).alias("u"), none.alias("v"), "texts")
        return settle(single.union(pair), "evidence"), constant


class Places:
    """Where keys stand in a sorted array of unsigned numbers that are spread evenly, as hashes are."""

    def __init__(self, key: np.ndarray):
        self.key = key
        bits = max(1, len(key).bit_length())
        self.shift = key.dtype.type(8 * key.dtype.itemsize - bits)
        self.start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((key >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        found = np.full(len(key), -1)
        range_ = (key >> self.shift).astype(np.int64)
        at, end = self.start[range_], self.start[range_ + 1]
        left = np.flatnonzero(at < end)
        at, end, key = at[left], end[left], key[left]
        while len(left):
            here = self.key[at]
            found[left[here == key]] = at[here == key]
            at = at + 1
            more = (here < key) & (at < end)
            left, at, end, key = left[more], at[more], end[more], key[more]
        return found


class Numbers(dict):
    """A number for each word met, and by number the code; 0 is the start of a text."""

    def __init__(self, listed: dict[bytes, int]):
        from xxhash import xxh3_64_intdigest

        super().__init__(zip(listed, range(1, len(listed) + 1)))
        self.codes, self.hash = [START, *listed.values()], xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.codes)
        self.codes.append(self.hash(word))
        return n


class Evidence:
    """Evidence in a table: the most frequent rows to be broadcast, the others (k, u, v) to be joined (None if there are none)."""

    def __init__(self, table: DataFrame, constant: float, listed: dict[bytes, int], hot: int = HOT):
        self.constant, self.listed = constant, listed
        self.rest, top, self.halves = None, table, np.zeros(0, np.uint32)
        if table.count() > hot:
            # Frequencies in steps of an eighth of a power of two: at most some 500 rows.
            step = F.floor(F.log2(F.col("texts") + 1) * 8)
            sizes = sorted(((r["step"], r["count"]) for r in table.groupBy(step.alias("step")).count().collect()), reverse=True)
            fits = [s for (s, _), sum_ in zip(sizes, np.cumsum([n for _, n in sizes])) if sum_ <= hot]
            bar = fits[-1] if fits else sizes[0][0] + 1
            self.rest, top = settle(keyed(table.where(step < bar)), "rest"), table.where(step >= bar)
            # Half of the bits of each key: nearly all that is no evidence is known without a join.
            half = F.shiftright("k", 32).cast("int").alias("half")
            self.halves = np.unique(self.rest.select(half).toArrow().column("half").to_numpy().view(np.uint32))
        got = keyed(top).toArrow()
        key, u, v = (got.column(n).to_numpy() for n in ("k", "u", "v"))
        key = key.view(np.uint64)
        order = np.argsort(key)
        self.key, self.u, self.v = key[order], u[order].astype(np.float32), v[order].astype(np.float32)


def keyed(table: DataFrame) -> DataFrame:
    """k, u, v of rows of evidence: one key of a and b."""

    def key(batches):
        for batch in batches:
            a, b = (batch.column(n).to_numpy().view(np.uint64) for n in ("a", "b"))
            yield batch_of(("k", mixed(a, b).view(np.int64)), ("u", batch.column("u")), ("v", batch.column("v")))

    return table.select("a", "b", "u", "v").mapInArrow(key, "k long, u double, v double")


class Reader:
    """Texts in the light of the broadcast evidence, all texts of a slice at once."""

    def __init__(self, constant: float, listed: dict[bytes, int], key: np.ndarray, u: np.ndarray, v: np.ndarray, halves: np.ndarray, passage: int):
        self.constant, self.listed, self.passage = constant, listed, passage
        self.rows, self.halves = Places(key), Places(halves)
        self.u, self.v = np.append(u, np.float32(0)), np.append(v, np.float32(0))
        self.forget()

    def forget(self) -> None:
        self.number = Numbers(self.listed)
        self.code = self.key = np.zeros(0, np.uint64)
        self.place, self.asked = np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self) -> None:
        """What is to be known of the words that have a number, once for each."""
        new = np.array(self.number.codes[len(self.code) :], np.uint64)
        key = mixed(new, np.zeros_like(new))
        place = self.rows.find(key)
        self.code, self.key, self.place = (np.concatenate(x) for x in ((self.code, new), (self.key, key), (self.place, place)))
        self.asked = np.concatenate((self.asked, self.beyond(key, place)))

    def beyond(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether keys that are not in the broadcast rows may be in the others."""
        out = np.zeros(len(key), bool)
        if len(self.halves.key):
            out[left] = self.halves.find((key[left := np.flatnonzero(place < 0)] >> np.uint64(32)).astype(np.uint32)) >= 0
        return out

    def read(self, texts: list[bytes]) -> None:
        """ends of the texts in words; of each word its number, that of the word before it, the key and the place of the two, and d,
        the difference of its log-likelihoods as far as the broadcast rows go."""
        if len(self.number) > KNOWN:
            self.forget()
        words, ends = array("i"), [0]
        for text in texts:
            words.extend(map(self.number.__getitem__, words_of(text)))
            ends.append(len(words))
        self.learn()
        self.ends, self.words = np.array(ends), np.array(words, np.int32)
        self.n = np.diff(self.ends)
        self.some = np.flatnonzero(self.n)
        self.starts = self.ends[:-1][self.some]
        self.first = np.concatenate((np.zeros(1, np.int32), self.words[:-1]))[: len(self.words)]
        self.first[self.starts] = 0
        self.pair_key = mixed(self.code[self.first], self.code[self.words])
        self.pair = self.rows.find(self.pair_key)
        self.d = self.constant + self.u[self.place[self.words]].astype(float) + self.u[self.pair] + self.v[self.place[self.first]]

    def totals(self) -> np.ndarray:
        out = np.zeros(len(self.n))
        if len(self.some):
            out[self.some] = np.add.reduceat(self.d, self.starts)
        return out

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """At each word the sum over the passage that begins there, and whether one does; a text that is shorter is one passage."""
        n, width = len(self.words), self.passage
        sums, begins = self.d.copy(), np.ones(n, bool)
        for i in range(1, width):
            sums[: n - i] += self.d[i:]
            begins[self.ends[1:][self.n >= i] - i] = False
        short = self.some[self.n[self.some] < width]
        sums[self.ends[short]], begins[self.ends[short]] = self.totals()[short], True
        return sums, begins

    def most(self, sums: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The largest sum of a passage in each text, -inf without any."""
        out = np.full(len(self.n), -np.inf)
        if len(self.some):
            out[self.some] = np.maximum.reduceat(np.where(begins, sums, -np.inf), self.starts)
        return out

    def questions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that are to be asked of the other rows: those that stand for themselves, those that stand for the pair they end, and words changed by the answers."""
        words, pairs = self.asked[self.words], self.beyond(self.pair_key, self.pair)
        return words, pairs, words | pairs | self.asked[self.first]


def differences(rows: DataFrame, evidence: Evidence, passage: int) -> DataFrame:
    """key, whole, passage of every row (key, text): the mean difference a word of the whole text, and of its most toxic passage.

    Every text is read once. What evidence beyond the broadcast rows can change in a text are the words that it asks for; these are
    kept with the words around them and the rest is summed, so texts do not move.
    """
    held = rows.sparkSession.sparkContext.broadcast((evidence.constant, evidence.listed, evidence.key, evidence.u, evidence.v, evidence.halves))
    out = StructType([rows.schema["key"], StructField("whole", DoubleType()), StructField("passage", DoubleType())])

    def judge():
        reader = Reader(*held.value, passage)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            reader.read(byte_texts(batch.column("text")))
            most = np.where(reader.n, reader.most(*reader.passages()), 0.0)
            n = np.maximum(reader.n, 1)
            return batch_of(("key", batch.column("key")), ("whole", reader.totals() / n), ("passage", most / np.minimum(n, passage)))

        return step

    if evidence.rest is None:
        return per_slice(rows.select("key", "text"), judge, out, size=READ_BYTES)

    def ask():
        from pyspark import TaskContext

        reader, row = Reader(*held.value, passage), TaskContext.get().partitionId() << 40

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row
            reader.read(byte_texts(batch.column("text")))
            sums, begins = reader.passages()
            words, pairs, changed = reader.questions()
            # Passages that may change, and the words in them.
            n, width = reader.n, len(reader.words)
            open_, short = changed.copy(), reader.some[n[reader.some] < passage]
            for i in range(1, passage):
                open_[: width - i] |= changed[i:]
            if len(short):
                open_[reader.ends[short]] = np.maximum.reduceat(changed, reader.starts)[n[reader.some] < passage]
            open_ &= begins
            near = open_.copy()
            for i in range(1, passage):
                near[i:] |= open_[: width - i]
            near &= np.repeat(n >= passage, n)
            near |= np.repeat(np.isin(np.arange(len(n)), short[open_[reader.ends[short]]]), n)
            start = reader.starts if reader.asked[0] else reader.starts[:0]
            # Odd places are pairs; the start is a word before the first.
            words, pairs = np.flatnonzero(words), np.flatnonzero(pairs)
            text = np.concatenate([np.searchsorted(reader.ends, x, "right") - 1 for x in (start, words, pairs)])
            first = reader.ends[text]
            at = np.concatenate((2 * start - 2, 2 * words, 2 * pairs + 1)) - 2 * first
            k = np.concatenate((np.full(len(start), reader.key[0]), reader.key[reader.words[words]], reader.pair_key[pairs])).view(np.int64)
            order = np.argsort(text, kind="stable")
            asks = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(n)))))
            near = np.flatnonzero(near)
            of_near = np.searchsorted(reader.ends, near, "right") - 1
            nears = np.concatenate(([0], np.cumsum(np.bincount(of_near, minlength=len(n)))))
            lists = [(asks, at[order]), (asks, k[order]), (nears, near - reader.ends[of_near]), (nears, reader.d[near])]
            at, k, near, d = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for ends, x in lists)
            uid = row + np.arange(len(n))
            row += len(n)
            return batch_of(("uid", uid), ("key", batch.column("key")), ("n", n), ("total", reader.totals()), ("most", reader.most(sums, begins & ~open_)), ("at", at), ("k", k), ("near", near), ("d", d))

        return step

    longs, doubles = ArrayType(LongType()), ArrayType(DoubleType())
    kinds = {"n": LongType(), "total": DoubleType(), "most": DoubleType(), "at": longs, "k": longs, "near": longs, "d": doubles}
    schema = StructType([StructField("uid", LongType()), rows.schema["key"], *(StructField(n, t) for n, t in kinds.items())])
    read = settle(per_slice(rows.select("key", "text"), ask, schema, size=READ_BYTES), "read")
    asked = read.select("uid", F.explode(F.arrays_zip("at", "k")).alias("q")).select("uid", "q.at", "q.k")
    told = asked.join(evidence.rest, "k").groupBy("uid").agg(F.collect_list(F.struct("at", "u", "v")).alias("told"))
    some = read.where(F.size("at") > 0).drop("at", "k").join(told, "uid", "left")
    none = read.where(F.size("at") == 0).drop("at", "k").withColumn("told", F.lit(None).cast(told.schema["told"].dataType))

    def answered(batches):
        for batch in batches:
            yield _answered(batch, passage)

    return some.unionByName(none).select("key", "n", "total", "most", "near", "d", "told").mapInArrow(answered, out)


def _answered(batch: pa.RecordBatch, passage: int) -> pa.RecordBatch:
    """The whole and the most toxic passage with what the other rows of the evidence told."""

    def rows_of(column: pa.Array) -> np.ndarray:
        return np.repeat(np.arange(batch.num_rows) << 32, pc.fill_null(pc.list_value_length(column), 0).to_numpy())

    n, total, most = (batch.column(c).to_numpy().copy() for c in ("n", "total", "most"))
    place = rows_of(batch.column("near")) + batch.column("near").flatten().to_numpy()
    d = batch.column("d").flatten().to_numpy().copy()
    told, row = batch.column("told").flatten(), rows_of(batch.column("told"))
    at, u, v = (pc.struct_field(told, i).to_numpy(zero_copy_only=False) for i in range(3))
    # In the same order whatever the join's.
    order = np.lexsort((at, row))
    at, u, v, row = at[order], u[order], v[order], row[order]
    own, after = at >= 0, (at % 2 == 0) & (at // 2 + 1 < n[row >> 32])
    for some, shift, x in ((own, 0, u), (after, 1, v)):
        np.add.at(total, row[some] >> 32, x[some])
        np.add.at(d, np.searchsorted(place, row[some] + at[some] // 2 + shift), x[some])
    width = np.minimum(np.maximum(n, 1), passage)
    for w in np.unique(width):
        begins = np.flatnonzero(width[place >> 32] == w)
        begins = begins[begins + w <= len(place)]
        begins = begins[place[begins + w - 1] == place[begins] + w - 1]
        np.maximum.at(most, place[begins] >> 32, sum(d[begins + i] for i in range(w)))
    return batch_of(("key", batch.column("key")), ("whole", total / np.maximum(n, 1)), ("passage", np.where(n, most, 0.0) / width))


def _summary(d: np.ndarray, passage: int) -> tuple[float, float]:
    """The mean difference a word of the whole text, and of its most toxic passage."""
    if not len(d):
        return 0.0, 0.0
    run = np.concatenate(([0.0], np.cumsum(d)))
    width = min(passage, len(d))
    return float(run[-1] / len(d)), float((run[width:] - run[:-width]).max() / width)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's steps with a small penalty: the constant and a coefficient for each column."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-3 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta)), slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta


class Trial:
    """The counts of the fold that counts, of the words and pairs of a bounded sample of texts, on the driver."""

    def __init__(self, models: Models, sample: DataFrame, listed: dict[bytes, int]):
        known = models.pairs.sparkSession.sparkContext.broadcast(listed)

        def coded(batches):
            coder = Coder(known.value)
            for batch in batches:
                yield batch_of(("label", batch.column("label")), ("codes", pa.array([c.view(np.int64) for c in coder.of(batch.column("text"))], pa.list_(pa.int64()))))

        got = sample.select("label", "text").mapInArrow(coded, "label int, codes array<long>").toArrow()
        codes = [np.asarray(c, dtype=np.int64).view(np.uint64) for c in got.column("codes").to_pylist()]
        self.label = got.column("label").to_numpy().astype(float)
        self.ends = np.cumsum([0] + [len(c) for c in codes])
        word = np.concatenate([np.zeros(0, np.uint64), *codes])
        first = np.concatenate([np.zeros(0, np.uint64), *(before(c) for c in codes if len(c))])
        key, at, self.pair = np.unique(mixed(first, word), return_index=True, return_inverse=True)
        names = np.unique(np.concatenate((first, word)))
        self.first, self.word = np.searchsorted(names, first[at]), np.searchsorted(names, word[at])
        held = models.pairs.sparkSession.sparkContext.broadcast((names, key))

        def place(sorted_: np.ndarray, of: np.ndarray) -> np.ndarray:
            if not len(sorted_):
                return np.full(len(of), -1)
            i = np.minimum(np.searchsorted(sorted_, of), len(sorted_) - 1)
            return np.where(sorted_[i] == of, i, -1)

        def of_pairs(batches):
            names, key = held.value
            for batch in batches:
                a, b = (batch.column(n).to_numpy().view(np.uint64) for n in ("before", "word"))
                i = place(names, a)
                some = i >= 0
                yield batch_of(("first", i[some]), ("pair", place(key, mixed(a[some], b[some]))), *((n, batch.column(n).to_numpy()[some]) for n in ("n0", "n1")))

        def of_words(batches):
            names, _ = held.value
            for batch in batches:
                i = place(names, batch.column("word").to_numpy().view(np.uint64))
                some = i >= 0
                yield batch_of(("word", i[some]), *((n, batch.column(n).to_numpy()[some]) for n in ("f0", "f1", "f")))

        pairs = models.pairs.where("n0 + n1 > 0").select("before", "word", "n0", "n1").mapInArrow(of_pairs, "first long, pair long, n0 long, n1 long")
        sums = [F.sum(f"n{c}").cast("double").alias(f"t{c}") for c in (0, 1)]
        sums += [F.sum(_over(F.col(f"n{c}"), d)).alias(f"l{c}_{i}") for i, d in enumerate(PAIR_DISCOUNTS) for c in (0, 1)]
        self.n = self._table(pairs.where("pair >= 0").select("pair", "n0", "n1"), len(key))
        self.before = self._table(pairs.groupBy("first").agg(*sums), len(names))
        self.follows = self._table(models.words.select("word", "f0", "f1", "f").mapInArrow(of_words, "word long, f0 long, f1 long, f long"), len(names))
        self.level = _level(models.words, ("f0", "f1", "f"), WORD_DISCOUNTS)

    @staticmethod
    def _table(df: DataFrame, rows: int) -> np.ndarray:
        got = df.toArrow()
        out = np.zeros((got.num_columns - 1, rows))
        for i in range(1, got.num_columns):
            out[i - 1, got.column(0).to_numpy()] = got.column(i).to_numpy()
        return out

    def ratios(self, i: int, word_discount: float) -> np.ndarray:
        """The difference of the log-likelihoods of each pair, under the pair discount of place i."""
        out = []
        shared = (self.follows[2] + 0.5) / self.level.shared
        for c in (0, 1):
            words = (np.maximum(self.follows[c] - word_discount, 0) + self.level.rest[word_discount][c] * shared) / self.level.follows[c]
            total, kept = self.before[c], self.before[2 + 2 * i + c]
            left = np.where(total > 0, total - kept, 1)
            k = np.maximum(self.n[c] - PAIR_DISCOUNTS[i], 0)
            out.append(np.log((k + left[self.first] * words[self.word]) / np.maximum(total, 1)[self.first]))
        return out[1] - out[0]

    def fit(self, weight: np.ndarray) -> tuple[float, float, int, np.ndarray]:
        """The discounts, the passage and the regression under which the labels are likeliest."""
        fits = []
        for i, pair_discount in enumerate(PAIR_DISCOUNTS):
            for word_discount in WORD_DISCOUNTS:
                d = self.ratios(i, word_discount)[self.pair]
                texts = [d[a:b] for a, b in zip(self.ends, self.ends[1:])]
                for passage in PASSAGES:
                    x = np.array([_summary(t, passage) for t in texts])
                    beta = logistic(x, self.label, weight)
                    line = beta[0] + x @ beta[1:]
                    fits.append(((weight * (np.logaddexp(0, line) - self.label * line)).sum(), pair_discount, word_discount, passage, beta))
        return min(fits, key=lambda f: f[:4])[1:]


def distinct_texts(rows: DataFrame) -> DataFrame:
    """key, label, fold, text: of the rows with equal texts of a class one, with their smallest key and fold. Only texts whose hash is
    met more than once move; whether they are equal is decided after that."""
    rows = rows.withColumn("hash", F.xxhash64("text"))
    several = rows.groupBy("hash", "label").agg(F.count("*").alias("n")).where("n > 1").select("hash", "label")
    several = settle(several, "several")
    few = several.count() <= SENT
    copies = rows.join(F.broadcast(several), ["hash", "label"], "left_semi") if few else rows
    one = copies.groupBy(F.sha2("text", 256).alias("sha"), "label").agg(F.min("key").alias("key"), F.min("fold").alias("fold"), F.first("text").alias("text"))
    one = settle(one.select("key", "label", "fold", "text"), "copies")
    if not few:
        return one
    return rows.join(F.broadcast(several), ["hash", "label"], "left_anti").select("key", "label", "fold", "text").union(one)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, hot: int = HOT) -> tuple[Evidence | None, int, np.ndarray]:
    """The evidence (None without labels of both classes), the passage and the regression. Rows with crc32(key) mod 4
    = 0 or 1 are counted, those with 3 fit the score and are counted after that; of equal texts of a class one."""
    rows = labelled(docs, labels, label, key, text).withColumn("fold", remainder("key", 4)).where("fold <> 2")
    if moves(docs, labels, key):
        rows = settle(rows, "labelled")  # joined by shuffling, once
    texts = distinct_texts(rows).withColumn("fitting", (F.col("fold") == 3).cast("int"))
    marks = settle(texts.where("fitting = 1").select("key", "label"), "marks")
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    nothing = None, 1, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0])
    if len(counts) < 2:
        return nothing
    chosen = F.broadcast(by_class(marks, "label", "key", sample))  # `sample` rows of a class at most
    held = settle(texts.where("fitting = 1").join(chosen, ["key", "label"]).dropDuplicates(["key", "label"]).select("key", "label", "text"), "sample")
    listed = frequent_words(held)
    models = Models.count(texts, listed)
    trial = Trial(models, held, listed)
    if not trial.level.usable():
        return nothing
    y = trial.label
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    pair_discount, word_discount, passage, beta = trial.fit(weight)
    return Evidence(*models.evidence(pair_discount, word_discount), listed, hot), passage, beta


def toxicity(docs: DataFrame, evidence: Evidence | None, passage: int, beta: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, score, predicted, whole, passage of every row."""
    line = F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("whole") + F.lit(float(beta[2])) * F.col("passage")
    rows = pick(docs, key, text)
    out = differences(rows, evidence, passage) if evidence else rows.select("key", F.lit(0.0).alias("whole"), F.lit(0.0).alias("passage"))
    out = out.withColumn("score", 1 / (1 + F.exp(-line)))
    return out.select(F.col("key").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "whole", "passage")
