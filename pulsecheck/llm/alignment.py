"""Cross-tokenizer alignment: what tokens of two vocabularies end at the same byte, and how often over the corpus.

First pass: every text is encoded by a byte-level BPE (A) and by a SentencePiece model with byte fallback (B) and cut where
tokens of both end. Each task writes its distinct linked pairs with their counts. A minimal perfect hash gives every
distinct pair its own slot of a dense vector; the vectors of the tasks are summed as a tree, in segments. Second pass: the texts
are aligned again, and each pair is looked up by its hash, where its key is verified.

Two tokens whose byte ranges end together are linked only if the bytes of one are the end of the other's. Two vocabularies
have a bounded number of such pairs (`possible_pairs`; some 324,000 for the two of the registered query), whatever the corpus. So
hash, keys and counts, 17 bytes a pair, can go to every task.

Texts are cut into units before a space that follows no white space: there no token of either kind crosses. Units that a
task has met before are looked up. Null and empty texts, and those whose tokens do not spell the text with a space in front
of it (texts with U+2581, or invalid UTF-8), have no tokens: zeros and an empty `groups`; they add to no count. Repeated rows
give repeated rows, and each counts. An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecheck.llm.common import batch_of, fields, in_worker, pick, slices
from pulsecheck.sources.shared import settle

#: Units that a task keeps, that are worked on at once, and that stand in one text for the libraries.
KEPT, BATCH, CALL = 500_000, 20_000, 2_000
#: Pairs that vocabularies may allow at most; 17 bytes each are sent to every task.
MOST_PAIRS = 8_000_000
#: Parts of the hash that are built on their own; slots of one segment of a vector; bits for each key of a level.
BUCKETS, SEGMENT, ROOM = 64, 1 << 16, 2
#: Rows for each slot that one dense vector takes in, so that vectors are smaller than what they sum.
FILL = 8

# White space in front of a space; also characters that some engines take for white space.
NOT_BEFORE_A_CUT = sorted({chr(i) for i in range(0x3001) if chr(i).isspace()} | {"᠎", "​"})
WHITE, NO_CUTS = frozenset(NOT_BEFORE_A_CUT), [f"{c} " for c in NOT_BEFORE_A_CUT]
CUT = re.compile(f"(?<=[^{''.join(map(re.escape, NOT_BEFORE_A_CUT))}]) ")
SPACE = "▁"
# Fixed value: how byte-level vocabularies cut words, for texts of Latin letters and signs alone.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile(r"[\n\t\x20-\x7e¡-ɏ]*")


def parts_of(text: str) -> list[str]:
    """The units of a text, each without the one space in front of it."""
    if text[0] == " " or any(c in text for c in NO_CUTS):
        return CUT.split(text)
    return text.split(" ")


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both libraries, and the bytes of every token of each."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task on each core already
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        kind = json.loads(self.a.to_str())
        named = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(named.values()))
        for token, i in named.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.ranked = self._ranked(kind, named)
        self.b_bytes = [b""] * self.b.get_piece_size()
        for i in range(len(self.b_bytes)):
            if self.b.is_byte(i):
                self.b_bytes[i] = bytes([int(self.b.id_to_piece(i)[3:5], 16)])
            elif not self.b.is_control(i) and not self.b.is_unknown(i):
                self.b_bytes[i] = self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def _ranked(self, kind: dict, named: dict[str, int]) -> Callable[[str], list[int]] | None:
        """A faster encoder of the same merges, for plain text: where the ids of A are the order of its merges."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in kind["model"].get("merges", [])]
        cutter = kind["pre_tokenizer"] or {}
        plain = kind["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        if not plain or any(named.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)) or len(named) - 256 not in (len(merges), len(merges) + 1):
            return None
        import tiktoken

        ranks = {t: i for i, t in enumerate(self.a_bytes[: 256 + len(merges)])}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def possible_pairs(self) -> int:
        """How many pairs of tokens there are of which one's bytes end the other's."""
        of_a, of_b = ({} for _ in range(2))
        for tokens, held in ((self.a_bytes, of_a), (self.b_bytes, of_b)):
            for t in filter(None, tokens):
                held[t] = held.get(t, 0) + 1
        shorter_b = sum(n * of_b.get(t[i:], 0) for t, n in of_a.items() for i in range(len(t)))
        return shorter_b + sum(n * of_a.get(t[i:], 0) for t, n in of_b.items() for i in range(1, len(t)))


@dataclass
class Aligned:
    """Units as arrays: tokens of each kind and links by unit, the linked ids, and the groups as text."""

    whole: np.ndarray  # whether both kinds of tokens spell the unit
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray  # of all units, in order
    groups: list[str] | None


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.own = Vocabularies(a_path, b_path)
        self.a_size, self.b_size = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.own.a_bytes, self.own.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(x))] for x in (self.a_size, self.b_size))

    def together(self, units: list[str], encode: Callable[[str], list[int]]) -> tuple | None:
        """Ids and tokens by unit of A and B, all units in one text; nothing if the tokens do not spell it."""
        spelled = [f" {u}".encode(errors="replace") for u in units]
        text, ends = b"".join(spelled), np.cumsum(np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled)))
        out = []
        joined = " ".join(units)
        for ids, held, size in ((encode(f" {joined}"), self.own.a_bytes, self.a_size), (self.own.b.encode(joined), self.own.b_bytes, self.b_size)):
            if b"".join(map(held.__getitem__, ids)) != text:
                return None
            ids = np.array(ids, dtype=np.int64)
            out += [ids, np.diff(np.searchsorted(np.cumsum(size[ids]), ends) + 1, prepend=0)]
        return *out, np.ones(len(units), dtype=bool)

    def apart(self, units: list[str]) -> tuple:
        a = [e.ids for e in self.own.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)]
        # The library gives no token for an empty text, where a space in front of nothing is meant.
        b = [x or ([] if u else self.lone()) for x, u in zip(self.own.b.encode(units, num_threads=1), units)]
        whole = np.ones(len(units), dtype=bool)
        for i, (x, y, u) in enumerate(zip(a, b, units)):
            spelled = f" {u}".encode(errors="replace")
            if b"".join([self.own.a_bytes[t] for t in x]) != spelled or b"".join([self.own.b_bytes[t] for t in y]) != spelled:
                whole[i], a[i], b[i] = False, [], []
        out = []
        for ids in (a, b):
            out += [np.fromiter(chain.from_iterable(ids), dtype=np.int64), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))]
        return *out, whole

    def lone(self) -> list[int]:
        return self.own.b.encode("\n ")[-1:]  # a line break stands in no larger piece

    def align(self, units: list[str], texts: bool) -> tuple[list[str], Aligned]:
        """The units in the order of the arrays, and the arrays. Units that a cut may follow are encoded together, CALL at a time."""
        kinds: tuple[list[str], list[str], list[str]] = [], [], []
        for u in units:
            kinds[2 if not u or u[-1] in WHITE else 1 if self.own.ranked is None or not PLAIN.fullmatch(u) else 0].append(u)
        found = []
        for kind, encode in zip(kinds, (self.own.ranked, lambda t: self.own.a.encode_batch_fast([t], add_special_tokens=False)[0].ids, None)):
            for start in range(0, len(kind), CALL):
                some = kind[start : start + CALL]
                found.append((self.together(some, encode) if encode else None) or self.apart(some))
        a_ids, n_a, b_ids, n_b, whole = (np.concatenate(x) for x in zip(*found))
        # Both kinds spell the same bytes, so ends count through all units.
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        at = np.searchsorted(b_end, a_end)
        cut = b_end[at] == a_end if len(a_end) else np.zeros(0, dtype=bool)
        pairs = a_ids[cut] * len(self.own.b_bytes) + b_ids[at[cut]]
        before = np.concatenate([[0], np.cumsum(cut)])
        stops = np.cumsum(n_a)
        n_links = before[stops] - before[stops - n_a]
        groups = self.groups(a_ids, b_ids, np.flatnonzero(cut), at[cut], n_links) if texts else None
        return [u for kind in kinds for u in kind], Aligned(whole, n_a, n_b, n_links, pairs, groups)

    def groups(self, a_ids: np.ndarray, b_ids: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, n_links: np.ndarray) -> list[str]:
        """Of each unit: the ids of its groups as text. Group i ends with the tokens `a_cut[i]` and `b_cut[i]`."""
        a_text, b_text = self.a_text, self.b_text
        of_a, of_b = (np.diff(c, prepend=-1) for c in (a_cut, b_cut))
        found = [f"{x}|{y}" for x, y in zip(a_ids[a_cut].tolist(), b_ids[b_cut].tolist())]
        for i in np.flatnonzero((of_a > 1) | (of_b > 1)).tolist():
            x, y = a_ids[a_cut[i] + 1 - of_a[i] : a_cut[i] + 1].tolist(), b_ids[b_cut[i] + 1 - of_b[i] : b_cut[i] + 1].tolist()
            found[i] = ",".join([a_text[t] for t in x]) + "|" + ",".join([b_text[t] for t in y])
        stops = np.cumsum(n_links)
        return [";".join(found[s:e]) if e - s > 1 else found[s] if e > s else "" for s, e in zip((stops - n_links).tolist(), stops.tolist())]


class PairHash:
    """A minimal perfect hash of the distinct pairs: numbers 0 to n - 1, and the keys in that order to verify them.

    Each bucket holds levels of bits. A key that meets no other key of its level at its bit is settled there, the others
    go to the next level; a key's number is the number of settled keys before its bit.
    """

    def __init__(self, built: list[tuple[int, list[int], bytes, bytes]]):
        depth = max((len(sizes) for _, sizes, _, _ in built), default=0)
        self.sizes, self.starts = np.zeros((depth, BUCKETS), dtype=np.int64), np.zeros((depth, BUCKETS), dtype=np.int64)
        bits, keys, at = [], [], 0
        for bucket, sizes, settled, own in sorted(built):
            for level, size in enumerate(sizes):
                self.sizes[level, bucket], self.starts[level, bucket] = size, at
                at += size
            bits.append(np.unpackbits(np.frombuffer(settled, dtype=np.uint8), count=sum(sizes)))
            keys.append(np.frombuffer(own, dtype=np.int64))
        self.bits = np.concatenate(bits).astype(bool) if bits else np.zeros(0, dtype=bool)
        self.before = (np.cumsum(self.bits) - self.bits).astype(np.int32)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)

    @staticmethod
    def mix(keys: np.ndarray, level: int) -> np.ndarray:
        """63 bits of each key, others on each level."""
        x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)

    @staticmethod
    def bucket(keys: np.ndarray) -> np.ndarray:
        return PairHash.mix(keys, -1) % BUCKETS

    @staticmethod
    def build(keys: np.ndarray) -> tuple[list[int], bytes, bytes]:
        """Of one bucket: the size of each level, the bits, and the keys in the order of their numbers."""
        sizes, bits, order = [], [], []
        while len(keys):
            size = ROOM * len(keys) + 1
            spot = PairHash.mix(keys, len(sizes)) % size
            alone = np.bincount(spot, minlength=size) == 1
            settled = alone[spot]
            order.append(keys[settled][np.argsort(spot[settled])])
            sizes.append(size)
            bits.append(alone)
            keys = keys[~settled]
        return sizes, np.packbits(np.concatenate(bits)).tobytes(), np.concatenate(order).astype(np.int64).tobytes()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; a key that was not among those hashed is an error."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, bucket = np.arange(len(keys)), self.bucket(keys)
        for level in range(len(self.sizes)):
            size = self.sizes[level, bucket[left]]
            left, size = left[size > 0], size[size > 0]
            bit = self.starts[level, bucket[left]] + self.mix(keys[left], level) % size
            here = self.bits[bit]
            out[left[here]] = self.before[bit[here]]
            left = left[~here]
        if len(left) or not np.array_equal(self.keys[out], keys):
            raise ValueError("a pair was met that the first pass has not seen")
        return out


def _counted(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """First pass: bucket, pair, n of each task's distinct linked pairs."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        units = _Units(in_worker(f"aligner {a_path} {b_path}", lambda: Aligner(a_path, b_path)), None)
        for batch in batches:
            for part in slices(batch):
                ids, _, ok, sizes = units.of(part.column("text"))
                units.times += np.bincount(ids[np.repeat(ok, sizes)], minlength=len(units.times))
                if len(units.index) > KEPT:
                    yield units.pair_counts()
        yield units.pair_counts()

    return docs.mapInArrow(count, "bucket int, pair long, n long")


class _Units:
    """The units that a task has met: their figures, by number."""

    def __init__(self, aligner: Aligner, looked_up):
        self.aligner, self.looked_up = aligner, looked_up
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.whole = np.zeros(0, dtype=bool)
        self.figures = np.zeros((5, 0), dtype=np.int64)  # tokens of A and B, links, best links, sum of counts
        self.times = np.zeros(0, dtype=np.int64)
        self.pairs: list[np.ndarray] = []
        self.per_unit: list[np.ndarray] = []

    def learn(self, new: list[str]) -> None:
        for start in range(0, len(new), BATCH):
            units, found = self.aligner.align(new[start : start + BATCH], self.looked_up is not None)
            self.index.update(zip(units, range(len(self.index), len(self.index) + len(units))))
            best, total = np.zeros((2, len(units)), dtype=np.int64)
            if self.looked_up is None:
                self.pairs.append(found.pairs)
                self.per_unit.append(found.n_links)
            else:
                counts, is_best = self.looked_up(found.pairs)
                ends = np.cumsum(found.n_links)
                for out, of in ((best, is_best), (total, counts)):
                    sums = np.concatenate([[0], np.cumsum(of)])
                    out[:] = sums[ends] - sums[ends - found.n_links]
                self.texts += found.groups
            self.whole = np.concatenate([self.whole, found.whole])
            self.figures = np.concatenate([self.figures, [found.n_a, found.n_b, found.n_links, best, total]], axis=1)
            self.times = np.concatenate([self.times, np.zeros(len(units), dtype=np.int64)])

    def of(self, column: pa.Array) -> tuple[np.ndarray, list[list[str]], np.ndarray, np.ndarray]:
        """The units of all texts by number and as text, whether a text's tokens spell it, and units by text."""
        if len(self.index) > KEPT:
            self.clear()
        texts = [b.decode(errors="replace") if b else "" for b in column.cast(pa.large_binary()).to_pylist()]
        split = [parts_of(t) if t else [] for t in texts]
        new = set()
        for parts in split:
            new.update(parts)
        new = [u for u in new if u not in self.index]
        self.learn(new)
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        ids = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sizes.sum())
        bad = np.concatenate([[0], np.cumsum(~self.whole[ids])])
        stops = np.cumsum(sizes)
        # A replaced byte is not in the text, though its replacement may be spelled.
        valid = np.array(["�" not in t or t.encode() == b for t, b in zip(texts, column.cast(pa.large_binary()).to_pylist())], dtype=bool)
        return ids, split, (bad[stops] == bad[stops - sizes]) & (sizes > 0) & valid, sizes

    def pair_counts(self) -> pa.RecordBatch:
        """The distinct pairs of the units met so far, and how often; counting starts anew."""
        pairs = np.concatenate([*self.pairs, np.zeros(0, dtype=np.int64)])
        weights = np.repeat(self.times, np.concatenate([*self.per_unit, np.zeros(0, dtype=np.int64)]))
        keys, place = np.unique(pairs[weights > 0], return_inverse=True)
        n = np.zeros(len(keys), dtype=np.int64)
        np.add.at(n, place, weights[weights > 0])
        self.times = np.zeros_like(self.times)
        return batch_of(("bucket", PairHash.bucket(keys).astype(np.int32)), ("pair", keys), ("n", n))


def _hashed(counted: DataFrame) -> PairHash:
    """Every bucket of the distinct pairs is hashed on its own."""

    def build(group: pa.Table) -> pa.Table:
        sizes, bits, keys = PairHash.build(group.column("pair").to_numpy())
        return pa.table({"bucket": group.column("bucket")[:1], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [bits], "keys": [keys]})

    built = counted.select("bucket", "pair").distinct().groupBy("bucket").applyInArrow(build, "bucket int, sizes array<long>, bits binary, keys binary")
    return PairHash([(r["bucket"], r["sizes"], bytes(r["bits"]), bytes(r["keys"])) for r in built.collect()])


def _summed(counted: DataFrame, held, n: int) -> np.ndarray:
    """Counts by slot: a dense vector for each of a number of tasks, then sums of vectors, first in branches."""
    rows = counted.count()
    tasks = max(1, -(-rows // (FILL * n)))
    branches = max(1, round(tasks**0.5))

    def dense(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vector = np.zeros(n, dtype=np.int64)
        for batch in batches:
            np.add.at(vector, held.value.slots(batch.column("pair").to_numpy()), batch.column("n").to_numpy())
        starts = np.arange(0, n, SEGMENT)
        branch = np.full(len(starts), TaskContext.get().partitionId() % branches, dtype=np.int32)
        yield batch_of(("segment", starts // SEGMENT), ("branch", branch), ("counts", [vector[s : s + SEGMENT].tobytes() for s in starts.tolist()]))

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(len(group.column("counts")[0].as_py()) // 8, dtype=np.int64)
        for counts in group.column("counts"):
            total += np.frombuffer(counts.as_py(), dtype=np.int64)
        return pa.table({"segment": group.column("segment")[:1], "branch": group.column("branch")[:1], "counts": [total.tobytes()]})

    kind = "segment long, branch int, counts binary"
    vectors = counted.coalesce(tasks).mapInArrow(dense, kind)
    summed = vectors.groupBy("segment", "branch").applyInArrow(add, kind).groupBy("segment").applyInArrow(add, kind)
    found = {r["segment"]: np.frombuffer(bytes(r["counts"]), dtype=np.int64) for r in summed.collect()}
    return np.concatenate([found[s] for s in sorted(found)])


class PairCounts:
    """Counts of all linked pairs of a corpus, by their hash."""

    def __init__(self, hash_: PairHash, counts: np.ndarray, n_b: int):
        self.hash, self.counts = hash_, counts
        highest = np.zeros(n_b, dtype=np.int64)
        np.maximum.at(highest, hash_.keys % n_b, counts)
        self.best = counts == highest[hash_.keys % n_b]

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = self.hash.slots(pairs)
        return self.counts[slots], self.best[slots]


def count_pairs(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> PairCounts:
    """The first pass over `docs`, its hash and its summed vectors."""
    own = Vocabularies(a_path, b_path)
    if own.possible_pairs() > MOST_PAIRS:
        raise ValueError(f"the vocabularies allow more than {MOST_PAIRS} pairs")
    counted = settle(_counted(pick(docs, key, text), a_path, b_path), "pairs")
    hash_ = _hashed(counted)
    counts = _summed(counted, docs.sparkSession.sparkContext.broadcast(hash_), len(hash_.keys)) if len(hash_.keys) else np.zeros(0, dtype=np.int64)
    return PairCounts(hash_, counts, len(own.b_bytes))


def align_documents(docs: DataFrame, pairs: PairCounts, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Second pass: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;a3|b2,b3`) of every row."""
    rows = pick(docs, key, text)
    held = docs.sparkSession.sparkContext.broadcast(pairs)
    names = ("n_a", "n_b", "n_links", "n_best", "count_sum")

    def run(batches) -> Iterator[pa.RecordBatch]:
        units = _Units(in_worker(f"aligner {a_path} {b_path}", lambda: Aligner(a_path, b_path)), held.value)
        for batch in batches:
            for part in slices(batch):
                ids, split, ok, sizes = units.of(part.column("text"))
                stops = np.cumsum(sizes)
                out = [("key", part.column("key"))]
                for name, figure in zip(names, units.figures):
                    sums = np.concatenate([[0], np.cumsum(figure[ids])])
                    out.append((name, np.where(ok, sums[stops] - sums[stops - sizes], 0)))
                texts = units.texts
                groups = [";".join([texts[i] for i in ids[stop - n : stop].tolist()]) if good else "" for stop, n, good in zip(stops.tolist(), sizes.tolist(), ok.tolist())]
                yield batch_of(*out, ("groups", pa.array(groups, pa.string())))

    schema = fields(rows, "key", *((n, "long") for n in names), ("groups", "string"))
    found = rows.mapInArrow(run, schema)
    # Every cut ends one group and links the two tokens that end there.
    return found.select(F.col("key").alias(key), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups")


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Both passes."""
    return align_documents(docs, count_pairs(docs, a_path, b_path, key, text), a_path, b_path, key, text)
