"""Best-fit packing of documents into sequences by linear grouping.

1. Token ids of every whole document, an end id after them; longer documents are cut into full sequences.
2. The histogram of piece lengths: at most `capacity` numbers at any input size. Only this reaches the driver.
3. Large lengths, in descending order, form groups of equal cardinality, rounded up to the group's largest length.
   Sequences of these few sizes are configurations; a linear programme over them (columns found by a knapsack)
   says how often to use each, rounded down.
4. Actual lengths take the slots of their group, so what rounding had added is free again.
5. The rest - small lengths and what rounding down left over - goes, largest first, where it fits best.
6. Every piece gets a rank among the pieces of its length and finds its sequence by that rank.

Steps 3 to 5 work on runs of equal sequences, never on single documents. The plan has at most a few thousand kinds
of sequences with at most `capacity` entries each, whatever the input.

Null text counts as empty: its one piece is the end id. Repeated rows are packed each. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsecheck.llm.common import Known, batch_of, byte_texts, fields, in_worker, per_slice, pick
from pulsecheck.sources.shared import settle

#: Groups of large lengths; shares of the capacity from which a length is large, of which the one that needs the
#: fewest sequences is kept; rows ranked together.
GROUPS, LARGE, RANKED = 48, (0.2, 0.34, 0.5), 50_000
#: Words kept by a worker, and words in one call of the library.
KEPT, CALL = 600_000, 500


class WordIds:
    """Ids of texts from a tokenizer that drops white space and marks the last id of each of its own pieces.

    Words between white space can be encoded apart. In texts of ASCII and Latin letters without apostrophes or
    special tokens, runs of letters, single digits and runs of punctuation are exactly the pieces that the
    tokenizer splits text into; many of them go to the library as one string and come apart at the marked ids.
    """

    ODD = re.compile(rb"[\xc2\xc6-\xff]|\xc3[\x97\xb7]|\xc4\xb0")
    PART = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff\s]+")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task on each core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.last = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.last[[i for piece, i in self.library.get_vocab().items() if piece.endswith("</w>")]] = True
        self.words, self.parts = Known(KEPT // 4), Known(KEPT)

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        out = []
        for i in range(0, len(words), CALL):
            found = self.library.encode_batch_fast([w.decode() for w in words[i : i + CALL]], add_special_tokens=False)
            out += [np.array(x.ids, dtype="<u4").tobytes() for x in found]
        return out

    def part_ids(self, parts: list[bytes]) -> list[bytes]:
        out = []
        for i in range(0, len(parts), CALL):
            call = parts[i : i + CALL]
            ids = np.array(self.library.encode_batch_fast([b" ".join(call).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(call):
                out += self.word_ids(call)
                continue
            packed = ids.tobytes()
            out += [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        usual = [b"'" not in t and b"<|" not in t and (t.isascii() or not self.ODD.search(t)) for t in texts]
        split = [self.PART.findall(t.lower()) if u else t.split() for t, u in zip(texts, usual)]
        parts: set[bytes] = set()
        words: set[bytes] = set()
        for units, u in zip(split, usual):
            (parts if u else words).update(units)
        of_part = self.parts.learn(parts, self.part_ids).__getitem__
        of_word = self.words.learn(words, self.word_ids).__getitem__
        return [b"".join(map(of_part if u else of_word, units)) for units, u in zip(split, usual)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, key: str, text: str, end_id: int = 0) -> DataFrame:
    """key, piece, start, length, ids_crc32: the pieces of every document."""
    rows = pick(docs, key, text)

    def make():
        words = in_worker(f"ids {tokenizer_path}", lambda: WordIds(tokenizer_path))
        end = np.array([end_id], dtype="<u4").tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(words.ids(byte_texts(batch.column("text")))):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            return batch_of(
                ("key", batch.column("key").take(pa.array(row, pa.int64()))),
                ("piece", pa.array(piece, pa.int32())),
                *((n, pa.array(v, pa.int64())) for n, v in (("start", start), ("length", length), ("ids_crc32", crc))),
            )

        return step

    return per_slice(rows, make, fields(rows, "key", ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")))


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(copies of each size, times): the linear programme min sum(x), sum(copies * x) >= counts, rounded down."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(counts, dtype=float)
    wide = np.array(sizes)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        prices = inverse.T @ np.ones(k)
        # The most valuable content of one sequence: an unbounded knapsack over the sizes.
        best = np.full(2 * capacity + 1, -np.inf)
        best[capacity] = 0
        last = np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            worth = best[capacity + room - wide] + prices
            g = int(worth.argmax())
            best[capacity + room] = max(worth[g], best[capacity + room - 1])
            if worth[g] > best[capacity + room - 1] + 1e-12:
                last[room] = g
        if best[-1] <= 1 + 1e-6:
            break
        column = np.zeros(k)
        room = capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= sizes[last[room]]
        step, now = inverse @ column, inverse @ need
        ratio = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = column
    times = np.floor(np.linalg.solve(basis, need) + 1e-6).astype(np.int64)
    return [(basis[:, i].round().astype(int), int(times[i])) for i in range(k) if times[i] > 0]


class _Sequences:
    """Runs of equal sequences: (times, content) where content is a list of (length, copies)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[int, tuple]]] = {}
        self.rooms: list[int] = []

    def put(self, times: int, content: tuple, room: int) -> None:
        if times > 0:
            if room not in self.by_room:
                self.by_room[room] = []
                insort(self.rooms, room)
            self.by_room[room].append((times, content))

    def take(self, room: int) -> tuple[int, tuple]:
        found = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.remove(room)
        return found

    def best_fit(self, length: int, count: int) -> None:
        while count > 0:
            at = bisect_left(self.rooms, length)
            room = self.rooms[at] if at < len(self.rooms) else self.capacity
            times, content = self.take(room) if at < len(self.rooms) else (count, ())
            copies = room // length
            full = min(times, count // copies)
            self.put(full, (*content, (length, copies)), room - copies * length)
            count -= full * copies
            if full < times and 0 < count < copies:
                self.put(1, (*content, (length, count)), room - count * length)
                full, count = full + 1, 0
            if content:
                self.put(times - full, content, room)

    def kinds(self) -> Iterable[tuple[int, tuple]]:
        for room in self.rooms:
            yield from self.by_room[room]


def plan_sequences(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, first sequence, copies a sequence, offset), by length and rank."""
    plans = [_grouped(histogram, capacity, groups, share) for share in large]
    rank, sequence, rows = {}, 0, []
    for times, content in min(plans, key=lambda p: sum(times for times, _ in p)):
        offset = 0
        for n, copies in content:
            first = rank.get(n, 0)
            rank[n] = first + times * copies
            rows.append((n, first, rank[n], sequence, copies, offset))
            offset += n * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def _grouped(histogram: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[int, tuple]]:
    """Kinds of sequences: (times, content) with content a list of (length, copies).

    A histogram with few large lengths has few groups; with none, everything is small and goes by best fit.
    """
    left = dict(sorted(histogram.items(), reverse=True))
    out = _Sequences(capacity)
    big = [n for n in left if n >= capacity * large]
    total = sum(left[n] for n in big)
    group_of: list[list[int]] = []
    if total:
        share, filled = max(1, -(-total // groups)), 0
        for n in big:
            # Equal cardinality: a length stands in the group in which its first document falls.
            if not group_of or filled // share >= len(group_of):
                group_of.append([])
            group_of[-1].append(n)
            filled += left[n]
        sizes = [g[0] for g in group_of]
        kinds = [(times, (), tuple(copies)) for copies, times in _configurations(sizes, [sum(left[n] for n in g) for g in group_of], capacity)]
        for g, lengths in enumerate(group_of):
            following = []
            for times, content, copies in kinds:
                need = copies[g]
                while times > 0 and need and lengths:
                    n = lengths[0]
                    same = min(times, left[n] // need)
                    if same:
                        following.append((same, (*content, (n, need)), copies))
                        left[n] -= same * need
                        times -= same
                    elif times:
                        mixed, want = list(content), need
                        while want and lengths:
                            n = lengths[0]
                            got = min(want, left[n])
                            if got:
                                mixed.append((n, got))
                            left[n] -= got
                            want -= got
                            if not left[n]:
                                lengths.pop(0)
                        following.append((1, tuple(mixed), copies))
                        times -= 1
                    while lengths and not left[lengths[0]]:
                        lengths.pop(0)
                if times > 0:
                    following.append((times, content, copies))
            kinds = following
        for times, content, _ in kinds:
            if content:
                out.put(times, content, capacity - sum(n * c for n, c in content))
    for n, count in left.items():
        if count:
            out.best_fit(n, count)
    return list(out.kinds())


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document."""
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, tokenizer_path, capacity, key, text), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_sequences(histogram, capacity)
    salts = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(key, piece, ids_crc32), salts)"))
    within = Window.partitionBy("length", "salt").orderBy("key", "piece", "ids_crc32")
    ranked = salted.withColumn("rank_in", F.row_number().over(within))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("start_rank", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = ranked.join(starts, ["length", "salt"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("start_rank") + F.col("rank_in") - 1).alias("rank"))
    found = numbered.schema
    wide = 1 << 32  # ranks of one length are below it in a table of up to 4 billion equal pieces; see the check

    if max(histogram.values(), default=0) >= wide:
        raise ValueError("more than 4 billion pieces of one length; pack the table in parts")

    def place(batches):
        order = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            _, first, _, sequence, copies, offset = plan[np.searchsorted(order, length * wide + rank, side="right") - 1].T
            yield batch_of(
                *((n, batch.column(n)) for n in ("key", "piece", "start", "length", "ids_crc32")),
                ("sequence_id", sequence + (rank - first) // copies),
                ("offset", offset + (rank - first) % copies * length),
            )

    from pyspark.sql.types import LongType, StructType

    schema = StructType([f for f in found.fields if f.name != "rank"]).add("sequence_id", LongType()).add("offset", LongType())
    return numbered.mapInArrow(place, schema).withColumnRenamed("key", key)
