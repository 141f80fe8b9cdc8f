"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Items are normalised to words; a window is `size` consecutive words of an item, or the whole of a shorter one. Every
word of the benchmark gets a character of its own, a window is a string of them, and a document - each word its
character, unknown words a blank - runs through the automaton once. Places found are places of words, mapped back
to offsets in the original text.

The automaton's size is bounded: distinct windows are dealt into as many blocks as it takes to keep each below
WINDOWS, each block is an automaton that scans all documents once, and what the blocks found is united for each
document. A benchmark of up to WINDOWS windows is one block and one scan without a shuffle.

Null text counts as empty, in documents and in items; items without words have no windows. Rows of the benchmark
with one item id are one item; a null item id has windows but is no item in `items`. Repeated documents are judged
each. Empty tables work: without windows nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pulsecheck.llm.common import WORD, batch_of, byte_texts, fields, per_slice, pick, words_of
from pulsecheck.sources.shared import settle

SIZE = 13
#: Windows in one automaton: every word of so many can have a character of its own.
WINDOWS = 80_000

FOUND = "struct<n_words:bigint,hits:array<struct<first:int,after:int>>,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"


def item_windows(items: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """window (its words, joined by blanks) and items, the sorted ids as strings."""
    rows = pick(items, key, text).select(F.col("key").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([StructField("key", StringType()), StructField("window", StringType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, windows = [], []
            for i, t in enumerate(byte_texts(batch.column("text"))):
                words = words_of(t)
                new = {b" ".join(words[at : at + size]).decode() for at in range(max(1, len(words) - size + 1))} if words else ()
                row += [i] * len(new)
                windows += new
            return batch_of(("key", batch.column("key").take(pa.array(row, pa.int64()))), ("window", pa.array(windows, pa.string())))

        return step

    return per_slice(rows, make, schema).groupBy("window").agg(F.sort_array(F.collect_set("key")).alias("items"))


class Windows:
    """The automaton of one block of windows."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        from ahocorasick import Automaton

        # A word's character: from U+0100 on, without the surrogates.
        words = sorted({w for window, _ in windows for w in window.split(" ")})
        self.letter = {w.encode(): chr(0x100 + i + (0x800 if 0x100 + i >= 0xD800 else 0)) for i, w in enumerate(words)}
        self.automaton = Automaton()
        for window, items in windows:
            key = "".join(self.letter[w.encode()] for w in window.split(" "))
            self.automaton.add_word(key, (len(key), items))
        if windows:
            self.automaton.make_automaton()
        self.some = bool(windows)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Runs of hit words (first, after) and the sorted items, of a document's words."""
        line = "".join([self.letter.get(w, " ") for w in words]) if self.some else ""
        runs: list[list[int]] = []
        items: set[str] = set()
        known: set[int] = set()
        for end, (length, of) in self.automaton.iter(line) if line.strip(" ") else ():
            first = end - length + 1
            while runs and first <= runs[-1][1]:
                first = min(first, runs.pop()[0])
            runs.append([first, end + 1])
            if id(of) not in known:
                known.add(id(of))
                items.update(of)
        return [(a, b) for a, b in runs], sorted(items)


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as (start, end) in characters of the text."""
    place = [m.span() for m in WORD.finditer(text.lower())]
    out, at, chars = [], 0, 0
    for first, after in runs:
        start, end = place[first][0], place[after - 1][1]
        chars += len(text[at:start].decode())
        length = len(text[start:end].decode())
        out.append((chars, chars + length))
        at, chars = end, chars + length
    return out


def _scan(docs: DataFrame, windows: list[tuple[str, list[str]]], columns: list[str]) -> DataFrame:
    """`docs` (any columns, and `text_`) with a column `found`."""
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(windows)
    schema = StructType([*(docs.schema[c] for c in columns), StructField("found", _parse_datatype_string(FOUND))])
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        block = Windows(held.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, hits, items, spans = [], [], [], []
            for t in byte_texts(batch.column("text_")):
                words = words_of(t)
                runs, of = block.scan(words)
                n.append(len(words))
                hits.append([{"first": a, "after": b} for a, b in runs])
                items.append(of)
                spans.append([{"start": a, "end": b} for a, b in original_spans(t, runs)] if runs else [])
            found = pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(hits, run_type), pa.array(items, pa.list_(pa.string())), pa.array(spans, span_type)], names=["n_words", "hits", "items", "spans"]
            )
            return batch_of(*((c, batch.column(c)) for c in columns), ("found", found))

        return step

    return per_slice(docs, make, schema, "text_")


class _Blocks:
    """The windows of all items, to be had block by block; a block has `limit` windows at most."""

    def __init__(self, items: DataFrame, size: int, key: str, text: str, limit: int):
        self.windows = settle(item_windows(items, size, key, text), "windows")
        n = self.windows.count()
        self.number = 1 if n <= limit else -(-2 * n // limit)  # on average half full, as they are dealt by hash

    def __getitem__(self, b: int) -> list[tuple[str, list[str]]]:
        return [(r["window"], r["items"]) for r in self.windows.where(F.expr(f"pmod(xxhash64(window), {self.number}) = {b}")).collect()]


def _judged(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(hits, 0L, (n, r) -> n + r.after - r.first)")
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


#: Overlapping and touching runs of several blocks as one sorted list; for runs of words and spans of characters.
UNITED = """aggregate(array_sort(flatten(collect_list({0}))), CAST(array() AS {1}),
  (done, r) -> IF(size(done) > 0 AND r.{2} <= element_at(done, -1).{3},
    concat(slice(done, 1, size(done) - 1), array(named_struct('{2}', element_at(done, -1).{2}, '{3}', greatest(element_at(done, -1).{3}, r.{3})))),
    concat(done, array(r))))"""


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", limit: int = WINDOWS) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, items, spans of every row of `docs`.

    items: the sorted ids (as strings) with a window in the document; spans: the hit passages in characters of the
    original text, end exclusive.
    """
    rows = pick(docs, key, text).withColumnRenamed("text", "text_")
    blocks = _Blocks(items, size, item_key, item_text, limit)
    if blocks.number == 1:
        flat = _scan(rows, blocks[0], ["key"]).select("key", "found.*")
    else:
        # Rows need a name of their own to be united again, as keys may repeat.
        rows = settle(rows.withColumn("row", F.expr("uuid()")), "rows")
        found = [_scan(rows, blocks[b], ["row", "key"]).select("row", "key", "found.*") for b in range(blocks.number)]
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        flat = every.groupBy("row").agg(
            F.first("key").alias("key"),
            F.max("n_words").alias("n_words"),
            F.expr(UNITED.format("hits", "array<struct<first:int,after:int>>", "first", "after")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.expr(UNITED.format("spans", "array<struct<start:bigint,end:bigint>>", "start", "end")).alias("spans"),
        )
    return _judged(flat).select(F.col("key").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text", item_key: str = "item_id", item_text: str = "text", limit: int = WINDOWS) -> DataFrame:
    """The rows of `docs` that are not contaminated, all columns as they were."""
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    rows = rows.withColumn("text_", F.col("row").getField(text).cast("string"))
    blocks = _Blocks(items, size, item_key, item_text, limit)
    if blocks.number == 1:
        kept = _judged(_scan(rows, blocks[0], ["row"]).select("row", "found.*")).where("NOT contaminated")
    else:
        rows = settle(rows.withColumn("name", F.expr("uuid()")), "rows")
        named = rows.select("name", "text_")
        judged = contamination(named, items, size, "name", "text_", item_key, item_text, limit)
        kept = rows.join(judged.where("NOT contaminated").select("name"), "name")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in columns))
