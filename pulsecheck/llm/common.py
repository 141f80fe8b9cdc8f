"""What the operators share: tables, texts as bytes, Arrow batches in small slices."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Lower-cased words of the contracts: digits, small letters and everything beyond ASCII. Bytes of a
#: character beyond ASCII are all 0x80 or more, so the pattern holds on UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Bytes of text that one step of a task holds as Python objects; one longer text is a step of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, as `key` and `text`: other columns of any name are no concern."""
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


#: What WORD takes, in small letters; a blank for every other byte.
_AS_WORDS = bytes(b if WORD.match(bytes((b,))) else 32 for b in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    """All matches of WORD in the text in small letters."""
    return text.translate(_AS_WORDS).split()


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def per_slice(df: DataFrame, make: Callable[[], Callable], schema: StructType, text: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """`make()` runs once in each task; what it returns turns a slice of a batch into a batch of `schema`."""

    def run(batches):
        step = None
        for batch in batches:
            step = step or make()
            for part in slices(batch, text, size):
                yield step(part)

    return df.mapInArrow(run, schema)


def fields(df: DataFrame, column: str, *more: tuple[str, str]) -> StructType:
    """`column` as it is in `df`, then the columns given by name and type."""
    from pyspark.sql.types import _parse_datatype_string

    out = [StructField(column, df.schema[column].dataType, True)]
    return StructType([*out, *(StructField(n, _parse_datatype_string(t), True) for n, t in more)])


def in_worker(name: str, make: Callable):
    """One object for each name and Python worker, kept from task to task while Spark keeps the worker."""
    import sys
    import types

    holder = sys.modules.setdefault("pulsecheck_llm_kept", types.ModuleType("pulsecheck_llm_kept"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


class Known:
    """What has been worked out for units of text, of which the most recent are kept."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit // 2, {}, {}

    def learn(self, units: set[bytes], work: Callable[[list[bytes]], list]) -> dict:
        """A dict that holds at least `units`; `work` gives the values of those not known."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        new = []
        for unit in units:
            if unit not in self.now:
                if unit in self.before:
                    self.now[unit] = self.before[unit]
                else:
                    new.append(unit)
        if new:
            self.now.update(zip(new, work(new)))
        return self.now


def batch_of(*columns: tuple[str, object]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for _, c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in columns])
