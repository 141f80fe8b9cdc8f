"""Token counts: batch encoding inside Arrow functions that return lengths only.

A text is cut into units where the vocabulary allows no piece to cross, so the units can be encoded apart and
their counts added. Units that a task has met before are looked up; the others go to the library in batches
balanced by bytes.

Null text counts as empty; an empty text has 0 tokens. Repeated rows give repeated rows. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecheck.llm.common import Known, batch_of, byte_texts, fields, in_worker, per_slice, pick

#: Bytes of units in one call of the library, units kept by a task, and bytes from which a unit is cut further.
CALL_BYTES, KEPT, LONG = 1 << 20, 400_000, 1 << 16

SPACE = "▁"
UNIT = re.compile(rb" *[^ ]+| +")
#: Stands for one space between units that has no character after it; no text holds this byte.
LONE = b"\xff"


class PieceCounter:
    """Counts the pieces of a SentencePiece model whose normalizer leaves texts alone and puts a space in front.

    Two neighbouring characters that stand together in no piece of the vocabulary are a safe boundary: merging
    never joins across it. A character followed by a space is one in every model whose pieces carry the space in
    front; this is checked against the vocabulary, and without it a text is encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n) if not self.library.is_control(i) and not self.library.is_byte(i) and not self.library.is_unknown(i)]
        self.pairs = {a + b for p in pieces for a, b in zip(p, p[1:])}
        probe = self.library.encode(" a  b\n", out_type=str)
        plain = "".join(probe).replace("<0x0A>", "\n") == SPACE * 2 + "a" + SPACE * 2 + "b\n"
        self.cuts = plain and not any(p[0] != SPACE and p[1] == SPACE for p in self.pairs)
        self.cuts_inside = self.cuts and not any("\n" in p for p in self.pairs)
        self.known = Known(KEPT)

    def units(self, text: bytes) -> list[bytes]:
        """Parts whose counts add up; every part but the first has lost the space that encoding puts in front again."""
        text = text.replace(SPACE.encode(), b" ")
        if not self.cuts or not text:
            return [text] if text else []
        if b"  " not in text and text[0] != 32 and text[-1] != 32:
            return text.split(b" ")
        first, *rest = UNIT.findall(text)
        return [first, *(u[1:] or LONE for u in rest)]

    def long_unit(self, text: str) -> int:
        """The count of one very long unit, encoded in parts that end at safe boundaries. A part in the middle is led
        by a line break, which stands in no larger piece, and its two own pieces are taken off again."""
        if not self.cuts_inside:
            return len(self.library.encode(text))
        total, start = 0, 0
        while start < len(text):
            stop = min(len(text), start + LONG)
            while stop < len(text) and (text[stop - 1] + text[stop]).replace(" ", SPACE) in self.pairs:
                stop += 1
            part = text[start:stop]
            total += len(self.library.encode("\n" + part)) - 2 if start else len(self.library.encode(part))
            start = stop
        return total

    def unit_counts(self, units: list[bytes]) -> list[int]:
        """Units of usual size go to the library in calls of about CALL_BYTES."""
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        out = np.zeros(len(units), dtype=np.int64)
        for i in np.flatnonzero(size > LONG):
            out[i] = self.long_unit(units[i].decode())
        usual = np.flatnonzero(size <= LONG)
        if len(usual):
            ends = np.flatnonzero(np.diff(np.cumsum(size[usual]) // CALL_BYTES, append=-1)) + 1
            for start, stop in zip([0, *ends], ends):
                found = self.library.encode([units[i].decode() for i in usual[start:stop]], num_threads=1)
                out[usual[start:stop]] = list(map(len, found))
        return out.tolist()

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [self.units(t) for t in texts]
        seen: set[bytes] = set()
        for units in split:
            seen.update(units)
        seen.discard(LONE)
        known = self.known.learn(seen, self.unit_counts)
        known[LONE] = 1
        return [sum(map(known.__getitem__, units)) for units in split]


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row. Nothing is shuffled."""
    rows = pick(docs, key, text)

    def make():
        counter = in_worker(f"pieces {model_path}", lambda: PieceCounter(model_path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            counts = np.array(counter.counts(byte_texts(batch.column("text"))), dtype=np.int64)
            return batch_of(("key", batch.column("key")), ("n_bytes", size), ("n_tokens", counts))

        return step

    out = per_slice(rows, make, fields(rows, "key", ("n_bytes", "long"), ("n_tokens", "long")))
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
