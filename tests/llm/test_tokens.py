"""Token counts and packing against the libraries on whole texts, and an exact round trip."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pulsecheck.llm import tokens
from pulsecheck.llm.packing import _Sequences, pack, plan_sequences
from pulsecheck.llm.tokens import PieceCounter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "   ", "▁", "a", "the", "\n", "\t", "Ab", "é", "é", "̀", "中文", "1", "23", "<s>", "</s>", "<|endoftext|>", "'s", "it's", ".", ",", "- ", "x ", "\x0b", "\x1c", " ", "\xa0", "😀", "Σ", "İ", "\x00", "ing", "tion", "»", "≮", "    "]


def made(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("long", [5, 1 << 16])
def test_units_give_the_library_counts(monkeypatch, long):
    monkeypatch.setattr(tokens, "LONG", long)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = made(4000, 1)
    assert PieceCounter(MODEL).counts([t.encode() for t in texts]) == [len(x) for x in library.encode(texts)]


def test_token_counts(spark):
    texts = [*made(200, 2), None, "", "", "word " * 100_000, "y" * 300_000]
    docs = spark.createDataFrame([(i // 3 or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(4)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = [(i // 3 or None, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in enumerate(texts)]
    assert sorted(map(repr, map(tuple, token_counts(docs, MODEL).collect()))) == sorted(map(repr, expected))
    assert token_counts(docs.limit(0), MODEL).count() == 0


def test_packing_round_trip(spark):
    texts = [*made(300, 3), None, "", "", "several words " * 3000, "lorem ipsum " * 1023 + "x"]
    docs = spark.createDataFrame([(i // 2 or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(4)
    library = Tokenizer.from_file(WORDS)
    expected = Counter()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            expected[(i // 2 or None, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = pack(docs, WORDS).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.01 * -(-sum(r["length"] for r in rows) // 2048) + 1
    assert pack(docs.limit(0), WORDS).count() == 0


def sequences(histogram, plan, capacity):
    used, by = Counter(), {}
    for n, first, last, sequence, copies, offset in plan.tolist():
        used[n] += last - first
        for k in range(-(-(last - first) // copies)):
            by.setdefault(sequence + k, []).append((offset, n * min(copies, last - first - k * copies)))
    assert used == Counter({n: c for n, c in histogram.items() if c})
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plans_place_everything_about_as_well_as_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(25):
        capacity = rng.choice([8, 20, 100, 2048])
        histogram = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 5, 50, 2000])))
        if rng.random() < 0.3:
            histogram = Counter({rng.randint(1, capacity): rng.randint(1, 10**4) for _ in range(3)})
        plain = _Sequences(capacity)
        for n in sorted(histogram, reverse=True):
            plain.best_fit(n, histogram[n])
        assert sequences(histogram, plan_sequences(dict(histogram), capacity), capacity) <= 1.01 * sum(t for t, _ in plain.kinds()) + 1
    assert len(plan_sequences({}, 2048)) == 0
