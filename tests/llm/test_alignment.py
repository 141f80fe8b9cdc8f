"""Alignment of two tokenizers against the libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pulsecheck.llm import alignment
from pulsecheck.llm.alignment import PairHash, Vocabularies, aligned, parts_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "   ", "▁", "a", "the", "The ", "\n", "\n ", " \n", "\t", "é", "é", "中文字", "1", "23", "<s>", "<0x0A>", "<|endoftext|>", "'s", "it's ", ".", ", ", "\x0b", "\x1c ", "᠎ ", "​ ", "\x85", "  ", "\xa0 ", "😀", "\x00", "ing ", "tion", "   x", "�"]


def texts(n, seed, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def plain(rows):
    """The contract, text by text with the whole text in one call."""
    own, library_b = Vocabularies(A, B), sentencepiece.SentencePieceProcessor(model_file=B)
    library_a = Tokenizer.from_file(A)
    library_a.encode_special_tokens = True
    found = []
    for text in rows:
        whole = " " + (text or "")
        a, b = library_a.encode(whole, add_special_tokens=False).ids, library_b.encode(text or "")
        if not text or any(b"".join(held[t] for t in ids) != whole.encode() for held, ids in ((own.a_bytes, a), (own.b_bytes, b))):
            a = b = []
        ends = []
        for held, ids in ((own.a_bytes, a), (own.b_bytes, b)):
            at, own_ends = 0, []
            for t in ids:
                at += len(held[t])
                own_ends.append(at)
            ends.append(own_ends)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, p, q = [], [], 0, 0
        for c in cuts:
            p_to, q_to = ends[0].index(c, p) + 1, ends[1].index(c, q) + 1
            groups.append(",".join(map(str, a[p:p_to])) + "|" + ",".join(map(str, b[q:q_to])))
            links.append((a[p_to - 1], b[q_to - 1]))
            p, q = p_to, q_to
        found.append((len(a), len(b), groups, links))
    counts = Counter(pair for *_, links in found for pair in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups)) for n_a, n_b, groups, links in found]


@pytest.mark.parametrize("kept", [40, 300_000])
def test_alignment_equals_the_whole_texts(spark, monkeypatch, kept):
    monkeypatch.setattr(alignment, "KEPT", kept)
    monkeypatch.setattr(alignment, "SEGMENT", 64)
    monkeypatch.setattr(alignment, "FILL", 1)
    rows = [*texts(1500, 1), *texts(300, 2, [p for p in PARTS if p != "▁"]), None, "", " ", "▁", "word " * 30_000, "y" * 100_000, "\n " * 500, "same text", "same text"]
    docs = spark.createDataFrame([(i // 2 or None, t, 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_a int, pair string").repartition(5)
    got = aligned(docs, A, B).collect()
    want = [(i // 2 or None, *x) for i, x in enumerate(plain(rows))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_faster_encoder_gives_the_library_ids():
    own = Vocabularies(A, B)
    letters = [chr(i) for i in [*range(0x20, 0x7F), *range(0xA1, 0x250)]] + ["\n", "\t", "  ", "the ", "ing", "'s", " 12"]
    for t in texts(4000, 5, letters):
        assert alignment.PLAIN.fullmatch(t) and own.ranked(t) == own.a.encode(t, add_special_tokens=False).ids


def test_empty_table_and_texts_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in aligned(docs, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert aligned(docs.limit(0), A, B).count() == 0


def test_units_join_to_the_text():
    for t in filter(None, texts(2000, 3)):
        assert " ".join(parts_of(t)) == t


def test_hash_is_minimal_and_verifies():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 50_000))
    buckets = PairHash.bucket(keys)
    table = PairHash([(b, *PairHash.build(keys[buckets == b])) for b in range(alignment.BUCKETS)])
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert len(table.bits) < 8 * len(keys)
    with pytest.raises(ValueError):
        table.slots(np.array([2**41 + 7]))
    assert len(PairHash([]).slots(np.zeros(0, dtype=np.int64))) == 0


def test_linked_pairs_are_bounded_by_the_vocabularies():
    assert Vocabularies(A, B).possible_pairs() < 400_000


def test_registered_query_hashes_the_groups(spark, tmp_path):
    from pulsecheck.llm.queries import QUERIES

    spark.createDataFrame([(1, "The train to Rome"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op12_alignment"](spark, str(tmp_path)).collect()}
    assert rows[1]["groups_sha256"] == hashlib.sha256(plain(["The train to Rome"])[0][-1].encode()).hexdigest()
    assert rows[2]["groups_sha256"] == "" and rows[2]["n_a"] == 0
