"""SimHash near-duplicates against all pairs in plain Python."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from pulsecheck.llm.simhash import near_duplicates, near_links, one_of_each, text_fingerprint


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprints_match_the_contract():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["the ", "A", "é ", "\t", "\n", " ", "b\x0bc", "\x1c", " ", "ß "]) for _ in range(rng.randint(0, 60)))
        assert text_fingerprint(text.encode()) == slow_fingerprint(text)


def test_components_match_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([2, 40, 200]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", "  \n", "a b", "a b", "x " * 50_000]
    rows = [(i * 3 + 5, t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(7)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect()}
    rows.sort()
    prints = [slow_fingerprint(t or "") for _, t, _ in rows]
    roots = slow_components(prints)
    assert got == {r[0]: (f"{p:016x}", rows[c][0]) for r, p, c in zip(rows, prints, roots)}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({rows[c][0] for c in roots})


@pytest.mark.parametrize("block", [4, 8192])
def test_dense_groups_lose_no_link(spark, block):
    """Chains of fingerprints within few bits of each other, dealt out by pairs of blocks or not."""
    rng = np.random.default_rng(3)
    prints = {0}
    for _ in range(25):
        now = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                now ^= 1 << int(bit)
            prints.add(now)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in near_links(frame, block).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    place = {p: i for i, p in enumerate(prints)}
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(place[a]), root(place[b])))
        up[y] = x
    assert [root(i) for i in range(len(prints))] == slow_components(prints)


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0
    docs = spark.createDataFrame([(1, "same text here now", 1), (1, "same text here now", 1), (None, "same text here now", 2), (None, "lonely words of a null key", 3), (1, "another text with the same key", 4)], "doc_id long, text string, key int")
    got = sorted(r["component_id"] or -1 for r in near_duplicates(docs).collect())
    assert got == [-1, 1, 1, 1, 1]
    assert sorted((r["doc_id"] or -1, r["key"]) for r in one_of_each(docs).collect()) == [(-1, 3), (1, 1), (1, 4)]
