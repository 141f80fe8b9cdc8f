"""Licence scans against comparing every template at every word."""

import math
import random
import re

from pulsecheck.llm.licenses import BASE, TEMPLATES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs):
    every = [*BASE, *TEMPLATES]
    vocabulary = {w for t in every for w in words(t.text)}
    split = [words(t) for _, t in docs]
    rarity = {w: math.log((len(docs) + 1) / (sum(w in s for s in split) + 1)) + 1 for w in vocabulary}
    for (key, _), own in zip(docs, split):
        base, labels, base_labels, score = [], set(), set(), 0.0
        for t in every:
            w, k = words(t.text), words(t.key)
            first = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            for start in range(-first, len(own)):
                if own[max(0, start + first) : start + first + len(k)] != k:
                    continue
                same = sum(rarity[x] for i, x in enumerate(w) if 0 <= start + i < len(own) and own[start + i] == x)
                share = same / sum(rarity[x] for x in w)
                if share >= t.share * (1 - 1e-9):
                    labels.add(t.label)
                    score = max(score, min(1.0, share))
                    if t in BASE:
                        base.append(start)
                        base_labels.add(t.label)
        yield key, len(own), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(score, 9)


def test_matches_every_template_at_every_word(spark):
    rng = random.Random(5)
    passages = [t.text for t in [*BASE, *TEMPLATES]] + ["MIT", "license", "the", "version 2", "public", "Mit_License", "general PUBLIC", "cc by", "é", "word"]
    docs = [(i, " ".join(rng.choice(passages) if rng.random() < 0.8 else rng.choice(passages).rsplit(" ", 1)[0] for _ in range(rng.randint(0, 6)))) for i in range(150)]
    docs += [(None, None), (3, ""), (3, "MIT license"), (3, "MIT license"), (4, "mit license " * 30_000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, labels string").repartition(6)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    got = [(*(r[n] for n in names), round(r["score"], 9)) for r in license_scan(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, slow(docs)))


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
