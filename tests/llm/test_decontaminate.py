"""Decontamination against comparing words window by window."""

import hashlib
import random
import re

import pytest

from pulsecheck.llm.decontaminate import clean_documents, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, size=13):
    out = []
    for key, text in docs:
        own = words(text)
        hit, of = set(), set()
        for item, item_text in items:
            w = words(item_text)
            for at in range(len(w) - size + 1) if len(w) >= size else [0] * bool(w):
                window = w[at : at + size]
                for i in range(len(own) - len(window) + 1):
                    if own[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        if item is not None:
                            of.add(str(item))
        sha = hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
        out.append((key, len(own), len(hit), len(of), sha, bool(hit) and 20 * len(hit) >= len(own)))
    return out


def fixture():
    rng = random.Random(4)
    pool = ["a", "B", "é", "42", "Zoo", "über", "x1", "中文"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "!?"), (3, "other words of item three"), (None, "an item without an id"), (5, items[5][1])]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 90)))]
        if rng.random() < 0.6:
            passage = items[rng.randrange(30)][1]
            parts.insert(rng.randint(0, 1), "Ünder -- " + passage.replace(" ", " ,") if rng.random() < 0.5 else passage)
        docs.append((i, "..".join(parts)))
    return docs + [(None, None), (7, ""), (7, ""), (8, "an item without an id " * 4000), (9, "an item WITHOUT an id")], items


@pytest.mark.parametrize("limit", [80_000, 40])
def test_matches_window_by_window(spark, limit):
    docs, items = fixture()
    docs_df = spark.createDataFrame([(*d, 1, "?") for d in docs], "doc_id long, text string, found int, text_ string").repartition(5)
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs_df, items_df, limit=limit)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = slow(docs, items)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, expected))
    clean = clean_documents(docs_df.drop("text_") if limit > 100 else docs_df, items_df, limit=limit)
    bad = [e for e in expected if e[-1]]
    assert clean.count() == len(docs) - len(bad) and clean.columns[:3] == ["doc_id", "text", "found"]


def test_spans_are_places_in_the_original_text(spark):
    docs = spark.createDataFrame([(1, "«É» The Quick, brown-FOX! and the quick fox")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "É»")], "item_id long, text string")
    row = contamination(docs, items).collect()[0]
    text = "«É» The Quick, brown-FOX! and the quick fox"
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["Quick, brown-FOX"]
    assert row["items"] == ["1"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = contamination(docs, none).collect()[0]
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (2, 0, 0, False)
    assert contamination(docs.limit(0), none).count() == 0 and clean_documents(docs, none).count() == 1
