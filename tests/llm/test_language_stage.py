"""The pipeline's language stage against a plain rule, whatever the number of languages in the table."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline

WORDS = {
    "en": ["the", "house", "river", "small", "garden", "walks"],
    "fr": ["maison", "rivière", "petite", "jardin", "marche", "été"],
    "de": ["haus", "fluß", "klein", "garten", "geht", "über"],
}


@pytest.mark.parametrize("languages", [[], ["en"], ["en", "fr"], ["en", "fr", "de"]])
def test_texts_with_letters_stay(spark, languages):
    rng = random.Random(8)
    spoken = languages or ["en"]
    rows = [(i, " ".join(rng.choice(WORDS[spoken[i % len(spoken)]]) for _ in range(40)), spoken[i % len(spoken)] if languages else None) for i in range(120)]
    mixed = [(200 + i, " ".join(rng.choice(WORDS[spoken[j % len(spoken)]]) for j in range(40)), None) for i in range(20)]
    junk = [(300, None, None), (301, "", None), (302, "12 34 !?", None)]
    docs = spark.createDataFrame(rows + mixed + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept >= {i for i, *_ in mixed} and not kept & {300, 301, 302}
    assert len(kept & {i for i, *_ in rows}) == 120


def test_bytes_of_no_language_go(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS["en" if i % 2 else "fr"]) for _ in range(60)), "en" if i % 2 else "fr") for i in range(100)]
    noise = "".join(rng.choice("qxzjkvw#%&@^~|<>") for _ in range(2000))
    docs = spark.createDataFrame([*rows, (500, noise, None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert 500 not in kept and len(kept) == 100


def test_another_network_decides_otherwise(spark, monkeypatch):
    from pulsecheck.llm import language

    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(WORDS["en" if i % 2 else "fr"]) for _ in range(60)), "en" if i % 2 else "fr") for i in range(100)]
    junk = [(500 + i, " ".join("".join(rng.choice("qxzjkvw#%&@^~|<>") for _ in range(6)) for _ in range(300)), None) for i in range(5)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == set(range(100))
    monkeypatch.setattr(language, "fit", lambda words, targets, weights: language.Network(targets.shape[1], seed=3))
    untrained = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert untrained & {500 + i for i in range(5)}


def test_noise_is_no_word():
    import numpy as np

    from pulsecheck.llm.language import noise_like

    words = [b"house", b"a", "é".encode(), b"river"]
    found = noise_like(words, np.ones(4))
    assert not set(found) & set(words) and {len(x) for x in found} <= {1, 2, 5}


def test_every_labelled_text_is_learnt_from(spark, monkeypatch):
    """Each of 800 texts a language has a word of its own, repeated keys among them."""
    from pulsecheck.llm import language

    rows = [(i // 2 if i < 100 else i, f"own{i} " + " ".join(WORDS["en" if i % 2 else "fr"]), "en" if i % 2 else "fr") for i in range(1600)]
    docs = spark.createDataFrame([*rows, (5000, "unlabelled", None)], "doc_id long, text string, lang string").repartition(7)
    monkeypatch.setattr(language, "fit", lambda words, targets, weights: (words, targets, weights))
    names, (words, targets, weights) = language.train(docs)
    assert names == ["en", "fr"] and set(words) == {w.encode() for _, text, _ in rows for w in text.split()}
    told = {w: (t.tolist(), n) for w, t, n in zip(words, targets, weights)}
    assert told[b"own1"][0] == [1, 0] and told[b"own2"][0] == [0, 1] and told["été".encode()][0] == [0, 1]
    # 800 times as often: the root of it as a weight.
    assert abs(told[b"house"][1] / np.mean([n for w, (_, n) in told.items() if w.startswith(b"own")]) - 800**0.5) < 0.5
    assert abs(weights.sum() - language.STEPS * language.BATCH) < 200


def test_batches_are_drawn_from_all_words(spark, monkeypatch):
    """More words than the batches take: all are as likely, in any partitions; and more languages than any list holds."""
    from pulsecheck.llm import language

    monkeypatch.setattr(language, "fit", lambda words, targets, weights: (words, targets, weights))
    monkeypatch.setattr(language, "STEPS", 4)
    rows = [(i, " ".join(f"w{i * 10 + j}" for j in range(10)), f"l{i % 450}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (names, (words, targets, weights)), (_, (again, _, _)) = (language.train(docs.repartition(n)) for n in (1, 9))
    assert len(names) == targets.shape[1] == 450 and words == again
    assert abs(len(words) - 1024) < 100 and (weights == 1).all() and len({int(w[1:]) // 1000 for w in words}) == 9


def test_bar_is_of_every_held_out_text(spark):
    from pulsecheck.llm import language

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(WORDS["en" if i % 2 else "fr"]) for _ in range(rng.randrange(1, 30))) + rng.choice(["", " qx#@", " 12%&~ zzkq"]), "en" if i % 2 else "fr") for i in range(4000)]
    rows += [(6000 + i, "#@%~ qxzj" * 50, None) for i in range(50)] + [(7000 + i, "12 !", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    net = language.Network(3, seed=3)
    held = [text.encode() for i, text, lang in rows if lang and zlib.crc32(str(i).encode()) % 5 == 0 and i < 6000]
    share, spread, _ = language.Judge(net).noise(held)
    model = language.spoken(docs, net)
    assert len(held) > 700 and model.bar == pytest.approx(max(language.LEAST_NOISE, share.max())) and model.spread == pytest.approx(spread.mean())
