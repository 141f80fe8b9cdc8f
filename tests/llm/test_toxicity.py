"""What toxicity learns: exact words, expressions of two words, and every fold the contract allows."""

import random
import zlib

import pytest

from pulsecheck.llm import common, samples, toxicity

CALM = ["and", "the", "house", "river", "small", "green", "walks", "over", "under", "garden", "seven", "bread"]


def fold(key):
    return zlib.crc32(str(key).encode()) % 4


def tables(spark, toxic, calm, n=600, folds=(0, 1, 2, 3)):
    """Every third text is toxic and holds what `toxic` makes, where its fold is one of `folds`; the others what `calm` makes."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        words = [rng.choice(CALM) for _ in range(30)]
        for _ in range(4):
            words.insert(rng.randrange(len(words)), (toxic if bad and fold(i) in folds else calm)(rng))
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame([(i, bad) for i, _, bad in rows], "doc_id long, toxic int")


def scored(spark, trained, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["score"] for r in sorted(toxicity.toxicity(docs, *trained).collect())]


def test_words_of_one_hash_cell_are_not_mixed(spark):
    low = (1 << 18) - 1
    twin = next(w for w in (f"w{i}" for i in range(10_000_000)) if zlib.crc32(w.encode()) & low == zlib.crc32(b"awful") & low)
    trained = toxicity.train(*tables(spark, lambda rng: "awful", lambda rng: "kind"))
    awful, mixed, unknown = scored(spark, trained, "the awful house", f"the {twin} house", "the neverseen house")
    assert awful > 0.5 and mixed == unknown < awful


@pytest.mark.parametrize("hot", [0, 7])
def test_joined_evidence_scores_like_broadcast(spark, hot):
    docs, labels = tables(spark, lambda rng: rng.choice(["awful", "vile mess"]), lambda rng: rng.choice(["mess", "vile", "kind"]))
    docs = docs.union(spark.createDataFrame([(None, None), (7000, ""), (7000, ""), (7001, "awful " * 3000), (7002, "neverseen")], docs.schema))
    whole, parts = toxicity.train(docs, labels), toxicity.train(docs, labels, hot=hot)
    assert whole[0].rest is None and parts[0].rest is not None
    a, b = (sorted(((r["doc_id"] or -1, r["score"]) for r in toxicity.toxicity(docs, *t).collect())) for t in (whole, parts))
    assert len(a) == len(b) == 605 and all(x == y and abs(s - t) < 1e-5 for (x, s), (y, t) in zip(a, b))


@pytest.mark.parametrize("hot", [0, 7])
def test_texts_are_read_once_when_evidence_is_joined(spark, hot):
    """Passages of any width, texts shorter than one among them; what is joined has no text."""
    docs, labels = tables(spark, lambda rng: rng.choice(["awful", "vile mess"]), lambda rng: rng.choice(["mess", "vile", "kind"]))
    odd = [None, "", "awful", "vile mess", "mess vile kind", "neverseen", "the " * 50 + "vile mess", "neverseen awful " * 2000]
    rows = docs.select(docs.doc_id.alias("key"), "text").union(spark.createDataFrame(list(enumerate(odd, 7000)), "key long, text string"))
    whole, parts = (toxicity.train(docs, labels, hot=n)[0] for n in (toxicity.HOT, hot))
    for passage in toxicity.PASSAGES:
        out = toxicity.differences(rows, parts, passage)
        assert "text#" not in out._jdf.queryExecution().optimizedPlan().toString()
        a, b = (sorted(tuple(r) for r in x.collect()) for x in (toxicity.differences(rows, whole, passage), out))
        assert len(a) == len(b) == 608 and all(x[0] == y[0] and x[1:] == pytest.approx(y[1:], abs=1e-5) for x, y in zip(a, b))


@pytest.mark.parametrize("key", ["long", "string"])
def test_many_labels_move_no_text(spark, monkeypatch, key):
    """Labels beyond the broadcast: repeated, missing, of no document and without a key."""
    docs, labels = tables(spark, lambda rng: "awful", lambda rng: "kind")
    more = spark.createDataFrame([(3, 0), (4, 1), (4, 0), (9000, 1), (None, 1), (5, None)], labels.schema)
    labels = labels.where("doc_id % 7 <> 0").union(more).selectExpr(f"CAST(doc_id AS {key}) AS doc_id", "toxic")
    docs = docs.union(spark.createDataFrame([(None, "no key"), (8000, "no label"), (4, None)], docs.schema)).selectExpr(f"CAST(doc_id AS {key}) AS doc_id", "text")
    joined = samples.labelled(docs, labels, "toxic")
    trained = toxicity.train(docs, labels, sample=10)
    for module in (samples, toxicity):
        monkeypatch.setattr(module, "SENT", 10)
    assert sorted(map(str, samples.labelled(docs, labels, "toxic").collect())) == sorted(map(str, joined.collect()))
    written, settle = {}, toxicity.settle

    def watched(df, name):
        out = settle(df, name)
        written[name] = out.count() if "text" in out.columns else 0
        return out

    monkeypatch.setattr(toxicity, "settle", watched)
    again = toxicity.train(docs, labels, sample=10)
    assert sum(written.values()) <= 2 * 10
    assert again[1] == trained[1] and again[2] == pytest.approx(trained[2])
    assert samples.moves(docs.selectExpr("CAST(doc_id AS double) AS doc_id"), labels)


def test_words_are_those_of_the_pattern():
    rng = random.Random(6)
    for _ in range(2000):
        text = bytes(rng.randrange(256) for _ in range(rng.randrange(60)))
        assert common.words_of(text) == common.WORD.findall(text.lower())


def test_expression_of_harmless_words(spark):
    toxic, calm = (lambda rng: rng.choice(["black hole", "black", "hole"])), (lambda rng: rng.choice(["black", "hole"]))
    trained = toxicity.train(*tables(spark, toxic, calm, n=240))
    bad, good = scored(spark, trained, "the garden black hole over the black hole", "the garden black over hole the black and hole")
    assert bad > good + 0.2


def test_copies_of_a_text_count_once(spark):
    docs, labels = tables(spark, lambda rng: "awful", lambda rng: "kind")
    copies = [(1000 + i, "the kind copied garden of bread", 1) for i in range(400)]
    docs = docs.union(spark.createDataFrame([c[:2] for c in copies], docs.schema))
    labels = labels.union(spark.createDataFrame([(k, bad) for k, _, bad in copies], labels.schema))
    assert scored(spark, toxicity.train(docs, labels), "the kind house")[0] < 0.5


def test_every_allowed_fold_is_counted(spark):
    """A word that only the fitting fold has, besides one that all folds have."""
    docs, labels = tables(spark, lambda rng: "awful", lambda rng: "kind", n=1200)
    rare = docs.collect()
    rows = [(r["doc_id"], r["text"].replace("awful", "rotten", 2) if fold(r["doc_id"]) == 3 else r["text"]) for r in rare]
    trained = toxicity.train(spark.createDataFrame(rows, docs.schema), labels)
    rotten, unknown = scored(spark, trained, "the rotten house", "the neverseen house")
    assert rotten > unknown + 0.1


def test_only_copied_texts_are_written(spark, monkeypatch):
    """Of 600 texts, 40 of them copies of one, those that nothing equals stay where they are."""
    docs, labels = tables(spark, lambda rng: "awful", lambda rng: "kind")
    copied = [k for k in range(1, 600, 3) if fold(k) != 2][:40]
    rows = [(r["doc_id"], "the same garden" if r["doc_id"] in copied else r["text"]) for r in docs.collect()]
    written, settle = {}, toxicity.settle

    def watched(df, name):
        out = settle(df, name)
        written[name] = out.count() if "text" in out.columns else 0
        return out

    monkeypatch.setattr(toxicity, "settle", watched)
    toxicity.train(spark.createDataFrame(rows, docs.schema), labels, sample=10)
    assert sum(written.values()) <= 1 + 2 * 10


@pytest.mark.parametrize("listed", [{}, {b"and": 2, b"the": 3, b"bread": 5000}])
def test_pairs_are_counted_by_distinct_texts(spark, listed, capsys):
    rng = random.Random(5)
    texts = [(" ".join(rng.choice(CALM) for _ in range(rng.randrange(9))), i % 2, i % 3 % 2) for i in range(300)]
    found = toxicity.pair_counts(spark.createDataFrame(texts, "text string, label int, fitting int").repartition(3), listed)
    codes, wanted = toxicity.Coder(listed).codes, {}
    for text, bad, fitting in texts:
        words = [toxicity.START, *codes(text.encode()).tolist()]
        for pair in set(zip(words, words[1:])):
            wanted.setdefault(pair, [0] * 4)[bad + 2 * fitting] += 1
    got = {(r[0] % 2**64, r[1] % 2**64): list(r[2:]) for r in found.select("before", "word", "n0", "n1", "h0", "h1").collect()}
    assert got == wanted
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(before" in plan
