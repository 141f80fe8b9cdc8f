"""Trained operators: gradients and sums against brute force, held-out accuracy, and odd rows."""

import random
import zlib
from itertools import product

import numpy as np
import pytest

from pulsecheck.llm import language, quality, toxicity
from pulsecheck.llm.queries import op4_toxicity, op6_quality, op8_language

SF = "/root/testdata/sf0.01"


def test_recurrent_gradients():
    net = language.Network(3, states=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, length = language.as_codes([b"abc", b"", b"zzzzzz\xc3"])
    target = np.array([[1, 0, 0], [0, 0.5, 0.5], [0, 0, 1.0]])
    _, g = net.gradient(codes, length, target)
    for name, of in g.items():
        at = np.unravel_index(np.abs(of).argmax(), of.shape)
        old = net.p[name][at]
        values = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = old + step
            values.append(net.gradient(codes, length, target)[0])
        net.p[name][at] = old
        assert abs((values[0] - values[1]) / 2e-3 - of[at]) < 1e-4


def test_chain_sums_match_every_labelling():
    rng = np.random.default_rng(0)
    first, unary, change = np.array([0, 1, 4, 6, 10]), rng.normal(size=(10, 2)), rng.normal(size=(2, 2))
    state, moves, total = quality.marginals(unary, change, first)
    expected, pairs, logs = np.zeros((10, 2)), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        z, own, of = 0.0, np.zeros((b - a, 2)), np.zeros((2, 2))
        for s in product((0, 1), repeat=b - a):
            p = np.exp(sum(unary[a + i, c] for i, c in enumerate(s)) + sum(change[c, d] for c, d in zip(s, s[1:])))
            z += p
            for i, c in enumerate(s):
                own[i, c] += p
            for c, d in zip(s, s[1:]):
                of[c, d] += p
        expected[a:b], pairs, logs = own / z, pairs + of / z, logs + np.log(z)
    assert np.allclose(state, expected) and np.allclose(moves, pairs) and np.isclose(total, logs)


def auc(score, truth):
    pos, neg = score[truth == 1], score[truth == 0]
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = op6_quality(spark, SF).toPandas().merge(labels, on="doc_id")
    good = good[good.held_out]
    assert auc(good.score.to_numpy(), good.quality.to_numpy()) > 0.95
    toxic = op4_toxicity(spark, SF).toPandas().merge(labels, on="doc_id")
    assert (toxic.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in toxic.doc_id]).all()
    toxic = toxic[toxic.held_out]
    assert auc(toxic.score.to_numpy(), toxic.toxic.to_numpy()) > 0.75
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    told = op8_language(spark, SF).toPandas().merge(docs, on="doc_id")
    assert (told.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in told.doc_id]).all()
    told = told[told.held_out]
    assert (told.lang_pred == told.lang).mean() > 0.97


def small(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        words = [rng.choice(["and", "the", "house", "river", "small"]) for _ in range(40)] + (["awful", "rotten"] * 4 if bad else [])
        rng.shuffle(words)
        rows.append((i, (" " + "!! $$ " * bad).join(words), "en" if i % 2 else "xx", "c"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(None, None, None, "c"), (500, "", "en", "c"), (500, "", "en", "c"), (501, "1 2 !", "xx", "c"), (502, "awful " * 60_000, "en", "c"), (503, "line\n" * 30_000, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    return docs.repartition(5), spark.createDataFrame([*labels, *labels[:5], (None, 1, 1), (600, None, None)], "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    docs, labels = small(spark)
    none = labels.limit(0)
    for out in (
        toxicity.toxicity(docs, *toxicity.train(docs, labels)),
        quality.quality(docs, *quality.train(docs, labels)),
        toxicity.toxicity(docs, *toxicity.train(docs, none)),
        quality.quality(docs, *quality.train(docs, none)),
    ):
        rows = out.collect()
        assert len(rows) == 246 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    models = toxicity.train(docs, labels)
    by = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, *models).collect()}
    assert by[502] == 1 and by[500] == 0 and sum(by[i] == (i % 3 == 0) for i in range(240)) > 230
    assert toxicity.toxicity(docs.limit(0), *models).count() == 0
    assert quality.quality(docs.limit(0), *quality.train(docs.limit(0), none)).count() == 0


def test_language_of_odd_rows(spark):
    docs, _ = small(spark)
    names, net = language.train(docs, learn="doc_id % 5 <> 0")
    assert names == ["en", "xx"]
    rows = language.identify(docs, names, net).collect()
    told = {r["doc_id"]: r for r in rows}
    assert len(rows) == 246 and all(told[i]["lang_pred"] == "und" for i in (None, 500, 501)) and told[502]["lang_pred"] in names
    same, noisy = language.train(docs, learn="doc_id % 5 <> 0", noise=True)
    kept = language.in_known_language(docs, language.spoken(docs, noisy))
    assert same == names and kept.columns == docs.columns and kept.count() == 242
    assert language.in_known_language(docs.limit(0), language.Spoken(noisy)).count() == 0
    nothing = language.train(docs.where("lang IS NULL"))
    assert nothing == ([], None) and {r["lang_pred"] for r in language.identify(docs, *nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), names, net).count() == 0


@pytest.mark.parametrize("text", [b"", b"a", b"\n", b"a\n\nb\n"])
def test_lines_of_any_text(text):
    x, length, first = quality.line_features([text, b"", text])
    assert len(x) == len(length) == first[-1] and (np.diff(first) >= 1).all() and np.isfinite(x).all()
