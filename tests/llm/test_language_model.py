"""The language model against plain versions of its parts."""

import random

import numpy as np
import pytest

pytest.importorskip("simloom.llm")

from simloom.llm import decontaminate, language_id


def plain_ftrl(rows, labels, n_labels, order, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-4):
    """Follow the regularised leader, one weight after the other."""
    z, n = {}, {}

    def weight(i, k):
        x = z.get((i, k), 0.0)
        if abs(x) <= l1:
            return 0.0
        return -(x - np.sign(x) * l1) / ((beta + n.get((i, k), 0.0) ** 0.5) / alpha + l2)

    for r in order:
        at, value = rows[r]
        w = {(i, k): weight(i, k) for i in at for k in range(n_labels)}
        logit = [sum(v * w[i, k] for i, v in zip(at, value, strict=True)) for k in range(n_labels)]
        p = np.exp(np.array(logit) - max(logit))
        p /= p.sum()
        for i, v in zip(at, value, strict=True):
            for k in range(n_labels):
                g = (p[k] - (labels[r] == k)) * v
                was = n.get((i, k), 0.0)
                z[i, k] = z.get((i, k), 0.0) + g - ((was + g * g) ** 0.5 - was**0.5) / alpha * w[i, k]
                n[i, k] = was + g * g
    return weight


def test_training_equals_a_plain_one():
    r = random.Random(1)
    bias = 1 << language_id.BITS
    rows = []
    for _ in range(30):
        at = sorted(r.sample(range(40), 6))
        rows.append((np.array([*at, bias]), np.array([*(r.random() for _ in at), 1.0])))
    labels = np.array([r.randrange(3) for _ in rows])
    weights, b = language_id.train_ftrl(rows, labels, 3, epochs=2, seed=4)
    rng = np.random.default_rng(4)
    plain = plain_ftrl([(a.tolist(), v.tolist()) for a, v in rows], labels, 3, [int(i) for _ in range(2) for i in rng.permutation(len(rows))])
    for i in range(40):
        assert np.allclose(weights[i], [plain(i, k) for k in range(3)])
    assert np.allclose(b, [plain(bias, k) for k in range(3)])


def test_temperature_is_the_best_one():
    r = np.random.default_rng(2)
    logits = r.normal(size=(200, 3)) * 4
    p = np.exp(logits / 3)
    labels = np.array([r.choice(3, p=x / x.sum()) for x in p])  # as sure as a temperature of 3 makes them

    def loss(t):
        x = logits / t
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(200), labels]))

    t = language_id.calibrate(logits, labels)
    assert all(loss(t) <= loss(t * f) + 1e-9 for f in (0.5, 0.9, 1.1, 2.0))


def test_long_texts_count_alike(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choices("abcé 1İ.", k=3000)).encode()
    table = np.random.default_rng(1).normal(size=(1 << language_id.BITS, 4)).astype(np.float32)
    model = language_id.Model(["a", "b", "c", "d"], table, np.zeros(4), 0.01)
    whole = model.predict([text, b"ab", b" 1", b""])
    grams = language_id.ngram_features([text])[0]
    monkeypatch.setattr(language_id, "LONG", 100)
    seen, has = language_id.long_counts(text)
    assert has and (seen == np.bincount(grams.ravel(), minlength=1 << language_id.BITS)).all()
    parts = model.predict([text, b"ab", b" 1", b""])
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], atol=1e-4)


def test_held_out_accuracy(spark):
    """Four invented languages of other letter frequencies; the fifth that is held out is told right."""
    r = random.Random(5)
    letters = {"aa": "abcdeeeiin", "bb": "kklmnoouuz", "cc": "rstaaoovéé", "dd": "iiyyhhjlöß"}
    rows = [(i, " ".join("".join(r.choices(letters[k], k=r.randint(2, 7))) for _ in range(25)), k) for i, k in enumerate(r.choices(list(letters), k=400))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit_language_model(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs.filter(language_id.held_out()), model).collect()
    truth = {i: k for i, _, k in rows}
    assert len(found) > 40 and sum(x["lang_pred"] == truth[x["doc_id"]] for x in found) >= 0.98 * len(found)


def test_items_named_by_text(spark):
    docs = spark.createDataFrame([(0, "a b c d e f g h i j k")], "doc_id bigint, text string")
    items = spark.createDataFrame([("b2", "a b c d e f g h i j"), ("a1", "j k"), (None, "c d"), ("x", "z")], "item_id string, text string")
    assert decontaminate.decontaminate(docs, items).first()["items"] == ["a1", "b2"]
