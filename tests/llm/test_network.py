"""The toxicity network's scores against a plain loop over words, windows and steps."""

import numpy as np
import pytest

from vertexloom.llm import textscan, toxicity

TEXTS = ["", None, "one", "(Hello), WORLD!! --- *** x", "a " * 24, "b " * 25, " ".join(f"Wörd{i % 7}," for i in range(200)), "é" * 300 + " tail", "x" * 64 + " " + "y" * 65, "日本語 テキスト　です", "one two\tthree\x0bfour\nfive", "a " * 40 + "zq zq zq " + "a " * 40]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    words = lambda bad: " ".join([f"w{i}" for i in rng.integers(0, 60, 30)] + ["zq", "zqx"] * (2 * bad))
    return toxicity.train([(words(i % 2), i % 2) for i in range(120)], epochs=2)


def _plain(model, text):
    """The highest score of any window, a word, a window and a step at a time."""
    sigmoid, w = (lambda x: 1 / (1 + np.exp(-x))), {k: v.astype(np.float64) for k, v in model.weights.items()}
    vectors = []
    for t in toxicity.tokens(text):
        raw = np.frombuffer(t.encode(), np.uint8)
        h = textscan.run_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
        grams = toxicity.trigrams(t)
        at = np.flatnonzero(model.known == h)
        odds = float(model.odds[at[0]]) if len(at) else 0.0
        vectors.append(np.concatenate([w["word"][int(h) % toxicity.WORD_ROWS], w["char"][grams].mean(0), [odds, model.char_odds[grams].mean()]]))
    n, best = len(vectors), -np.inf
    for start in range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        own = vectors[start : start + toxicity.WINDOW]
        states = [np.zeros((2, len(own), toxicity.HIDDEN))][0]
        for d, name in enumerate("fb"):
            h = np.zeros(toxicity.HIDDEN)
            for i in range(len(own)) if d == 0 else reversed(range(len(own))):
                gz, gr, gc = np.split(own[i] @ w[f"{name}x"] + w[f"{name}c"], 3)
                uz, ur, uc = np.split(w[f"{name}h"], 3, axis=1)
                z, r = sigmoid(gz + h @ uz), sigmoid(gr + h @ ur)
                h = (1 - z) * h + z * np.tanh(gc + (r * h) @ uc)
                states[d, i] = h
        s = np.concatenate([states[0], states[1]], 1) if own else np.zeros((1, 2 * toxicity.HIDDEN))
        e = np.tanh(s @ w["att"] + w["att_c"]) @ w["att_v"]
        a = np.exp(e - e.max())
        best = max(best, (a / a.sum()) @ s @ w["out"] + w["out_c"][0])
    return sigmoid(best)


@pytest.mark.parametrize("group", [1 << 20, 60])
def test_scores_against_a_plain_loop(model, monkeypatch, group):
    monkeypatch.setattr(textscan, "GROUP", group)
    want = [_plain(model, t) for t in TEXTS]
    assert np.allclose(toxicity.Scorer(model).score(TEXTS), want, atol=2e-5)


def test_scores_beyond_the_memory(model, monkeypatch):
    want = toxicity.Scorer(model).score(TEXTS)
    monkeypatch.setattr(toxicity, "MEMORY", 3)
    scorer = toxicity.Scorer(model)
    assert np.allclose([scorer.score([t])[0] for t in TEXTS + TEXTS], want + want, atol=1e-6)


def test_toxic_passages_anywhere(model):
    """A passage is found wherever it stands."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 60, 90)]
    scores = toxicity.Scorer(model).score([" ".join([*words[:k], "zq", "zqx", "zq", "zqx", *words[k:]]) for k in range(90)])
    assert min(scores) > 0.5 > toxicity.Scorer(model).score([" ".join(words)])[0]


def test_driver_does_not_train(spark, monkeypatch):
    """Training is a task's work; the driver gets the model."""
    monkeypatch.setattr(toxicity, "Words", None)  # the driver could not scan a text
    rows = [(i, " ".join(["bad" if i % 2 else "good", f"w{i % 5}"] * 9), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert model.trained and len(model.known)
