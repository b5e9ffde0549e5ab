"""Scores against a plain forward pass: every window of a text on its own, a word and a unit at a time."""

import math
import random

import numpy as np
import pytest

from kelpline.llm import toxicity


def _sigma(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _word(net, word):
    """A word's inputs: its own row, and the greatest of its n-grams' rows in each place; row 0 for what isn't known."""
    h, _ = toxicity.grams([word])
    rows = {int(k): i + 1 for i, k in enumerate(net.gram_keys.tolist())}
    chars = [net.p["chars"][rows.get(int(x), 0)] for x in h]
    return [float(v) for v in net.p["words"][net.vocabulary.get(word, 0)]] + [max(float(c[d]) for c in chars) for d in range(toxicity.CHAR_DIMS)]


def _states(net, inputs, way):
    """Hidden states of one direction, in the order of the words."""
    n = toxicity.HIDDEN
    w, u, c = (net.p[f"{k}{way}"].astype(float) for k in ("W", "U", "c"))
    h, out = [0.0] * n, {}
    for t in range(len(inputs)) if way == "f" else reversed(range(len(inputs))):
        x = [sum(inputs[t][d] * w[d, j] for d in range(len(inputs[t]))) + c[j] for j in range(3 * n)]
        s = [sum(h[d] * u[d, j] for d in range(n)) for j in range(3 * n)]
        z, r = ([_sigma(x[k * n + j] + s[k * n + j]) for j in range(n)] for k in (0, 1))
        new = [math.tanh(x[2 * n + j] + r[j] * s[2 * n + j]) for j in range(n)]
        h = [h[j] + z[j] * (new[j] - h[j]) for j in range(n)]
        out[t] = h
    return [out[t] for t in range(len(inputs))]


def plain(net, text):
    """The worst window's score; a text without words is a window whose one word is the empty one, masked."""
    words = toxicity.words_of(text)
    best = 0.0
    for start in toxicity.windows(len(words)):
        inputs = [_word(net, w) for w in words[start : start + toxicity.WINDOW]]
        if not inputs:
            return None
        h = [f + b for f, b in zip(_states(net, inputs, "f"), _states(net, inputs, "b"))]
        a = net.p["A"].astype(float)
        e = [sum(math.tanh(sum(x[d] * a[d, j] for d in range(len(x)))) * float(net.p["a"][j]) for j in range(toxicity.ATTENTION)) for x in h]
        weights = [math.exp(v - max(e)) for v in e]
        pooled = [sum(w * x[d] for w, x in zip(weights, h)) / sum(weights) for d in range(len(h[0]))]
        best = max(best, _sigma(sum(p * float(o) for p, o in zip(pooled, net.p["o"])) + float(net.p["z"][0])))
    return best


@pytest.fixture(scope="module")
def net():
    rng = random.Random(4)
    names = "alpha beta gamma delta grolk snarf über 東京".split()
    texts = [" ".join(rng.choices(names, k=rng.randrange(3, 60))) for _ in range(120)]
    return toxicity.train(texts, [int("grolk" in t and "snarf" in t) for t in texts])


def test_scores_equal_a_plain_pass(net):
    rng = random.Random(5)
    names = "alpha beta gamma grolk snarf unseen über 東京 a x1".split()
    texts = [" ".join(rng.choices(names, k=n)) for n in (1, 2, 15, 16, 17, 31, 32, 33, 47, 48, 49, 63, 64, 65, 80, 97)]
    texts += ["x" * 90 + " grolk", "Grolk, SNARF! über..."]
    for scores in (toxicity.Scorer(net).scores(texts), np.concatenate([toxicity.Scorer(net).scores([t]) for t in texts])):
        for text, got in zip(texts, scores):
            assert got == pytest.approx(plain(net, text), abs=2e-5), text[:40]


def test_windows_take_the_worst(net):
    """Words that score high are found wherever they stand in a long text."""
    calm = ["alpha", "beta", "gamma"] * 40
    alone = toxicity.Scorer(net).scores([" ".join(calm)])[0]
    for place in (0, 1, 31, 32, 50, 100, 118):
        text = " ".join([*calm[:place], "grolk", "snarf", *calm[place + 2 :]])
        assert toxicity.Scorer(net).scores([text])[0] >= alone


def test_empty_texts_have_one_score(net):
    scores = toxicity.Scorer(net).scores([None, "", " ", "...", "alpha"])
    assert len(set(scores[:4].tolist())) == 1 and 0 <= scores[0] <= 1
