"""Training and scoring hold the n-grams of a part of the words at a time, and the same scores come of it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from kelpline.llm import toxicity


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=14)) for _ in range(150)) for _ in range(200)]
    labels = [i % 2 for i in range(len(texts))]
    return [f"{t} {'grolk' if y else 'mild'} {t[:40]}" for t, y in zip(texts, labels)], labels


def most_mb(made) -> float:
    tracemalloc.start()
    made()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_many_distinct_words_train_in_little_memory(corpus, monkeypatch):
    """30,000 words have 1.5 million n-grams: all of them in hand with their hashes and places took 134 MB, and 127 in scoring."""
    monkeypatch.setattr(toxicity, "STEPS", 2)
    assert most_mb(lambda: toxicity.train(*corpus)) < 100


def test_many_distinct_words_are_scored_in_little_memory(corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 2)
    texts, labels = corpus
    net = toxicity.train(texts[:20], labels[:20])
    assert most_mb(lambda: toxicity.Scorer(net).scores(texts)) < 100


def test_parts_make_the_same_network(corpus, monkeypatch):
    """Words in parts of 100 give what all of them at once give."""
    monkeypatch.setattr(toxicity, "STEPS", 5)
    texts, labels = corpus[0][:40] + ["", None], corpus[1][:40] + [0, 1]
    nets = []
    for part in (10**9, 100):
        monkeypatch.setattr(toxicity, "PART", part, raising=False)
        nets.append(toxicity.train(texts, labels))
    one, other = nets
    assert one.vocabulary == other.vocabulary and np.array_equal(one.gram_keys, other.gram_keys)
    assert all(np.allclose(one.p[k], other.p[k], atol=1e-5) for k in one.p)


def test_blocks_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(toxicity, "CHARS", 10)
    for texts in ([], [None], ["a" * 30], ["abc"] * 9 + [None, "", "é" * 11, "a" * 50, "b"]):
        blocks = [b.to_pylist() for b in toxicity._blocks(pa.array(texts, pa.string()))]
        assert [t for b in blocks for t in b] == texts
        assert all(sum(len(t or "") for t in b[1:]) <= 10 for b in blocks)
