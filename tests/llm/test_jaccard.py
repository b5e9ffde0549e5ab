"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from kelpline.llm import jaccard
from kelpline.llm.components import components


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def brute(docs, width, percent):
    own = {i: sets(t, width) for i, t in docs}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in own:
        for j in own:
            if i < j and own[i] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(own[i]), find(i)) for i in own}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 80))] for _ in range(12)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "Ärger x")]
    for i in range(6, 90):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((i, " ".join(text)))
    return docs


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 90), (2, 5, 80), (3, 2, 50)])
def test_equals_all_pairs(spark, seed, width, percent):
    docs = corpus(seed)
    found = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"), width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute(docs, width, percent)


def family(seed, words, copies, cut, changed):
    """An original and copies that lose a run of words or have some changed: near it, not always linked with it."""
    rng = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(words)]
    out = [base]
    for k in range(copies):
        text = list(base)
        at = rng.choice((0, words // 3, words // 2)) + rng.randrange(4)
        del text[at : at + rng.randint(*cut)]
        for i in range(rng.randint(*changed)):
            text[rng.randrange(len(text))] = f"n{seed}c{k}x{i}"
        out.append(text)
    return [" ".join(x) for x in out]


def test_copies_that_their_original_does_not_link(spark):
    texts = family(1, 120, 40, (8, 22), (0, 1)) + family(2, 200, 30, (0, 40), (0, 3)) + family(3, 90, 30, (4, 18), (0, 0))
    docs = list(enumerate(texts))
    random.Random(9).shuffle(docs)
    want = brute(docs, 3, 90)
    assert len({root for _, root in want.values()}) > 10  # some are linked with each other alone
    found = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == want


def test_near_copies_are_met_through_their_original(spark):
    """2000 near copies of one text: a link each with the original, not with each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(base))]
    for i in range(1, 2001):
        text = list(base)
        text[rng.randrange(60)] = f"new{i}"
        docs.append((i, " ".join(text)))
    asked = []
    kept = jaccard._compared
    jaccard._compared = lambda docs, classes, pairs, *rest: asked.append(pairs.count()) or kept(docs, classes, pairs, *rest)
    try:
        found = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        jaccard._compared = kept
    assert {r["component_id"] for r in found} == {0} and sum(asked) < 4 * len(docs)


def test_regions_of_one_set_are_left_out(spark, monkeypatch):
    """Of a corpus so large that every bucket of the histogram is filled, only regions that sets share are shuffled."""
    monkeypatch.setattr(jaccard, "rarity", lambda docs, width: np.full(1 << jaccard.BITS, 99))
    monkeypatch.setattr(jaccard, "PACKED", 500)
    texts = family(4, 120, 12, (1, 6), (0, 1)) + [" ".join(f"v{i}x{k}" for k in range(150)) for i in range(60)] + ["", None]
    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    own = jaccard._measured(table, 3, 90)
    placed = [(r["digest"], s) for r in own.collect() for s in r["regions"]]
    left = {(r["digest"], s) for r in jaccard._classes(own).collect() for s in r["regions"]}
    times = {}
    for _, s in set(placed):
        times[s] = times.get(s, 0) + 1
    shared = {(d, s) for d, s in placed if times[s] > 1}
    assert shared and shared <= left and len(left - shared) < 0.4 * (len(set(placed)) - len(shared))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(table).collect()} == brute(docs, 3, 90)


def test_odd_rows(spark):
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, None), (3, "A B  C")]
    found = jaccard.classes(spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n int, c string"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=repr)
    assert got == sorted([(None, 3), (7, 3), (7, 3), (None, None), (3, 3)], key=repr)
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unique_documents(spark):
    docs = corpus(5)
    want = brute(docs, 5, 80)
    kept = jaccard.unique_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, (_, root) in sorted(want.items()) if root == i]


def test_unique_documents_decides_by_row(spark):
    a, b, c, d = ("one two three four five six", "red green blue black white grey", "north south east west up down", "dog cat cow pig hen fox")
    rows = [(7, a), (7, a), (9, a.upper()), (None, a), (None, b), (None, b), (7, c), (8, c), (5, c), (5, d), (None, None)]
    kept = jaccard.unique_documents(spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, __n int").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(7, a), (None, b), (5, c), (5, d), (None, None)], key=repr)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200, rng.randint(200, 260)) for _ in range(50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0}
    assert {v for k, v in found.items() if k >= 200} == {200} and 100 not in found
