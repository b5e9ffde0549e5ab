"""Periodic runs against every stretch of every period, on odd and made-up texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm import runs

SF = "/root/testdata/sf0.001"


def all_runs(words: list) -> list[tuple[int, int, int]]:
    """Runs by looking at every period: maximal stretches whose smallest period it is."""
    n, met = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                met.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in met.items())


def planted(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain(doc_id, text):
    words = planted(doc_id, text)
    met = all_runs(words)
    gone = {i for s, n, q in met for i in range(s + q, s + n)}
    best = min(met, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in met), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(met), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 14)), min_size=1, max_size=6))
def test_runs_equal_all_stretches(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert [tuple(r) for r in runs.found(np.append(np.array(words), -1), len(words)).tolist()] == all_runs(words)


def test_extensions():
    rng = random.Random(3)
    words = [rng.randrange(3) for _ in range(300)] * 2
    names = runs.Names(np.append(np.array(words), -1))
    i = np.array([rng.randrange(599) for _ in range(500)])
    j = np.array([rng.randrange(a + 1, 600) for a in i])
    for a, b, right, left in zip(i, j, names.right(i, j), names.left(i, j)):
        assert right == next((k for k in range(600) if b + k >= 600 or words[a + k] != words[b + k]), 600)
        assert left == next((k for k in range(600) if a - k - 1 < 0 or words[a - k - 1] != words[b - k - 1]), 600)


def test_rows(spark, monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "la " * 23, "la " * 24, "ab\tcd\n" * 40 + "end", "x" * 3000 + " y" * 30, "ü 東 " * 50, "a b " * 12 + "a c " * 12]
    texts += [" ".join(rng.choices("one two three".split(), k=200) + rng.choices("p q r s".split(), k=7) * rng.randrange(1, 9)) for _ in range(60)]
    texts += [" ".join(["x"] * rng.randrange(30) + ["y", "x", "x"] * rng.randrange(1, 20)) for _ in range(40)]
    rows = [(i, t, 1, "k") for i, t in enumerate(texts)] + [(3, "a", 1, "k"), (None, "b " * 30, 1, "k"), (None, None, 1, "k"), (2**53 + 1, "c " * 30, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, words string").repartition(3)
    got = runs.digests(runs.planted(docs)).select(COLUMNS).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain(r[0], r[1]) for r in rows), key=key)
    assert runs.digests(runs.planted(docs.limit(0))).collect() == []
    out = {r["doc_id"]: r for r in runs.collapsed(docs.where("doc_id in (5, 6)")).collect()}
    assert out[5]["collapsed"] == "la" and [tuple(r) for r in out[5]["runs"]] == [(0, 24, 1)]
    assert out[6]["collapsed"] == "ab cd end"


def test_small_blocks(monkeypatch):
    """Pieces and batches that are cut anywhere change nothing."""
    import pandas as pd

    texts = ["w%d " % (i % 3) * (5 * i) for i in range(30)] + ["a bb ccc " * 40]
    frame = pd.DataFrame({"doc_id": [str(i) for i in range(len(texts))], "text": texts})
    want = pd.concat(runs._batches(iter([frame])))
    monkeypatch.setattr(runs, "BLOCK", 7)
    monkeypatch.setattr(runs, "WORDS", 50)
    monkeypatch.setattr(runs, "PLACES", 16)
    got = pd.concat(runs._batches(iter([frame])))
    assert got.to_dict("list") == want.to_dict("list")


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in runs.query(spark, SF).collect()}
    assert got == {r["doc_id"]: plain(r["doc_id"], r["text"]) for r in rows}
