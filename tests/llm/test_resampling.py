"""Resampling against plain Python, whole and in small chunks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from kelpline.llm import common, resampling

SF = "/root/testdata/sf0.001"


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain(docs, target):
    s, t = (Counter(bucket(f) for _, text in rows for f in features(text)[1]) for rows in (docs, target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(enough[: 25 * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_chunks_own_every_start():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abÜ0.-", k=rng.randrange(1, 9))) for _ in range(300))
    for grams in (1, 2, 3):
        whole = resampling.words_of(text.encode())
        want = Counter(resampling.buckets_of(whole, [], grams).tolist())
        for size in (1, 7, 50, 10**6):
            parts = list(resampling.chunks(text, size, grams - 1))
            assert [w for own, _ in parts for w in own.split()] == whole
            assert sum((Counter(resampling.buckets_of(own.split(), carry.split(), grams).tolist()) for own, carry in parts), Counter()) == want
    assert list(resampling.chunks(None)) == [(b"", b"")] == list(resampling.chunks(""))
    assert len(list(resampling.chunks("x" * 1000, 10))) == 1


@pytest.mark.parametrize("size", [1 << 16, 64])
def test_rows(spark, size):
    rng = random.Random(5)
    texts = [None, "", " .\n", "A", "É É é", "The Cat sat " * 700, "_" * 200, "x" * 500]
    texts += [" ".join(rng.choices("the a cat Dog house, über 東京 42 it's".split(), k=rng.randrange(10, 60))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c " * 20), (7, texts[50]), (60, texts[60]), (2**53 + 1, "z y x " * 9)]
    target = [(i, " ".join(rng.choices("the cat house zebra".split(), k=30))) for i in range(9)] + [(None, None)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, rank int, row string").repartition(3)
    got = resampling.resampled(docs, spark.createDataFrame(target, "item_id long, text string").withColumnRenamed("item_id", "doc_id"), size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, target)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert resampling.resampled(docs.limit(0), docs).collect() == []
    assert len(resampling.resampled(docs, docs.limit(0)).collect()) == 2


def test_ranked(spark):
    rows = spark.createDataFrame([(i * 37 % 11, i) for i in range(500)], "v long, i long")
    got = common.ranked(rows, [rows.v.desc(), rows.i.asc()], "n").collect()
    assert [(r["v"], r["i"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(((i * 37 % 11, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    assert sorted(r["n"] for r in got) == list(range(1, 501))


def test_query(spark):
    docs, target = (list(map(tuple, spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect())) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, resampling.query(spark, SF).collect()), key=repr) == plain(docs, target)
