"""The pipeline's stages against plain versions, and as a whole on odd tables."""

import random

import numpy as np
import pytest

from kelpline.llm import quality, secrets, toxicity

from .test_jaccard import brute
from .test_operators import plain_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(160):
        text = rng.choices(vocabulary, k=rng.randint(60, 140))
        toxic = i % 5 == 0
        if toxic:
            text[10:12] = ["grolk", "vexhat"]
        if i % 7 == 0:
            text.insert(5, "token: abcdefgh12")
        rows.append((i, " ".join(text), "en", f"s{i % 2}"))
        labels.append((i, 1, int(toxic)))
    rows += [(200 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "s0") for i in range(1, 40, 3)]  # exact and near copies
    rows += [(None, rows[2][1], None, None), (3, rows[3][1], "en", "s1"), (300, None, "en", "s0"), (301, "", None, "s1"), (302, "too short", "en", "s0")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, folder, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    kept = []
    for name, stage in pipeline.STAGES:
        out = f"{tmp_path}/{len(kept)}"
        stage(spark, docs, folder).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        kept.append((name, before, docs))
        if columns and len(kept) < len(pipeline.STAGES):
            assert docs.columns == columns
        columns = docs.columns if len(kept) == 1 else columns
    (_, raw, good), (_, _, mild), (_, _, once), (_, _, clean), (_, _, packed) = kept
    judged = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality.judge(raw).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for (i, _), k in judged.items() if k} and good.count() < raw.count()
    # the network that the stage trains, applied text by text
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scorer = toxicity.Scorer(toxicity.learned(good.select("doc_id", "text"), labels))
    want = [tuple(r) for r in good.collect() if scorer.scores([r["text"]])[0] < 0.5]
    assert plain(mild) == sorted(want, key=repr) and not any("grolk vexhat" in r["text"] for r in mild.collect())
    # one row of every component, that of smallest id
    rows = [tuple(r) for r in mild.collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    roots = brute([(place, rows[k][1]) for place, k in enumerate(order)], 5, 80)
    assert sorted((rows[order[place]][:2] for place, (_, root) in roots.items() if place == root), key=repr) == sorted((tuple(r)[:2] for r in once.collect()), key=repr)
    assert once.count() < mild.count()
    texts = {r["doc_id"]: r["text"] for r in once.collect()}
    assert any(plain_secrets(t) for t in texts.values())
    for r in clean.collect():
        assert r["text"] == secrets.redacted(texts[r["doc_id"]]) and not plain_secrets(r["text"]) and r["n_chars"] == len(r["text"])
    places = {}
    for r in packed.collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    whole = pipeline.run(spark, folder)
    assert plain(whole.select("doc_id", "piece", "start", "length", "ids_crc32")) == plain(packed.select("doc_id", "piece", "start", "length", "ids_crc32"))


def test_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
