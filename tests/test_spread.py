"""A compact table, one row group, whose rows mean much work is dealt over tasks; Python holds few pages' elements at once."""

import pyarrow as pa

from kelpline.functions import markup, text
from kelpline.plans import jobs, pages, records
from kelpline.sources import tables


def test_compact_tables_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "DEALT", 100)
    spark.read.parquet("/root/testdata/sf0.01/part.parquet").limit(1000).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = tables.table(spark, str(tmp_path), "part")
    assert rows.rdd.getNumPartitions() == 1 and tables.spread(rows).rdd.getNumPartitions() > 10
    assert sorted(tables.spread(rows).collect()) == sorted(rows.collect())
    for made in (pages.third_source_facts, jobs.recovered_identities, jobs.displayable_rows, records.identity_scores):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() > 10, made.__name__


def test_elements_are_packed(spark, monkeypatch):
    """Whatever is held at once, pages come out in order and whole."""
    texts = ["<p>a</p>" * 5, None, "", "<a href='/x'>y", "<p>b</p>" * 9]
    whole = markup.dom.func(pa.array(texts)).to_pylist()
    monkeypatch.setattr(markup, "HELD", 30)
    assert markup.dom.func(pa.array(texts)).to_pylist() == whole and [len(x["elements"]) for x in whole] == [5, 0, 0, 1, 9]
    assert markup.dom.func(pa.array([], pa.string())).to_pylist() == []


def test_texts_are_packed(monkeypatch):
    """Parts of a batch come out in order, nulls as empty texts."""
    monkeypatch.setattr(text, "PACKED", 2)
    assert text.unescaped.func(pa.array(["a&amp;b", None, "", "&lt", "x"])).to_pylist() == ["a&b", "", "", "<", "x"]
    assert text.unaccented.func(pa.array(["é", None, "x"])).to_pylist() == ["e", "", "x"] and text.unaccented.func(pa.array([], pa.string())).to_pylist() == []
