"""Operators that SQL can't express, against plain loops, and odd inputs."""

import random
from collections import defaultdict, deque
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kelpline.functions import similarity as S
from kelpline.functions import text as X
from kelpline.operators import audit, consensus, extract, facts, merge, metrics, predicates, resolve, search, state
from kelpline.sources import catalog


def test_identity_text(spark):
    rows = spark.createDataFrame([("Café &amp; Crème N°5",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(X.normalize_identity("t")).collect()] == ["cafe and creme no5", "", ""]


def test_vote_count(spark):
    rows = spark.createDataFrame([("1.2k",), ("1,234",), ("3m",), ("x",), (None,), ("1.2.3",)], "t string")
    assert [r[0] for r in rows.select(X.vote_count(F.col("t"))).collect()] == [1200, 1234, 3_000_000, 0, 0, 1]


def test_similarity(spark):
    rows = spark.createDataFrame([("creed avantus", "creed aventus"), ("", "x"), (None, None)], "a string, b string")
    got = [r[0] for r in rows.select(S.sequence_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "creed avantus", "creed aventus").ratio(), 0, 0]
    rows = spark.createDataFrame([("abcd", "abdc", True), ("abcd", "abcd", False), ("ab", "abc", False)], "a string, b string, e boolean")
    assert all(r[0] == r[1] for r in rows.select(F.coalesce(S.one_swap(F.col("a"), F.col("b")), F.lit(False)), "e").collect())
    rows = spark.createDataFrame([(["avent", "creed"], ["aventus", "creed"], 0.96), ([], ["a"], 0.0)], "q array<string>, t array<string>, e double")
    assert all(r[0] == pytest.approx(r[1]) for r in rows.select(S.token_coverage("q", "t"), "e").collect())


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_taking_turns(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, a, rng.randint(1, 9) / 10) for a in range(12) for b in range(8) if rng.random() < 0.5]
    used, want = set(), set()
    for a in range(12):
        free = [(-s, b) for x, b, _, s in pairs if x == a and b not in used]
        if free:
            used.add(min(free)[1])
            want.add((a, min(free)[1]))
    got = resolve.one_to_one(spark.createDataFrame(pairs, "a long, b long, pos long, score double"), "a", "b", "pos")
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_one_to_one_of_nothing(spark):
    assert resolve.one_to_one(spark.createDataFrame([], "a long, b long, pos long, score double"), "a", "b", "pos").count() == 0


def test_limiter(spark):
    rng = random.Random(1)
    events = [(i, rng.randint(0, 3), rng.randint(0, 200)) for i in range(150)]
    hits, want = defaultdict(deque), {}
    for i, k, t in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        while hits[k] and hits[k][0] < t - 60:
            hits[k].popleft()
        want[i] = len(hits[k]) < 2
        if want[i]:
            hits[k].append(t)
    rows = spark.createDataFrame(events, "seq long, k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["seq"]: r["allowed"] for r in state.limited(rows, "k", "ts", "seq", 2, 60.0).collect()} == want
    assert all(r["allowed"] for r in state.limited(rows, "k", "ts", "seq", 0, 60.0).collect())


def test_queue_fold(spark):
    events = [(1, "enqueue", 0), (1, "claim", 10), (1, "complete", 20), (2, "enqueue", 0), (2, "claim", 1), (2, "fail", 2), (3, "enqueue", 0), (3, "claim", 1), (3, "claim", 2000), (4, "ignore", 0), (4, "requeue", 1)]
    events += [(5, e, 3 * n + i) for n in range(10) for i, e in enumerate(("enqueue", "claim", "fail"))]
    rows = spark.createDataFrame([(k, e, t, i) for i, (k, e, t) in enumerate(events)], "job_key long, event string, s long, seq long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["job_key"]: (r["status"], r["failure_count"]) for r in state.queue_fold(rows).collect()}
    assert got == {1: ("completed", 0), 2: ("pending", 1), 3: ("processing", 0), 4: ("ignored", 0), 5: ("failed", 10)}
    assert state.queue_fold(rows.limit(0)).count() == 0


def test_live_queue_equals_batch(spark, tmp_path):
    from kelpline.streaming.jobs import live_queue

    rows = spark.createDataFrame([(i % 3, e, i, i) for i, e in enumerate(["enqueue"] * 3 + ["claim"] * 3 + ["fail", "complete", "fail"])], "job_key long, event string, s long, seq long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live_queue(stream).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = {(r["job_key"], r["status"]) for r in state.queue_fold(rows).collect()}
    assert {(r["job_key"], r["status"]) for r in spark.table("live").collect()} == batch


def test_metrics_without_votes(spark):
    votes = spark.createDataFrame([(1, "moderate", 3), (1, "odd", 9), (2, "odd", 1), (1, "Eternal", 1)], "k long, label string, n long")
    got = {r["k"]: (r["score"], r["votes"]) for r in metrics.weighted_adequacy(votes, ["k"], "label", "n", metrics.LONGEVITY).collect()}
    assert got == {1: (77.5, 4), 2: (None, 0)}


def test_facts_and_audit(spark):
    rows = spark.createDataFrame([("x", " Unknown "), (None, "y")], "a string, b string")
    got = [r[0] for r in rows.select(facts.missing({"a": X.is_fact(F.col("a")), "b": X.is_fact(F.col("b"))})).collect()]
    assert got == [["b"], ["a"]]
    rows = spark.createDataFrame([("Aventus|aventus ", "Creed"), (None, None), ("A 2002", "a 2002")], "n string, b string")
    got = [r[0] for r in rows.select(audit.tags(audit.identity_rules(F.col("n"), F.col("b")))).collect()]
    assert got == [["name_self_dup"], ["brand_missing", "name_missing"], ["name_equals_brand", "name_has_year"]]


def test_merge(spark):
    m = spark.createDataFrame([({"a": "1", "b": None}, {"b": "2", "a": "3"}), (None, {"c": "4"})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in m.select(merge.merge_maps(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "b": "2"}, {"c": "4"}]
    assert m.select(merge.merge_maps(F.col("x"), F.col("y"), right_wins=True)).first()[0] == {"a": "3", "b": "2"}


def test_consensus(spark):
    rows = spark.createDataFrame([(1, 1999, "a"), (1, 1999, "b"), (2, 1999, "a"), (2, 2000, "a"), (3, 2001, "a")], "k long, y int, d string")
    assert {(r["k"], r["year"], r["confidence"]) for r in consensus.unique_year(rows, "k", "y", "d").collect()} == {(1, 1999, 98), (3, 2001, 95)}


def test_extract(spark):
    html = '<html lang="en"><title>A &amp; B</title><a href="/x">x</a><a href="/x">y</a><a>z</a><script>q</script>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r) for r in extract.links(pages).collect()] == [(1, 0, "/x")]
    got = {r["page_id"]: (r["title"], r["lang"], r["n_words"]) for r in extract.facts(pages).collect()}
    assert got == {1: ("A & B", "en", 3), 2: ("", None, 0), 3: ("", None, 0)}


def test_sources(spark, tmp_path):
    (tmp_path / "cache.json").write_text('{"a|b|": {"brand": "A", "name": "B", "updated_at": 3}, "bad": "x"}')
    assert [(r["key"], r["brand"]) for r in catalog.identity_cache(spark, str(tmp_path / "cache.json")).collect()] == [("a|b|", "A")]
    assert catalog.identity_cache(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "p.json").write_text('{"products": [{"handle": "h", "title": "T"}, 3]}')
    (tmp_path / "q.json").write_text('[{"handle": "i"}]')
    assert [r["handle"] for n in ("p", "q") for r in catalog.products(spark, str(tmp_path / f"{n}.json")).collect()] == ["h", "i"]
    (tmp_path / "list.txt").write_text("# no\n\n dior \n")
    assert [r[0] for r in catalog.query_list(spark, str(tmp_path / "list.txt")).collect()] == ["dior"]
    rows = spark.createDataFrame([("t", "1"), ("u", "2")], "tag string, row_id string")
    assert catalog.snapshot_id(rows).first() == catalog.snapshot_id(rows.orderBy(F.desc("tag"))).first()
    old = catalog.identity_cache(spark, str(tmp_path / "cache.json"))
    new = spark.createDataFrame([("a|b|1999", "A", "B", "1999", "u", "s", 9, 0.9), ("c|d|", "C", "D", "", "u", "s", 9, 0.1)], old.schema.add("score", "double"))
    assert {(r["key"], r["year"]) for r in catalog.upsert_identities(old, new).collect()} == {("a|b|", None), ("a|b|1999", "1999")}


def test_variants(spark):
    rows = spark.createDataFrame([("dior homme  intense",), ("",)], "q string")
    assert [r[0] for r in rows.select(search.query_variants(F.col("q"))).collect()] == [["dior homme intense", "dior homme", "homme intense", "dior intense", "homme", "intense"], [""]]


def _column(spark, values, schema, column):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_junk_accords(spark):
    values = [("14.9K", None), ("Summer", None), ("Online shops offers", None), ("Fragrance  Composition", None), ("BAL À VERSAILLES", "Bal a Versailles"), ("Amber", "amber"), ("Woody", "Amber"), (None, "x"), (" ", None)]
    got = _column(spark, values, "l string, n string", predicates.junk_accord(F.col("l"), F.col("n"), known=("amber",)))
    assert got == [True, True, True, True, True, False, False, True, True]


def test_identities(spark):
    real = _column(spark, [("2017",), ("342 votes",), ("212",), ("4711x",), ("x",), (None,), ("L'Air",)], "t string", predicates.looks_real(F.col("t")))
    assert real == [False, False, True, True, False, False, True]
    pairs = [("Creed", "Creed Suicide"), ("Aventus", "Creed"), ("and Gabbana", "Dolce"), ("Creed", "creed"), (None, "Creed"), ("x", None)]
    assert _column(spark, pairs, "n string, h string", predicates.house_echo(F.col("n"), F.col("h"))) == [True, False, False, True, False, False]
    assert _column(spark, pairs, "n string, h string", predicates.safe_identity(F.col("n"), F.col("h"))) == [False, True, False, False, False, False]
    stubs = [("Chanel", "chanel", None, [], ""), ("Chanel", "No 5", None, [], ""), ("Chanel", "Chanel", "EDP", [], ""), ("Chanel", "Chanel", "unknown", [" ", "Rose"], ""), ("Chanel", "Chanel", None, None, "u"), (None, None, None, None, None)]
    assert _column(spark, stubs, "b string, n string, c string, x array<string>, u string", predicates.junk_stub(*map(F.col, "bncxu"))) == [True, False, False, False, False, False]


def test_non_perfumes(spark):
    values = [("Mango Body Butter", "X", "", ""), ("Mango Body Butter", "X", "https://www.fragrantica.com/perfume/a/b", ""), ("Dummy", "X", "https://www.fragrantica.com/perfume/a/b", ""), ("Rose", "Pull & Bear", None, None), ("Rose", "The Body-Shop", "", "https://parfumo.net/Perfumes/x"), ("Bubble Bath", None, None, None)]
    got = _column(spark, values, "n string, h string, f string, p string", predicates.non_perfume(F.col("n"), F.col("h"), F.col("f"), F.col("p"), F.lit(None).cast("string"))["reason"])
    assert got == ["non-perfume product token: 'body butter'", "", "test/placeholder identity", "body-care brand, no real perfume page", "", ""]


def test_rows_cleaned(spark):
    accords = [(["warm  spicy", "Warm Spicy", "14.9K", None, "", "x" * 25, "amber"],), (None,)]
    assert _column(spark, accords, "a array<string>", predicates.accords_cleaned(F.col("a"))) == [["Warm Spicy", "Amber"], None]
    assert _column(spark, [("floral  CHYPERE",), ("",), (None,)], "f string", predicates.family_cleaned(F.col("f"))) == ["Floral Chypre", "", None]
    assert _column(spark, [(" 2019 ",), ("19x",), (None,)], "y string", predicates.year_cleaned(F.col("y"))) == [2019, None, None]


def test_query_gates(spark):
    asked = [("d g", ["D&G", "dolce gabbana"]), ("dolce light", ["dolce"]), ("", ["x"]), (None, None)]
    assert _column(spark, asked, "q string, f array<string>", predicates.brand_only(F.col("q"), F.col("f"))) == [True, False, False, False]
