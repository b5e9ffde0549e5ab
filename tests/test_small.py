"""Small operators with known answers."""

import pytest
from pyspark.sql import functions as F

from kelpline.functions import steps
from kelpline.operators import bundle, cascade, consensus, facts, gates, identity, notes, payloads, predicates, ranking, records
from kelpline.sources import catalog


def _column(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("x")).orderBy("i").collect()]


def test_marks(spark):
    assert _column(spark, [("x",), (None,)], "s string", cascade.marks_unknown(F.col("s"))) == [False, False]
    assert _column(spark, [(cascade.UNKNOWN_YEAR_SOURCE,)], "s string", cascade.marks_unknown(F.col("s"))) == [True]
    assert _column(spark, [(["a", "b", "c"], ["b"])], "a array<string>, b array<string>", facts.actionable(F.col("a"), F.col("b"))) == [["a", "c"]]
    assert _column(spark, [(True, True), (True, None), (False, True)], "a boolean, b boolean", predicates.all_covered(F.col("a"), F.col("b"))) == [True, False, False]
    assert _column(spark, [(0.96, "dior sauvage", "Sauvage"), (0.96, "dior", "Sauvage"), (None, "sauvage", "Sauvage"), (0.9, "sauvage", "Sauvage")], "s double, q string, n string", predicates.strong_candidate(F.col("s"), F.col("q"), F.col("n"), 0.95)) == [True, False, False, False]
    assert _column(spark, [("", None), ("x", None), (None, ["a"]), (None, None)], "a string, b array<string>", records.has_detail(F.col("a"), F.col("b"))) == [False, True, True, False]
    cases = [(False, 0.9, "dior sauvage", "sauvage", "sauvage", "dior"), (False, 0.7, "dior sauvage", "sauvage", "sauvage", "dior"), (True, 0.0, "a", "a", "b", "c"), (False, 0.9, "sauvage", "sauvage", "sauvage", "dior")]
    assert _column(spark, cases, "r boolean, s double, q string, v string, n string, b string", identity.variant_ok(*[F.col(c) for c in "rsqvnb"])) == [True, False, True, False]


def test_concentrations(spark):
    labels = [(k,) for k in cascade.DISPLAYED] + [("odd",), (None,)]
    shown = _column(spark, labels, "l string", cascade.displayed_concentration(F.col("l")))
    assert shown[:-2] == list(cascade.DISPLAYED.values()) and shown[-2:] == ["odd", None]
    stored = _column(spark, [(k,) for k in cascade.STORED] + [("odd",), (None,)], "l string", cascade.stored_concentration(F.col("l")))
    assert stored == [*cascade.STORED.values(), "Unknown", "Unknown"]


def test_layers_and_rows(spark):
    made = _column(spark, [([("Lime", "Top"), ("Oud ", "base"), ("", "Top"), ("Rose", None), ("Lime", "top")],), (None,)], "n array<struct<name:string,pyramidLevel:string>>", notes.from_product(F.col("n")))
    assert (made[0]["top"], made[0]["base"], made[0]["flat"]) == (["Lime"], ["Oud"], ["Rose"])
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, p int, v string")
    assert {(r["k"], r["v"]) for r in ranking.first_per_key(rows, ["k"], "p").collect()} == {("a", "y"), ("b", "z")}
    row = spark.createDataFrame([(["t: x", "u"], ["Woody", " ", None], "n")], "i array<string>, a array<string>, n string").select(*records.export_row(F.col("i"), {"name": F.col("n")}, F.col("a"))).first()
    assert tuple(row) == ("n", 1, "Woody", 2, "t: x; u")
    with pytest.raises(ValueError):
        steps.unused(rows, "V")


def test_handles_and_times(spark):
    rows = spark.createDataFrame([("a", f"h{i % 7}") for i in range(30)] + [("b", None), (None, "x")], "b string, h string")
    got = {r["b"]: (r["n"], r["handles"]) for r in records.brand_sizes(rows, "b", "h", 3).collect()}
    assert got == {"a": (30, ["h0", "h1", "h2"]), "b": (1, []), None: (1, ["x"])}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        now = F.lit("2024-01-08T12:00:00Z").cast("timestamp")
        cases = [("2024-01-01T11:00:00", ""), ("2024-01-01T13:00:00", ""), ("2024-01-01T13:00:00+09:00", ""), ("2024-01-01T11:00:00Z", ""), ("", "2024-01-01"), ("soon", ""), (None, None)]
        assert _column(spark, cases, "c string, u string", records.stale(F.col("c"), F.col("u"), now)) == [True, False, True, True, True, False, False]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_record_keys(spark):
    known = spark.createDataFrame([("r1", "f1", "b1"), ("r2", "f1", "b2"), ("r3", None, "b1"), ("r4", "f2", None)], "record_key string, fg_url string, bn_url string")
    asked = spark.createDataFrame([(1, "f1", "b1", "r4"), (2, None, "b1", "r3"), (3, "zz", None, "new"), (4, None, None, "r2"), (5, "f2", "b2", "r4")], "i int, fg_url string, bn_url string, fallback string")
    assert {(r["i"], r["record_key"], r["merged"]) for r in records.record_keys(asked, known, "i").collect()} == {(1, "r1", 3), (2, "r1", 1), (3, "new", 0), (4, "r2", 0), (5, "r4", 1)}


def test_payload_rows():
    row = {"url": "u", "title": "t"}
    nest = {"results": {"data": '{"organic": [{"link": "a"}, 3], "content": [{"url": "b"}, {"url": "c", "results": []}]}'}, "content": [[row], {"items": [row]}]}
    assert list(payloads.entries(nest)) == [row, row, {"link": "a"}, {"url": "b"}]
    deep = {"organic": [row]}
    for _ in range(payloads.DEPTH):
        deep = {"data": deep}
    assert list(payloads.entries(deep)) == [row] and list(payloads.entries({"data": deep})) == []
    assert list(payloads.entries("{broken")) == list(payloads.entries(None)) == []


def test_release_years(spark):
    cases = [
        ("Dior", "Sauvage", "", "Sauvage was released in 2015. Dior news", ["d"]), ("Dior", "Sauvage", "by Dior", "Sauvage was released in 2015.", [2015]), ("Dior", "Sauvage", "Dior", "Sauvage Elixir was released in 2021.", []), ("Amouage", "Gold", "Amouage", "Amouage Reflection Gold was released in 2007", []),
        ("Amouage", "Gold", "", "Amouage Gold, first launched in 1983; created in 1999. Updated: Amouage Gold was released in 1990", [1983]), ("House 1888", "Blue", "", "House 1888 Blue launched in 1888", []), ("", "Blue", "", "Blue debuted on 2001! Blue introduced in 2099.", [2001]), (None, None, None, None, []),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, b string, n string, t string, s string")
    got = {}
    for r in consensus.release_years(df, "i", "b", "n", "t", "s", F.lit("x.org"), 2024).collect():
        got.setdefault(r["i"], []).append(r["year"])
    assert [got.get(i, []) for i in range(1, len(cases))] == [c[4] for c in cases[1:]] and got.get(0) is None


def test_sanitized(spark):
    scent = "struct<scent_vector:array<struct<accord:string,score:double>>,top_accords:array<string>,summary:string>"
    rows = [(1, ([("14.9K", 99.0), ("amber", 50.0), ("Woody", 80.0), ("My Name", 70.0)], ["14.9K"], "old"), "My Name", "B"), (2, None, "x", "y"), (3, ([("woody", 80.0)], ["woody"], "A predominantly woody fragrance."), "x", "y"), (4, ([("love", 1.0)], [], None), "x", "y")]
    got = {r["i"]: r for r in bundle.sanitized(spark.createDataFrame(rows, f"i int, m {scent}, n string, b string"), "m", "n", "b").collect()}
    assert got[1]["m"]["top_accords"] == ["Woody", "amber"] and got[1]["m"]["summary"] == "A woody fragrance with amber facets." and got[1]["changed"]
    assert got[2]["m"] is None and not got[2]["changed"] and not got[3]["changed"] and got[4]["m"]["top_accords"] == [] and got[4]["changed"]


def test_gates(spark):
    cases = [("Sauvage", "Dior", "https://www.fragrantica.com/perfume/Dior/Sauvage-1.html"), ("Other", "Dior", "https://www.fragrantica.com/perfume/Dior/Sauvage-1.html"), ("Sauvage", "Dior", None), ("Dior", "Dior", None), ("", "Dior", None)]
    assert _column(spark, cases, "n string, h string, u string", gates.storable(F.col("n"), F.col("h"), F.col("u"))) == [True, False, True, False, False]
    row = gates.shown(spark.createDataFrame([("a", 2001, None)], "n string, y int, g string"), {"name": F.col("n"), "year": F.col("y"), "gender": F.col("g")}).first()
    assert tuple(row) == ("", "a", "", "2001", "", "", "", "", "", "", "") and row.__fields__ == list(gates.SHOWN)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("é", 'say "x", y', None), ("b", "c", 1)], "name string, note string, n int").coalesce(1)
    catalog.write_csv(rows, str(tmp_path / "csv"), ["note", "name"])
    part = next((tmp_path / "csv").glob("part-*.csv"))
    import csv

    with part.open(encoding="utf-8-sig", newline="") as f:
        assert list(csv.DictReader(f)) == [{"note": 'say "x", y', "name": "é"}, {"note": "c", "name": "b"}]
    assert part.read_bytes().startswith(b"\xef\xbb\xbfnote,name")
    (tmp_path / "p.json").write_text('{"products": [{"handle": "a", "title": "T-1", "vendor": "V"}, 3, {"handle": "b", "title": "t 1", "vendor": "v"}, {"title": "only"}]}')
    index = {r["key"]: r["handle"] for r in catalog.catalog_index(catalog.products(spark, str(tmp_path / "p.json"))).collect()}
    assert index == {"h:a": "a", "h:b": "b", "i:v|t 1": "a"}
    (tmp_path / "page.html").write_text("<p>x</p>")
    assert [r["html"] for r in catalog.saved_pages(spark, str(tmp_path / "page.html")).collect()] == ["<p>x</p>"]
    found = spark.createDataFrame([("k2", "b"), ("k1", "a")], "key string, brand string")
    catalog.write_identity_cache(found, str(tmp_path / "cache"))
    assert [r["key"] for r in spark.read.json(str(tmp_path / "cache")).collect()] == ["k1", "k2"]


def test_scalars_and_urls(spark):
    from kelpline.functions import text as X

    rows = [(None, None, None, None), ("", "x", "ftp://y", "{broken"), ("Unknown", "unisex / unspecified", "http://a/b", '{"raw_identity": {"year": 2001, "gender": "Men", "concentration": "unknown"}, "concentration": " EDP "}')]
    made = _column(spark, rows, "y string, g string, u string, b string", facts.record_scalars({"year": F.col("y"), "gender": F.col("g"), "image_url": F.col("u"), "fg_raw": F.col("b")}))
    assert [tuple(m) for m in made] == [(None,) * 4, (None, None, "x", None), ("EDP", "2001", "Men", "http://a/b")]
    urls = [("HTTP://A.org/B/?Q=1//", "http://a.org/B/?Q=1"), ("HTTPS://A.ORG", "https://a.org"), (" a/B/ ", "a/B"), ("", None), (None, None), ("/", None)]
    assert _column(spark, [(u,) for u, _ in urls], "u string", X.stored_url(F.col("u"))) == [w for _, w in urls]


def test_note_tokens(spark):
    rows = [(1, 0, 0, "Pepperwood™ or Hercules Club"), (1, 0, 1, "pepperwood"), (1, 1, 0, "Agarwood (Oud)"), (1, 1, 1, "Oud"), (1, 2, 0, "Oud"), (1, 2, 1, None), (1, 2, 2, " . "), (2, 0, 0, "Vetiver (Bourbon)")]
    df = spark.createDataFrame(rows, "k int, layer int, pos int, note string")
    got = sorted(map(tuple, notes.tokens_cleaned(df, "k", "layer", "pos", "note", {"agarwood": "oud"}).collect()))
    assert got == [(1, 0, 1, "Pepperwood"), (1, 0, 2, "Hercules Club"), (1, 1, 1, "Oud"), (1, 2, 1, "Oud"), (2, 0, 1, "Vetiver (Bourbon)")]
    assert notes.tokens_cleaned(df.limit(0), "k", "layer", "pos", "note", {}).collect() == []


def test_queue_diagnostics(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "failed", 3, "boom, \"x\""), ("b", "pending", 0, None), ("c", "processing", 2, None), ("d", "ignored", None, ""), ("e", "completed", 4, "x")], "id string, status string, failure_count int, last_error string")
    rows = records.queue_diagnostics(jobs)
    assert rows.columns == list(records.DIAGNOSED)
    assert {(r["group"], r["id"], r["error_bucket"]) for r in rows.collect()} == {("failed", "a", 'boom, "x"'), ("retry_history", "c", "none"), ("ignored", "d", "none")}
    as_json, as_csv = catalog.write_diagnostics(rows, str(tmp_path), "20240101T000000Z")
    assert as_json.endswith("enrichment_queue_20240101T000000Z.json")
    back = [{r["id"]: r["last_error"] or "" for r in read.collect()} for read in (spark.read.json(as_json), spark.read.option("header", True).option("escape", '"').csv(as_csv))]
    assert back[0] == back[1] == {"a": 'boom, "x"', "c": "", "d": ""}
