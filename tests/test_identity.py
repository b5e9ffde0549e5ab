"""Identities, metrics, notes and facts on small rows with known answers."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from kelpline.functions import text as X
from kelpline.operators import audit, bundle, cascade, identity, notes, payloads, predicates, records, resolve, search


def _one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_clean_and_slugs(spark):
    texts = ["Ylang?lang &amp; Rose", "Ambrox®️Super�", "  a​b  c ", None, "Lavender (???)"]
    assert _one(spark, [(t,) for t in texts], "t string", X.clean("t")) == ["ylang-ylang & Rose", "Ambrox®Super", "ab c", "", "Lavender ("]
    assert _one(spark, [("eau-d-hermes",), ("lhomme_ideal",), ("l-air-du-desert",), ("caf%C3%A9-noir",), (None,)], "s string", X.title_from_slug(F.col("s"))) == ["Eau d'Hermes", "L'Homme Ideal", "L'Air Du Desert", "Café Noir", ""]
    assert _one(spark, [("Casamorati 1888 Mefisto 2009", "Casamorati 1888", "Mefisto"), ("no year", "a", "b"), (None, None, None)], "t string, b string, n string", X.launch_year(F.col("t"), F.col("b"), F.col("n"))) == ["2009", "", ""]
    assert _one(spark, [("(342)",), ("1,234 votes",), ("4.1k",), ("..",)], "t string", X.vote_count(F.col("t"))) == [342, 1234, 4100, 0]


def test_search_takes_any_text(spark):
    rows = spark.createDataFrame([("100% Oud", "A\\B"), ("Q", "Acqua"), ("a\\Eb", "House")], "name string, brand string")
    hit = lambda q: [r[0] for r in rows.where(search.matches(F.concat_ws(" ", "brand", "name"), F.lit(q))).collect()]
    assert hit("q") == ["Q"] and hit("100%") == ["100% Oud"] and hit("\\E") == [] and hit("a\\\\eb") == ["a\\Eb"] and hit("a\\\\b") == ["100% Oud"] and hit("") == [] and hit("oud\\") == []
    tiers = [r[0] for r in rows.select(search.tier(F.lit("house"), F.col("name"), F.col("brand"), ("acqua", "ac"))).collect()]
    assert tiers == [None, 0, 1]


def _relevance(spark, rows):
    found = identity.with_relevance(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, b string, n string"), "q", "n", "b")
    return {r["i"]: (r["score"], r["relevant"]) for r in found.collect()}


def test_relevance(spark):
    rows = [
        ("dior", "Dior", "J'adore Eau de Toilette 2002"),
        ("MFK", "Maison Francis Kurkdjian", "Baccarat Rouge 540"),
        ("layton de", "Caron", "Nuit De Noel"),
        ("Creed Bayrhum Vetiver", "Creed", "Wild Vetiver"),
        ("Bleu de Chanel", "Chanel", "Bleu de Chanel"),
        ("", "Chanel", "No 5"),
        (None, None, None),
        ("creed aventus", "Creed", "Aventus"),
        ("aventis", "Creed", "Aventus"),
    ]
    got = _relevance(spark, rows)
    assert got[0] == (1.0, True) and got[1] == (1.0, True)
    assert got[2][0] <= 0.5 and not got[2][1] and not got[3][1] and got[4] == (1.0, True)
    assert got[5] == (0.0, False) and got[6] == (0.0, False) and got[7] == (1.0, True)
    assert abs(got[8][0] - SequenceMatcher(None, "aventis", "aventus").ratio()) < 1e-9 and got[8][1]


def test_identity_scores(spark):
    pairs = [
        ("Dior", "Sauvage", "2015", "Christian Dior", "Sauvage", "2015", 1.0),
        ("Dior", "Sauvage", "2015", "Dior", "Sauvage", "2016", 0.81),
        ("Dior", "Sauvage", "2015", "Dior", "Sauvage", "2019", 0.0),
        ("Dior", "Sauvage", "", "Prada", "Sauvage", "", 0.0),
        ("Dior", "Sauvage", "", "Dior", "Sauvage Elixir", "", 0.68),
        ("Dior", "Dior Homme", "", "Dior", "Dior Femme", "", 0.0),
        ("Chanel", "No 5", "", "Chanel", "N°5 Eau de Parfum", "", 0.96),
        ("Xerjoff", "Casamorati Mefisto", "", "Casamorati 1888", "Mefisto", "", 0.96),
        ("unknown", "Mont Blanc Legend", "", "Montblanc", "Legend Spirit", "", 0.0),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, c string, d string, e string, f string, want double")
    got = {r["i"]: r["score"] for r in identity.with_identity_score(df, ("a", "b", "c"), ("d", "e", "f")).collect()}
    for i, p in enumerate(pairs[:-1]):
        assert abs(got[i] - p[-1]) < 1e-9, (p, got[i])
    assert 0 <= got[8] <= 1


def test_queries_and_names(spark):
    asked = ["layton de", "jgp le beau", "Le Male Elixir", "ysl perfume", "monet blanco", "Tom Ford Oud Wood", ""]
    rows = identity.prepared(spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string"), {"__q": F.col("q")})
    got = [r[0] for r in rows.select("i", identity.expanded_query(F.col("q"), F.col("__q"), F.col("__q_n")).alias("x")).orderBy("i").select("x").collect()]
    assert got == ["Parfums de Marly Layton", "jean paul gaultier le beau", "Jean Paul Gaultier Le Male Elixir", "ysl perfume", "Montblanc", "Tom Ford Oud Wood", ""]
    names = [("Hermès Rocabar", "Hermes", "Rocabar"), ("Rocabar by Hermès", "Hermes", "Rocabar"), ("Hermès", "Hermes", "Hermès"), ("Van Cleef & Arpels First", "Van Cleef and Arpels", "First"), ("Creed de Nuit", "Creed", "Creed de Nuit"), ("Aventus", "Creed", "Aventus")]
    made = identity.with_stripped_name(spark.createDataFrame([n[:2] for n in names], "n string, h string"), "n", "h", "x")
    assert {(r["n"], r["x"]) for r in made.collect()} == {(n, x) for n, _, x in names}
    subset = [(("b", "lys", ""), ("b", "the lys", ""), True), (("b", "1872 twist vetiver", "2016"), ("b", "1872 vetiver", "2016"), True), (("b", "sauvage", ""), ("b", "sauvage elixir", ""), False), (("b", "a x", "1"), ("b", "c", "1"), False)]
    cols = [F.col(c) for c in "abcdef"]
    assert _one(spark, [(*a, *b) for a, b, _ in subset], ", ".join(f"{c} string" for c in "abcdef"), identity.subset_identity(tuple(cols[:3]), tuple(cols[3:]))) == [w for *_, w in subset]


def test_accords_and_families(spark):
    accords = [(["white-floral", "WHITE-FLORAL", "fougère", None, "12%", "amber"],), (None,)]
    assert _one(spark, accords, "a array<string>", predicates.accords_cleaned(F.col("a"))) == [["White-Floral", "Fougère", "Amber"], None]
    assert _one(spark, [("unknown family",), ("floral chypere",), ("N/A",)], "f string", predicates.family_cleaned(F.col("f"))) == ["unknown family", "Floral Chypre", "N/A"]


def test_bundle(spark):
    cards = [
        ("Fragrantica Rating", [("", "4.2/5", None, "1,000")]),
        ("Longevity", [("Weak", None, 1.0, "10"), ("eternal", None, 1.0, "1.2k"), ("odd", None, 1.0, "9k")]),
        ("Price Value", [("Good Value", None, 1.0, "3")]),
        ("When to wear", [("fall", None, 1.0, "10"), ("winter", None, 1.0, "10"), ("day", None, 1.0, "1")]),
        ("Community Interest", [("have", "", 1.0, "30"), ("had", None, 1.0, "10"), ("want", None, 1.0, "10")]),
        ("Main accords", [("woody", None, 90.0, None), ("Bal A Versailles", None, 95.0, None), ("14.9K", None, 99.0, None), ("amber", None, 80.0, None), ("rose", None, 70.0, None)]),
    ]
    rows = spark.createDataFrame([(1, cards, None, (["a"], [], [], []), "Bal à Versailles", "Desprez"), (2, None, (5, 2, 3), None, None, None)], f"i int, cards {bundle.CARDS}, c struct<pos:bigint,neu:bigint,neg:bigint>, n struct<top:array<string>,heart:array<string>,base:array<string>,flat:array<string>>, name string, brand string")
    got = {r["i"]: r["metrics"] for r in bundle.with_bundle(rows, "cards", "c", "n", "name", "brand").collect()}
    one, two = got[1], got[2]
    assert abs(one["rating"]["score"] - 84) < 1e-9 and one["rating"]["basis"] == "rating_summary" and one["rating"]["votes"] == 1000
    assert abs(one["performance"]["score"] - (40 * 10 + 100 * 1200) / 1210) < 1e-9 and one["performance"]["longevity_label"] == "odd"
    assert one["wear_profile"]["primary_seasons"] == ["Autumn/Fall", "Winter"] and one["wear_profile"]["primary_time"] == "Day"
    assert abs(one["interest"]["want_ratio"] - 0.25) < 1e-9 and abs(one["interest"]["retention_ratio"] - 0.75) < 1e-9
    assert one["main_accords"]["top_accords"] == ["woody", "amber", "rose"] and one["main_accords"]["summary"] == "A woody fragrance with amber and rose facets."
    assert one["coverage"]["notes"] and not one["coverage"]["sentiment"] and one["headline"]["n_components"] == 4
    assert two["sentiment"]["score"] == 60 and two["headline"]["score"] == 60 and two["headline"]["label"] == "Generally Liked" and two["rating"] is None


def test_notes(spark):
    layers = [["Agarwood (Oud)", "Ambergris", "Pepperwood or Hercules Club", "Vetiver (Bourbon/Java)"], ["Cedarwood", "Cedar", "Roses", "Oud"], ["Rose", "Madagascar Vanilla", "Vanilla Absolute", "a or b", "Iris."]]
    rows = spark.createDataFrame([(1, k, i, n) for k, layer in enumerate(layers) for i, n in enumerate(layer)], "k int, layer int, pos int, note string")
    got = notes.deduped(rows, "k", "layer", "pos", "note", {"cedarwood": "cedar", "agarwood": "oud"}, ("madagascar", "absolute", "accord")).collect()
    shown = {}
    for r in sorted(got, key=lambda r: (r["layer"], r["place"])):
        shown.setdefault(r["layer"], []).append(r["note"])
    assert shown == {0: ["Oud", "Ambergris", "Pepperwood", "Hercules Club", "Vetiver (Bourbon/Java)"], 1: ["Cedar", "Rose"], 2: ["Vanilla Absolute", "a or b", "Iris"]}


def test_gates_and_payloads(spark):
    nested = '{"results": [{"url": "https://q", "content": {"results": {"organic": [{"link": "https://a.org/1"}, {"x": 1}]}}}, {"title": "t"}], "data": "[{\\"href\\": \\"u\\"}]"}'
    got = payloads.result_rows(spark.createDataFrame([(2**53 + 1, nested), (None, "{broken"), (3, None)], "k long, p string"), "k", "p").collect()
    assert {r["k"] for r in got} == {2**53 + 1} and [r["pos"] for r in sorted(got, key=lambda r: r["pos"])] == list(range(len(got))) and len(got) == 2
    assert _one(spark, [("<p>A &amp; [b](http://x)</p>",), (None,)], "t string", payloads.clean_description(F.col("t"))) == ["A & b", ""]
    assert _one(spark, [("Bath & Body Works", "x"), ("Victoria's Secret", "Pink Fresh"), ("Dior", "Pink")], "h string, n string", records.without_source(F.col("h"), F.col("n"))) == [True, True, False]
    assert _one(spark, [("Eau Fraîche", 5)], "c string, v int", cascade.performance_delta(F.col("v"), F.lit("x"), F.col("c"), {"Eau Fraîche": -1})) == [4]


def test_house_repairs_skip_collisions(spark):
    rows = spark.createDataFrame([(1, "Creed Aventus", "Creed", "Creed Creed Aventus"), (2, "Dior Sauvage", "Dior", "x"), (3, "Sauvage", "Dior", None), (4, "Love", "Kilian", None)], "k int, n string, h string, q string")
    got = {r["k"]: (r["new_name"], r["new_query"], r["skipped"]) for r in records.house_repairs(rows, "k", "n", "h", "q").collect()}
    assert got == {1: ("Aventus", "Creed Aventus", False), 2: ("Sauvage", "x", True)}


def test_review_copies(spark):
    long = "a very good scent that lasts all day "
    rows = spark.createDataFrame([(1, "en", long + "Reply"), (2, "en", long.upper() + "  like"), (3, "en", "short"), (4, "en", long + "but"), (5, "de", long)], "i int, lang string, t string")
    assert {(r["lang"], r["i"], r["copies"]) for r in audit.review_copies(rows, ["lang"], "t", "i").collect()} == {("en", 1, 2), ("en", 4, 1), ("de", 5, 1)}
