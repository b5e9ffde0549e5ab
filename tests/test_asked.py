"""What queries ask, and which facts records lack: known answers."""

from pyspark.sql import functions as F

from kelpline.operators import asked, facts


def _by(spark, function, cases, out):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string")
    got = {r["i"]: r[out] for r in function(df, "q").collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_questions(spark):
    _by(spark, asked.with_question_cut, [("Does Dior Sauvage smell good?", "Dior Sauvage"), ("dior sauvage", ""), ("is sauvage lasting", ""), ("What is Creed Aventus worth", "is Creed Aventus"), ("How creed aventus", "creed aventus"), (None, ""), ("", "")], "about")


def test_search_text(spark):
    cases = [("Classique Eau De Toilette Jean Paul Gaultier Classique", "Classique Jean Paul Gaultier"), ("initio  parfums side effect EDP", "Initio Parfums Privés side effect"), ("Initio Parfums Privés x", "Initio Parfums Privés x"), ("Eau de Cologne", "Eau de Cologne"), ("ds durga bowmakers", "D.S. & Durga bowmakers"), (" ", ""), (None, "")]
    _by(spark, asked.with_search_text, cases, "search_text")
    names = spark.createDataFrame([("Parfum Dhabit",), ("Terre Dhermes",), ("Sauvage",), (None,), ("Deo",)], "n string")
    assert [r["a"] for r in names.select(asked.apostrophes(F.col("n")).alias("a")).collect()] == ["Parfum d'Habit", "Terre d'Hermes", "", "", ""]


def test_fact_questions(spark):
    cases = [("what's the release year of Dior Sauvage?", ("year", "release year", "Dior Sauvage")), ("Sauvage gender", ("gender", "gender", "Sauvage")), ("Year of the Dragon", (None, None, None)), ("show me the fragrance family for  the Aventus.", ("family", "fragrance family", "Aventus")), ("year", (None, None, None)), (None, (None, None, None))]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string")
    got = {r["i"]: (r["field"], r["label"], r["target"]) for r in asked.with_fact_question(df, "q").collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_suggestions_cut(spark):
    df = spark.createDataFrame([("<b>Dior</b> Sauvage 100 ml spray",), ("Did you mean: creed aventus reviews",), ("Sauvage perfume - ",), ("frederic malle ranked",)], "t string")
    assert [r["c"] for r in df.select(asked.clean_suggestion(F.col("t")).alias("c")).collect()] == ["Dior Sauvage", "creed aventus", "Sauvage", "frederic malle"]


FIELDS = {k: k for k in ("name", "house", "year", "gender", "fg_raw", "bn_raw", "derived_metrics")}


def test_fact_status(spark):
    full = ("A", "B", "2001", "Women", '{"raw_identity": {"concentration": "EDP"}, "notes": {"base": ["oud"]}, "reviews": [{"text": "x"}]}', "{}", '{"main_accords": {"scent_vector": [{"accord": "odd", "score": 1}, {"accord": "Citrus", "score": 2}]}, "wear_profile": {"primary_time": "Day"}, "source_coverage": {"performance_score": true, "value_score": true, "community_interest_score": true}}')
    broken = ("unknown", None, "None", "Unisex / Unspecified", "{", "[]", None)
    rows = spark.createDataFrame([full, broken, (None,) * 7], ", ".join(f"{k} string" for k in FIELDS))
    got = facts.with_fact_status(rows, FIELDS).select("facts", "absent").collect()
    assert got[0]["absent"] == [] and all(got[0]["facts"])
    assert got[1]["absent"] == list(facts.FACTS) == got[2]["absent"]
    one = spark.createDataFrame([(["x", "Woody", "rose", "floral", None],)], "a array<string>").select(facts.families_of(F.col("a")).alias("f")).first()["f"]
    assert (one["primary_family"], one["families"], one["confidence"]) == ("Woody", ["Woody", "Floral"], 85)
    assert [r["c"] for r in spark.createDataFrame([(["", "Unknown"],), (["n/a", "Fall"],), (None,)], "v array<string>").select(facts.any_complete(F.col("v")).alias("c")).collect()] == [False, True, False]
