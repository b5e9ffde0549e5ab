"""Ladders, keys of identities, acceptance, and batches that write several tables or none."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from kelpline.operators import keys, ladder
from kelpline.streaming import sink


def test_ladder(spark):
    jobs = spark.createDataFrame([(i, "k") for i in range(10)], "j long, tier string")
    seen = {}

    def tier(name, answers):
        def run(left):
            seen[name] = sorted(r["j"] for r in left.collect())
            return left.sparkSession.createDataFrame(answers, "j long, url string, o int")

        return run

    tiers = {"a": tier("a", [(1, "x", 2), (1, "y", 1), (2, None, 1), (77, "z", 1)]), "b": tier("b", []), "c": tier("c", [(i, f"c{i}", 0) for i in range(10)]), "d": tier("d", [(3, "never", 0)])}
    found, counts = ladder.ladder(jobs, "j", tiers, "url", "o")
    got = {r["j"]: (r["url"], r["tier"]) for r in found.collect()}
    assert got == {1: ("y", "a"), **{i: (f"c{i}", "c") for i in range(10) if i != 1}}
    assert seen == {"a": list(range(10)), "b": [i for i in range(10) if i != 1], "c": [i for i in range(10) if i != 1]} and counts == {"a": 1, "b": 0, "c": 9, "d": 0}
    rest, counts = ladder.ladder(jobs, "j", {"b": tier("b", [])}, "url")
    assert {r["tier"] for r in rest.collect()} == {None} and rest.count() == 10 and counts == {"b": 0}
    assert ladder.ladder(jobs.limit(0), "j", tiers, "url", "o")[0].collect() == []


def test_keys(spark):
    cases = [
        ("Lattafa Perfumes", "Ramz Lattafa (Gold)", ["lattafaperfumesramzlattafagold", "lattafaperfumesramzgold"]),
        ("Chanel", "N°22", ["chaneln22", "chanelno22"]), ("Chanel", "Les Exclusifs Number 5", ["chanellesexclusifsnumber5", "chanellesexclusifsno5"]),
        ("Carolina", "212", ["carolina212"]), (None, None, []), ("Dior", "Dior", ["diordior"]), ("", "No 5", ["no5"]),
    ]
    df = spark.createDataFrame([(i, b, n) for i, (b, n, _) in enumerate(cases)], "i int, b string, n string")
    got = {r["i"]: r["k"] for r in df.select("i", keys.identity_keys(F.col("b"), F.col("n")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]
    names = spark.createDataFrame([("Pour  Homme Dylan Blue",), ("Eros Pour Femme",), ("homme",), (None,), ("For her x",)], "n string")
    assert [tuple(r["g"]) if r["g"] else None for r in names.select(keys.leading_gender(F.col("n")).alias("g")).collect()] == [("dylan blue", "Men"), None, None, None, ("x", "Women")]


def test_inherited(spark):
    index = spark.createDataFrame([(1, "Versace", "Pour Homme Dylan Blue"), (2, "Chanel", "No 22"), (3, "Chanel", "no22"), (4, "A", "For Men X"), (5, "A", "For Women X"), (6, None, None)], "e long, b string, n string")
    rows = spark.createDataFrame([(10, "Versace", "Dylan Blue"), (11, "CHANEL", "N°22"), (12, "A", "X"), (13, "Chanel", "Chanel No.22"), (14, None, None)], "r long, b string, n string")
    got = {r["r"]: (r["e"], r["by"], r["gender"]) for r in keys.inherited(rows, index, "r", "e", "b", "n").collect()}
    assert got[10] == (1, -1, "Men") and got[11][0] == 2 and got[13][0] == 2 and set(got) == {10, 11, 13}


def test_recovered(spark):
    fg = "https://www.fragrantica.com/perfume/{}/{}-1.html"
    cases = [
        ("Gabrielle", "Chanel", fg.format("Chanel", "Gabrielle-Essence"), None, ("Gabrielle Essence", "Chanel")), ("", "Unknown", None, "https://basenotes.com/fragrances/noir-by-tom-ford.12", ("Noir", "Tom Ford")),
        ("Paris Corner Khair", "Other", fg.format("Paris-Corner", "Khair"), None, ("Khair", "Other")), ("Khair Pistachio", "Paris", fg.format("Paris-Corner", "Khair-Pistachio"), None, ("Khair Pistachio", "Paris Corner")),
        (None, None, None, None, ("", "")), ("Dior Sauvage", "Dior", None, None, ("Sauvage", "Dior")),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, name string, house string, u string, v string")
    got = keys.recovered(df, "name", "house", "u", "v")
    assert got.columns == df.columns
    assert {r["i"]: (r["name"], r["house"]) for r in got.collect()} == {i: c[4] for i, c in enumerate(cases)}


def test_accepted(spark):
    cases = [
        (("Dior", "Sauvage", ""), ("Dior", "Sauvage", "2015"), True), (("Dior", "Sauvage", ""), ("Dior", "Sauvage Elixir", "2021"), False), (("", "", ""), ("X", "Y", ""), True), ((None, None, None), (None, None, None), True),
        (("Dior", "Sauvage", "2010"), ("Dior", "Sauvage", "2015"), True), (("Dior", "Sauvage Rose", "2010"), ("Dior", "Sauvage", "2015"), False), (("Dior", "Sauvage Rose", "2015"), ("Dior", "Sauvage", "2015"), True), (("Ormonde", "The Lys", ""), ("Ormonde", "Lys", ""), True),
    ]
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string, c string, d string, e string, f string")
    got = {r["i"]: r["accepted"] for r in ladder.accepted(df, ("a", "b", "c"), ("d", "e", "f")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def _batch(spark, rows):
    day = lambda d: dt.datetime(2024, 1, d)
    return spark.createDataFrame([(j, day(d), u, n, "h", 2000, c, None) for j, d, u, n, c in rows], "job_id string, completed_at timestamp, canonical_fg_url string, name string, house string, year int, cards string, quality_status string")


def test_ledger(spark, tmp_path, monkeypatch):
    """A batch that fails between two tables changes nothing, run again it changes all, and once more nothing."""
    ledger = sink.Ledger(spark, str(tmp_path / "tables"))
    write = sink.completions(ledger)
    write(_batch(spark, [("a", 1, "u1", "old", "[1]"), ("b", 1, "u2", "x", "[1]"), ("c", 2, "u1", "new", "[2]"), ("d", 1, "", "bad", "[1]"), ("e", 1, "u9", "none", "")]), 0)
    names = lambda: {r["canonical_fg_url"]: r["name"] for r in ledger.latest("details", sink.DETAILS, "canonical_fg_url").collect()}
    assert names() == {"u1": "new", "u2": "x"}
    second = _batch(spark, [("f", 3, "u2", "y", "[3]"), ("g", 3, "u3", "z", "[3]")])
    writer = type(second.write)
    plain = writer.parquet

    def failing(self, path, *args, **more):
        if "/jobs/" in path:
            raise RuntimeError("lost")
        return plain(self, path, *args, **more)

    monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(RuntimeError):
        write(second, 1)
    monkeypatch.undo()
    assert os.path.isdir(tmp_path / "tables" / "details" / f"{1:012d}") and ledger.batches() == [0]
    assert names() == {"u1": "new", "u2": "x"}
    write(second, 1)
    after = names()
    assert after == {"u1": "new", "u2": "y", "u3": "z"}
    write(_batch(spark, [("z", 9, "u1", "again", "[9]")]), 1)
    assert names() == after and ledger.batches() == [0, 1]
    assert {r["job_id"] for r in ledger.latest("jobs", sink.JOBS, "job_id").collect()} == {"a", "b", "c", "f", "g"}
    assert ledger.rows("nothing", sink.JOBS).count() == 0


def test_completions_stream(spark, tmp_path):
    """The same from a stream, restarted with its checkpoint lost: batches that are published aren't written again."""
    source = str(tmp_path / "in")
    ledger = sink.Ledger(spark, str(tmp_path / "tables"))
    schema = "job_id string, completed_at timestamp, canonical_fg_url string, name string, house string, year int, cards string, quality_status string"
    for k in range(2):
        _batch(spark, [(f"j{k}", 1 + k, f"u{k}", f"n{k}", "[1]")]).coalesce(1).write.mode("append").parquet(source)
        for check in ("c", f"other{k}"):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            stream.writeStream.foreachBatch(sink.completions(ledger)).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
    rows = ledger.rows("jobs", sink.JOBS).collect()
    assert sorted(r["job_id"] for r in rows) == ["j0", "j1"] and ledger.batches() == [0, 1]
