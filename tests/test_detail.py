"""Facts of detail pages: small pages with known answers, broken ones, and canonical labels against a plain loop."""

import random

from pyspark.sql import functions as F

from kelpline.functions import markup
from kelpline.operators import detail, labels

THIRD = """<html lang=en><head><meta property="og:url" content="http://parfumo.com/Perfumes/Dior/Sauvage?x=1"><meta property="og:title" content="Sauvage by Dior">
<meta property="og:description" content="Sauvage is a perfume by Dior for men and was released in 2015. The scent is fresh-spicy. It is still in production.">
<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"name":"P"},{"name":"B"},{"name":"Dior"},{"name":"Sauvage EDT"}]}</script><script>var x = {</script></head>
<body><span itemprop="ratingValue">7.9</span><meta itemprop="ratingCount" content="4321"><div class="notes_list"><b>Top Notes</b><span class="clickable_note_img">Bergamot</span><span class="clickable_note_img"> Pepper </span>
<b>Base Notes</b><span class="clickable_note_img">Ambroxan</span></div><a href="/Perfumers/X">X Y</a><a href="/Perfumers/Z">Z<a href="/Perfumers/X">X Y</a>"""
SECOND = """<div class="x FragHead-Inner"><h1>N <span class="h1_gender"><i style="color: Dodger Blue"></i><i style="color:hotpink"></i></span></h1></div><div itemprop="description">One<br>two</div>
<div id="fragrev"><a>12 Positive (60%)</a><a>5 Neutral (25%)</a><a>3 negative (15%)</a><a>13 Positive (61%)</a></div>
<ul class="fragrancenotes"><li><h3>Head</h3><ul><li>Lime</li><li>Mint</li></ul></li><li><h3>Base</h3><ul><li>Oud, Musk</li></ul></li></ul>"""


def _rows(spark, pages):
    return spark.createDataFrame([(i, p, "k") for i, p in enumerate(pages)], "i long, html string, url string")


def test_third_source(spark):
    flat = THIRD.replace("Top Notes", "x").replace("Base Notes", "y").replace("for men", "for women and men").replace("released in 2015", "of 2016")
    got = {r["i"]: r for r in detail.third_source(_rows(spark, [THIRD, flat, THIRD.replace("/Perfumes/", "/Users/"), None, "", "<meta property='og:url'"]), "i", "html").collect()}
    assert set(got) == {0, 1}
    a, b = got[0], got[1]
    assert tuple(a[c] for c in ("url", "house", "name", "gender", "status", "year", "accord", "rating", "rating_count")) == ("https://www.parfumo.com/Perfumes/Dior/Sauvage", "Dior", "Sauvage EDT", "Masculine", "in_production", "2015", "fresh-spicy", "7.9", "4321")
    assert (a["top"], a["heart"], a["base"], a["flat"], a["perfumers"]) == (["Bergamot", "Pepper"], [], ["Ambroxan"], [], ["X Y", "ZX Y"])
    assert (b["top"], b["flat"], b["gender"], b["year"]) == ([], ["Bergamot", "Pepper", "Ambroxan"], "Unisex", "2016")


def test_second_source(spark):
    pages = [SECOND, "<ul class='fragrancenotes'>Top notes: Lime, Mint Base notes: Oud</ul>", "<div class='fragrancenotes'>Rose; Iris</div>", "<div><h3>Fragrance Notes</h3><p>Rose</p><p>Musk<b>!</b></p><p>Latest reviews</p><p>No</p></div>", None, "<p>none"]
    got = {r["i"]: r for r in detail.second_source(_rows(spark, pages), "i", "html").collect()}
    a = got[0]
    assert a["gender"] == "Unisex" and a["description"] == "One\ntwo" and tuple(a["votes"]["pos"]) == (13, 61) and tuple(a["votes"]["neg"]) == (3, 15) and tuple(a["votes"]["neu"]) == (5, 25)
    layers = [tuple(got[i][k] for k in detail.LAYERS) for i in range(6)]
    assert layers == [(["Lime", "Mint"], [], ["Oud", "Musk"], []), (["Lime", "Mint"], [], ["Oud"], []), ([], [], [], ["Rose", "Iris"]), ([], [], [], ["Rose", "Musk"]), ([], [], [], []), ([], [], [], [])]
    assert got[5]["gender"] == "" and got[5]["votes"]["pos"] is None


def test_metric_cards(spark):
    page = """<div id="performance"><h3>Longevity</h3><div><span>very weak</span><div style="width: 12.5%"></div><i>1,200</i></div><div><b>long-lasting</b> <meter value=3 max=4></meter></div>
    <h3>Price/Value</h3><div><span>Ok</span><div aria-valuenow="30" aria-valuemax="60"></div><em>3k votes</em></div></div><div style="width:90%">out</div>
    <script>window.__data = {"a": {"b": {"longevity": {"eternal": 5, "Weak": 20}, "season": [{"label": "autumn", "pct": "40%", "votes": 7}, {"label": "x", "pct": 900}]}}};</script>"""
    got = sorted((r["i"], r["card"], r["label"], r["pct"], r["count"], r["source"]) for r in detail.metric_cards(_rows(spark, [page, None, "<p>"]), "i", "html").collect())
    assert got == [
        (0, "longevity", "Eternal", 5.0, "", "data"), (0, "longevity", "Long Lasting", 75.0, "", "bars"), (0, "longevity", "Very Weak", 12.5, "1,200", "bars"), (0, "longevity", "Weak", 20.0, "", "data"),
        (0, "price value", "Ok", 50.0, "3k", "bars"), (0, "when to wear", "Fall", 40.0, "7", "data"),
    ]


def test_page_facts(spark):
    page = "<html lang='de'><title> A  b</title><meta name=description content='d'><h1>H<b>i</b></h1><img src=''><img src='/x.png'>"
    a, b = sorted(detail.page_facts(_rows(spark, [page, None]), "i", "html").collect())
    assert tuple(a)[1:] == ("A b", "H i", "d", "/x.png", "de") and tuple(b)[1:] == ("", "", "", "", "")


def test_canonical_labels(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abc", k=rng.randrange(1, 4)))
    known = [(f"c{rng.randrange(3)}", " ".join(word() for _ in range(rng.randrange(1, 4))), f"L{rng.randrange(50)}") for _ in range(3000)]
    texts = [(i, f"c{rng.randrange(4)}", " ".join(word() for _ in range(rng.randrange(0, 6)))) for i in range(400)] + [(900, None, "a"), (901, "c1", None), (902, "c1", "A-b  C"), (902, "c1", "A-b  C")]
    got = labels.canonical_labels(spark.createDataFrame(texts, "i long, card string, t string"), "card", "t", spark.createDataFrame(known, "card string, alias string, label string"))

    def plain(card, text):
        norm = " " + " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split()) + " "
        return max(((len(a), label) for c, a, label in known if c == card and f" {a} " in norm), default=(0, ""))[1]

    assert sorted((r["i"], r["canonical"]) for r in got.collect()) == sorted((i, plain(c, t)) for i, c, t in texts)
    titles = spark.createDataFrame([("Price/Value",), ("My Longevity votes",), ("x",), (None,)], "t string")
    assert [r["k"] for r in titles.select(labels.card_key(F.col("t")).alias("k")).collect()] == ["price value", "longevity", "", ""]


def test_unclosed_references(spark):
    """A reference without semicolon, as where a title was cut, stays as it is written; closed ones, and scripts, are as ever."""
    page = "<html lang='a&ampb'><title>x &amp;&amp;&amp</title><h1>&lt;b &lt &#38; &#38 & c</h1><script>a&amp;&ampb</script><img src='/p?a=1&copy=2&amp;d'>"
    row = detail.page_facts(_rows(spark, [page]), "i", "html").first()
    assert tuple(row)[1:] == ("x &&&amp", "<b &lt & &#38 & c", "", "/p?a=1&copy=2&d", "a&ampb")
    assert [e["raw"] for e in markup.tree(page)[1] if e["tag"] == "script"] == ["a&amp;&ampb"]
