"""Markup, listing cards and directory links against plain Python."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from kelpline.functions import markup as H
from kelpline.functions import text as X
from kelpline.operators import listing

SF = "/root/testdata/sf0.001"
BROKEN = ["", None, "plain", "<p>a<p>b</div>c", "<ul><li>x<li>y</ul>z", "a<br/>b<img alt='q'>c", "<div><b>x</div>y</b>", "<script>if (a<b) x()</script>t<!-- c -->u", "<a href='/x'>k &amp; l</a><", "</p>", "<div", "<DIV CLASS=A>x</Div>", "x" * 3000 + "<p>"]


class Plain(HTMLParser):
    """Each element's visible text by a tree of nodes."""

    def __init__(self):
        super().__init__()
        self.root = {"tag": "", "kids": []}
        self.stack, self.order = [self.root], []

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "kids": []}
        self.stack[-1]["kids"].append(node)
        self.order.append(node)
        if tag not in H.VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in H.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.stack[1:]):
            while self.stack.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1]["kids"].append(data)


def shown(node):
    return "".join(k if isinstance(k, str) else "" if k["tag"] in H.HIDDEN else shown(k) for k in node["kids"])


def elements_inside(node):
    return sum(1 + elements_inside(k) for k in node["kids"] if not isinstance(k, str))


def check(html, monkeypatch=None):
    plain = Plain()
    plain.feed(html or "")
    plain.close()
    strings, elements = H.tree(html)
    assert [e["tag"] for e in elements] == [n["tag"] for n in plain.order]
    for e, n in zip(elements, plain.order):
        assert e["last"] - e["node"] == elements_inside(n)
        if e["tag"] not in H.HIDDEN:
            assert "".join("".join(strings[e["start"] : e["stop"]]).split()) == "".join(shown(n).split())


def test_trees(spark, monkeypatch):
    rng = random.Random(4)
    made = ["".join(rng.choices(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<br>", "<li>", "</ul>", "x", " y ", "<i/>"], k=30)) for _ in range(100)]
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    for html in BROKEN + made + pages:
        check(html)
    whole = [H.tree(h) for h in BROKEN + pages[:20]]
    monkeypatch.setattr(H, "FED", 7)
    assert [H.tree(h) for h in BROKEN + pages[:20]] == whole


def test_urls(spark):
    cases = [
        ("/perfume/Dior/Sauvage-31861.html?x=1", "https://www.fragrantica.com/perfume/Dior/Sauvage-31861.html"), ("fragrantica.com/perfume/A/B-1.html#t", "https://www.fragrantica.com/perfume/A/B-1.html"),
        ("http://beta.Fragrantica.com/perfume/A/B-1.html", "https://www.fragrantica.com/perfume/A/B-1.html"), ("//x.org/a?b", "https://x.org/a"), ("http://Other.org/A", "http://other.org/A"), ("", ""), (None, ""), ("perfume/A/B-1.html", "https://www.fragrantica.com/perfume/A/B-1.html"),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string")
    got = {r["i"]: r for r in df.select("i", X.site_url(F.col("u")).alias("s"), X.name_in_url(X.site_url(F.col("u"))).alias("n"), X.url_key(F.col("u")).alias("k"), X.third_url(F.col("u")).alias("t")).collect()}
    assert [got[i]["s"] for i in range(len(cases))] == [w for _, w in cases]
    assert got[0]["n"] == "Sauvage" and got[0]["k"] == "/perfume/Dior/Sauvage-31861.html?x=1" and got[1]["n"] == "B" and got[6]["k"] == ""
    one = spark.createDataFrame([("parfumo.com/Perfumes/A/B/?x",), ("http://www.parfumo.com/Perfumes/A/B#y",), ("nothing",)], "u string").select(X.third_url(F.col("u")).alias("t")).collect()
    assert [r["t"] for r in one] == ["https://www.parfumo.com/Perfumes/A/B"] * 2 + [""]


CARD = '<a class="x prefumeHbox" href="{url}" title="{title}">{inner}</a>'


def test_cards(spark):
    page = "<html><div class='ais-Hits'>" + "".join([
        CARD.format(url="/perfume/Dior/Sauvage-1.html", title="", inner="<h3>Sauvage</h3><p>Dior</p><div class='border-t'><span>4.1</span><span>2015</span></div>"),
        CARD.format(url="/perfume/Dior/Sauvage-1.html?q", title="", inner="<h3>Again</h3><p>Dior</p>"),
        CARD.format(url="/perfume/Tom-Ford/Noir-2.html", title="Link to Tom Ford Noir 2012 men", inner="<img alt='perfume Noir'>"),
        CARD.format(url="/perfume/Carolina-Herrera/212-3.html", title="", inner="<h3>342 votes</h3><p>1999</p><span class='font-medium'>1997</span>"),
        CARD.format(url="/news/x.html", title="x", inner="<h3>News</h3>"),
        CARD.format(url="/perfume/Dior/J-adore-4.html", title="", inner="<h3>Dior J&#39;adore</h3><p>Dior</p><b>broken"),
    ]) + "</div><a class='prefumeHbox' href='/perfume/Out/Side-9.html'><h3>Side</h3></a>"
    plain = "<a href='/perfume/A/Bee-5.html'><h3>Bee</h3><p>Aay</p></a><a href='/perfume/A/Cee-6.html'>text only</a><a href='/perfume/Da-Eh/Gee-7.html' aria-label='Da Eh Gee'></a>"
    rows = spark.createDataFrame([(1, page, "k"), (2, plain, "k"), (3, None, "k"), (4, "<p>none</p>", "k")], "i long, html string, rank string")
    got = {}
    for r in sorted(listing.result_cards(rows, "i", "html").collect(), key=lambda r: (r["i"], r["rank"])):
        got.setdefault(r["i"], []).append((r["name"], r["brand"], r["year"], r["url"].rsplit("/", 1)[1]))
    assert got[1] == [("Sauvage", "Dior", "2015", "Sauvage-1.html"), ("Noir", "Tom Ford", "2012", "Noir-2.html"), ("212", "Carolina Herrera", "1997", "212-3.html"), ("J'adore", "Dior", "", "J-adore-4.html")]
    assert got[2] == [("Bee", "Aay", "", "Bee-5.html"), ("Gee", "Da Eh", "", "Gee-7.html")]
    assert set(got) == {1, 2}
    assert [r["name"] for r in listing.result_cards(rows.where("i = 1"), "i", "html", 1).collect()] == ["Sauvage"]


def test_directory(spark):
    html = """<ul><li><a href="/fragrances/">all</a></li>
      <li><b><a href="/fragrances/noir-by-tom-ford.123?x=1">Noir</a></b> (2012)</li><li><a href="/fragrances/noir-by-tom-ford.123">again</a></li>
      <li><a href="aqua.5/fragrances/aqua" title="Aqua (1999) by Some House">t</a></li><li><a href="/fragrances/12345">12345</a></li><li><a href="/other">o</a></li></ul><a href="/fragrances/lone-by-me">x"""
    rows = spark.createDataFrame([(1, "https://x.org/dir/?p=1", html, "k"), (2, None, None, "k")], "i long, url string, html string, pos string")
    got = sorted((r["pos"], r["url"], r["title"], r["context"], r["name"], r["brand"], r["year"]) for r in listing.directory_links(rows, "i", "url", "html").collect())
    assert got == [
        (0, "https://x.org/fragrances/noir-by-tom-ford.123", "Noir", "Noir | (2012)", "Noir", "Tom Ford", "2012"),
        (2, "https://x.org/dir/aqua.5/fragrances/aqua", "Aqua (1999) by Some House", "t", "Aqua", "Some House", "1999"),
        (4, "https://x.org/fragrances/lone-by-me", "x", "x", "Lone", "Me", ""),
    ]
    assert listing.directory_links(rows, "i", "url", "html", named=False).count() == 4
