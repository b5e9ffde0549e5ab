"""Listing pages to rows: a result card or a directory link each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markup as H
from ..functions import text as X
from ..functions.steps import computed
from . import identity
from . import predicates as P

#: Classes of the part of a page that has the cards (the last one of a div), of a card, of its lower part and of what is stressed in it.
RESULTS, GRID, CARD, LOWER, STRESSED = ("ais-StateResults", "ais-Hits"), "grid-cols-3", "prefumeHbox", "border-t", "font-medium"
#: Elements that hold a link's context, and levels that are looked up.
AROUND, LEVELS = ("div", "li", "article", "tr", "td", "section"), 5
YEAR = r"\b(?:17|18|19|20)\d{2}\b"
CARDS = 25


def _of_class(name: str):
    return lambda e: H.has_class(e, name)


def with_dom(pages: DataFrame, html: str) -> DataFrame:
    """pages with __strings and __elements of their markup instead of it; each page is read once."""
    return pages.withColumn("__dom", H.dom(F.col(html).cast("string"))).select(*[c for c in pages.columns if c != html], F.col("__dom.strings").alias("__strings"), F.col("__dom.elements").alias("__elements"))


def result_cards(pages: DataFrame, key: str, html: str, most: int = CARDS) -> DataFrame:
    """HX1: key, rank, name, brand, year, url of a page's result cards, in their order, one for each perfume, the first `most`.

    Cards are the marked links of the part with results, or, without such, links to a perfume that show something of its
    identity. What a card says of name and brand is taken where it may be one, else what the address says; cards
    without either are dropped. Nulls and pages without cards give no rows.
    """
    strings, elements = F.col("__strings"), F.col("__elements")
    read = with_dom(pages.select(key, html), html)
    root = F.coalesce(*[H.first(elements, _of_class(c)) for c in RESULTS], H.first(elements, lambda e: (e["tag"] == "div") & H.has_class(e, GRID)))
    read = computed(read, {"__root": root})
    read = computed(read, {"__scope": F.when(F.col("__root").isNull(), elements).otherwise(H.inside(elements, F.col("__root")))})
    links = F.filter("__scope", lambda e: (e["tag"] == "a") & H.attr(e, "href").isNotNull())
    read = computed(read, {"__links": links})
    read = computed(read, {"__marked": F.filter("__links", lambda e: H.has_class(e, CARD))})

    def telling(e: Column) -> Column:
        shown = F.exists(H.inside(elements, e), lambda x: x["tag"].isin("h3", "p") | ((x["tag"] == "img") & H.attr(x, "alt").isNotNull()))
        return shown | (F.coalesce(H.attr(e, "title"), F.lit("")) != "") | (F.coalesce(H.attr(e, "aria-label"), F.lit("")) != "")

    plain = F.filter("__links", lambda e: X.site_url(H.attr(e, "href")).rlike(X.SITE_PERFUME) & telling(e))
    read = computed(read, {"__cards": F.when(F.size("__marked") > 0, F.col("__marked")).otherwise(plain)})

    def card(e: Column) -> Column:
        within = H.inside(elements, e)
        h3 = H.first(within, lambda x: x["tag"] == "h3")
        p = H.first(elements, lambda x: (x["tag"] == "p") & (x["parent"] == h3["parent"]) & (x["node"] > h3["last"]))
        lower = H.first(within, lambda x: (x["tag"] == "div") & H.has_class(x, LOWER))
        img = H.first(within, lambda x: x["tag"] == "img")
        spans = F.transform(F.filter(within, lambda x: x["tag"] == "span"), lambda x: F.struct(F.when((x["node"] > lower["node"]) & (x["node"] <= lower["last"]), 0).when(H.has_class(x, STRESSED), 1).otherwise(2).alias("o"), x["node"].alias("i"), H.text_of(strings, x).alias("text")))
        years = F.array_sort(F.filter(spans, lambda x: x["text"].rlike(rf"^\s*{YEAR}\s*$")))
        label = F.coalesce(F.nullif(F.trim(H.attr(e, "title")), F.lit("")), F.trim(H.attr(e, "aria-label")), F.lit(""))
        return F.struct(
            X.site_url(H.attr(e, "href")).alias("url"), label.alias("label"), H.text_of(strings, h3).alias("heading"), H.text_of(strings, p).alias("below"),
            F.coalesce(H.attr(img, "alt"), F.lit("")).alias("alt"), F.coalesce(F.trim(F.get(years, F.lit(0))["text"]), F.lit("")).alias("year"),
        )

    cards = read.select(key, F.posexplode(F.transform("__cards", card)).alias("__pos", "__c")).select(key, "__pos", "__c.*").where(F.col("url").rlike(X.SITE_PERFUME))
    # the same perfume once: the first of its cards, met in partial minima
    once = cards.groupBy(key, X.url_key(F.col("url")).alias("__own")).agg(F.min(F.struct("__pos", "url", "label", "heading", "below", "alt", "year")).alias("c")).select(key, "c.*")
    texts = X.with_clean(once, {"__label": F.col("label"), "__heading": F.col("heading"), "__below": F.col("below"), "__alt": F.col("alt")})
    label = F.regexp_replace("__label", "(?i)^link to ", "")
    made = computed(texts, {"__label2": F.trim(label), "__said": F.coalesce(F.nullif("__heading", F.lit("")), F.nullif(F.trim(F.regexp_replace("__alt", r"(?i)^perfume\s+", "")), F.lit(""))), "__slug": X.name_in_url(F.col("url")), "__maker": X.brand_in_url(F.col("url"))})
    made = computed(made, {"__name0": F.coalesce("__said", "__slug")})
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("__label2", YEAR, ""), r"(?i)\b(?:male|female|unisex|men|women)\b", ""), r"\s+", " "))
    made = computed(made, {"__rest": rest})
    before = F.when(F.endswith(F.lower("__rest"), F.lower("__name0")) & (F.col("__name0") != ""), F.nullif(F.trim(F.substr("__rest", F.lit(1), F.length("__rest") - F.length("__name0"))), F.lit("")))
    made = computed(made, {"__brand0": F.coalesce(F.when(F.col("__heading") != "", F.nullif("__below", F.lit(""))), before, F.col("__maker"))})
    made = made.withColumns({"__nameok": P.looks_real(F.col("__name0")), "__brandok": P.looks_real(F.col("__brand0"))})
    year = F.coalesce(F.nullif("year", F.lit("")), F.regexp_extract("__label2", YEAR, 0))
    pick = lambda ok, said, slug: F.when(F.col(ok), F.col(said)).otherwise(F.coalesce(F.nullif(slug, F.lit("")), F.col(said)))
    made = computed(made, {"__full": pick("__nameok", "__name0", "__slug"), "brand": pick("__brandok", "__brand0", "__maker"), "__year": year})
    named = identity.with_stripped_name(made.select(key, "__pos", "url", "__full", "brand", "__year"), "__full", "brand", "name").where("name <> '' and brand <> ''")
    order = W.partitionBy(key).orderBy("__pos")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select(key, "rank", "name", "brand", F.col("__year").alias("year"), "url")


def directory_links(pages: DataFrame, key: str, url: str, html: str, part: str = "/fragrances/", named: bool = True) -> DataFrame:
    """HX2: key, pos, url, title, context, name, brand, year of a directory's links whose address holds `part`, each address once (the first).

    title is the link's title or text; context what stands around it, "|" between texts. The name is the address's last
    part, or what stands before "by" (there or in title and context), the brand what follows; years go out of both.
    named drops links without name and brand.
    """
    strings, elements = F.col("__strings"), F.col("__elements")
    read = with_dom(pages.select(key, F.col(url).alias("__page"), html), html)
    fits = lambda e: (e["tag"] == "a") & F.contains(H.attr(e, "href"), F.lit(part)) & (F.regexp_replace(H.attr(e, "href"), "^/+|/+$", "") != part.strip("/"))

    def around(e: Column) -> Column:
        up = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), e["parent"], lambda p, _: F.when(F.coalesce(F.get(elements, p)["tag"].isin(*AROUND), F.lit(True)), p).otherwise(F.get(elements, p)["parent"]))
        return F.get(elements, F.when(F.get(elements, up)["tag"].isin(*AROUND), up).otherwise(e["parent"]))

    # a link outside of any element has no context but itself
    link = lambda e: F.struct(H.attr(e, "href").alias("href"), F.coalesce(F.nullif(F.trim(H.attr(e, "title")), F.lit("")), H.text_of(strings, e)).alias("title"), F.when(e["parent"] >= 0, H.text_of(strings, around(e), " | ")).otherwise(H.text_of(strings, e)).alias("context"))
    rows = read.select(key, "__page", F.posexplode(F.transform(F.filter(elements, fits), link)).alias("pos", "__l")).select(key, "pos", X.joined_url(F.col("__page"), F.col("__l.href")).alias("url"), F.col("__l.title").alias("title"), F.col("__l.context").alias("context"))
    once = rows.groupBy(key, "url").agg(F.min(F.struct("pos", "title", "context")).alias("l")).select(key, "url", "l.*")
    texts = X.with_clean(once, {"__title": F.col("title"), "__context": F.col("context")})
    slug = F.regexp_replace(F.regexp_extract("url", r"([^/]*)/*$", 1), r"\.\d+$", "")
    made = computed(texts, {"__slug": X.title_from_slug(slug), "__all": F.concat_ws(" | ", "__title", "__context")})
    year = F.coalesce(F.nullif(F.regexp_extract("__all", rf"\(({YEAR})\)", 1), F.lit("")), F.regexp_extract("__title", YEAR, 0))
    halves = F.split("__all", r"(?i)\s+by\s+", 2)
    piece = lambda half, last: F.regexp_replace(F.trim(F.element_at(F.split(half, r"\|"), -1 if last else 1)), r"[^a-zA-Z0-9\s.\-%&'’]", "")
    by, stated = F.contains("__slug", F.lit(" By ")), F.col("__all").rlike(r"(?i)\bby\b") & (F.size(halves) == 2)
    made = computed(made, {"__year": year, "__name0": F.when(by, F.trim(F.regexp_extract("__slug", r"^(.*) By ", 1))).when(stated, piece(F.get(halves, F.lit(0)), True)).otherwise(F.col("__slug")), "__brand0": F.when(by, F.trim(F.regexp_extract("__slug", r".* By (.*)$", 1))).when(stated, piece(F.get(halves, F.lit(1)), False)).otherwise("")})
    undated = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.when(F.col("__year") != "", F.regexp_replace(F.col(c), F.concat(F.lit(r"\b"), F.col("__year"), F.lit(r"\b")), F.lit(""))).otherwise(F.col(c)), r"\(\s*\)", ""), r"\s+", " "))
    made = computed(made, {"__name1": undated("__name0"), "__brand1": undated("__brand0")}).withColumns({"__nameok": P.looks_real(F.col("__name1")), "__brandok": P.looks_real(F.col("__brand1"))})
    out = made.select(key, F.col("pos").cast("long").alias("pos"), "url", F.col("__title").alias("title"), F.col("__context").alias("context"), F.when(F.col("__nameok"), F.col("__name1")).otherwise("").alias("name"), F.when(F.col("__brandok"), F.col("__brand1")).otherwise("").alias("brand"), F.col("__year").alias("year"))
    return out.where("name <> '' and brand <> ''") if named else out
