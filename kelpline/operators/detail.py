"""Detail pages to facts: selectors that run together in one pass over a page's elements, and what each source makes of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as H
from ..functions import text as X
from ..functions.steps import computed
from . import labels
from .listing import with_dom

#: What ends the notes of a second-source page, elements that may head them, and siblings that are looked at.
NOTES_END = ("latest reviews", "your tags", "by the same house", "advertisement", "where to buy", "add your review", "fragrance reviews", "similar fragrances")
NOTES_HEADS, SIBLINGS = ("h2", "h3", "h4", "div", "b", "strong", "span"), 15
LAYERS = ("top", "heart", "base", "flat")
#: Names of layers in headings of a third-source page; perfumers that are kept.
LAYER_HEADS = {"top notes": "top", "heart notes": "heart", "middle notes": "heart", "base notes": "base"}
PERFUMERS = 5
#: Keys of votes in a page's data, without other than letters, and the card they are of.
VOTE_KEYS = {
    "longevity": "Longevity", "sillage": "Sillage", "projection": "Projection", "gender": "Gender", "value": "Price Value", "pricevalue": "Price Value",
    "season": "When to wear", "daynight": "When to wear", "whentowear": "When to wear", "wear": "When to wear",
}


def first_nodes(elements: Column, selectors: dict[str, Callable[[Column], Column]]) -> Column:
    """A struct of, for each selector, the number of the first element that it accepts, or null: one pass for all of them."""
    none = F.struct(*[F.lit(None).cast("int").alias(k) for k in selectors])
    return F.aggregate(elements, none, lambda met, e: F.struct(*[F.coalesce(met[k], F.when(fits(e), e["node"])).alias(k) for k, fits in selectors.items()]))


def selected(pages: DataFrame, html: str, selectors: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """pages with __strings, __elements and, for each selector, the element __<name> instead of their markup."""
    read = computed(with_dom(pages, html), {"__met": first_nodes(F.col("__elements"), selectors)})
    read = read.withColumns({f"__at_{k}": F.col("__met")[k] for k in selectors}).drop("__met")
    return computed(read, {f"__{k}": F.get("__elements", F.col(f"__at_{k}")) for k in selectors}).drop(*[f"__at_{k}" for k in selectors])


def tagged(tag: str, **attrs: str) -> Callable[[Column], Column]:
    """A selector by tag ("" for any) and exact attributes (type_ for type and so on)."""
    return lambda e: _all([e["tag"] == tag] * bool(tag) + [F.coalesce(H.attr(e, k.rstrip("_")) == v, F.lit(False)) for k, v in attrs.items()])


def classed(tag: str, pattern: str) -> Callable[[Column], Column]:
    """A selector by tag ("" for any) and a pattern of the class, whatever its case."""
    return lambda e: _all([e["tag"] == tag] * bool(tag) + [F.coalesce(H.attr(e, "class").rlike(f"(?i){pattern}"), F.lit(False))])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def content(e: Column) -> Column:
    return F.coalesce(H.attr(e, "content"), F.lit(""))


def page_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, heading, description, image, lang of any page; empty where it has none. One pass for all fields."""
    selectors = {
        "title": tagged("title"), "h1": tagged("h1"), "meta": tagged("meta", name="description"), "og": tagged("meta", property="og:description"),
        "image": tagged("meta", property="og:image"), "html": tagged("html"), "img": lambda e: (e["tag"] == "img") & (F.coalesce(H.attr(e, "src"), F.lit("")) != ""),
    }
    read = selected(pages.select(key, html), html, selectors)
    s = F.col("__strings")
    some = lambda *columns: F.coalesce(*[F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) for c in columns], F.lit(""))
    return read.select(
        key, some(H.text_of(s, F.col("__title"))).alias("title"), some(H.text_of(s, F.col("__h1"))).alias("heading"), some(content(F.col("__meta")), content(F.col("__og"))).alias("description"),
        some(content(F.col("__image")), H.attr(F.col("__img"), "src")).alias("image"), some(H.attr(F.col("__html"), "lang")).alias("lang"),
    )


def note_items(text: Column) -> Column:
    """Notes of a text: split at commas, semicolons, bars, dots of lists and lines; names of layers go; each once, in order."""
    parts = F.transform(F.split(text, r"[,;|\n\u2022]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    plain = F.filter(parts, lambda x: (x != "") & ~x.rlike(r"(?i)^(and\s+)?(top|head|heart|middle|base)\s*(notes?)?$"))
    bare = F.transform(plain, lambda x: F.trim(F.regexp_replace(x, r"(?i)^(?:top|head|heart|middle|base)\s*(?:notes?)?\s*[:\-]?\s*", "")))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) > 1))


def notes_of_text(text: Column) -> Column:
    """Struct of layers that a text lays out by "top notes", "heart notes" and "base notes"; flat where it names none."""
    layered = text.rlike(r"(?i)(top|head|heart|middle|base)\s*notes?\s*[:\-]?")
    piece = lambda pattern: note_items(F.regexp_extract(text, pattern, 1))
    empty = F.array().cast("array<string>")
    found = {
        "top": piece(r"(?is)(?:top|head)\s*notes?[\s:\-]*(.*?)(?=(?:heart|middle|base)\s*notes?|$)"),
        "heart": piece(r"(?is)(?:heart|middle)\s*notes?[\s:\-]*(.*?)(?=(?:base)\s*notes?|$)"),
        "base": piece(r"(?is)(?:base)\s*notes?[\s:\-]*(.*)"),
    }
    return F.struct(*[F.when(layered, c).otherwise(empty).alias(k) for k, c in found.items()], F.when(layered, empty).otherwise(note_items(text)).alias("flat"))


def second_source(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HX5: key, gender, description, votes (pos, neu, neg: struct of n and pct), top, heart, base, flat of a second-source page.

    Gender is by the colours of its mark, votes are by the links of the reviews (the last of a kind), notes by a list with
    headings, else by its text, a box's, or what follows a heading "notes". Empty texts, nulls and empty lists where a page
    has none.
    """
    selectors = {
        "head": classed("", "fraghead-inner"), "itemdesc": tagged("div", itemprop="description"), "fragdesc": classed("div", "fragdesc"), "rev": tagged("", id="fragrev"),
        "reviews": classed("div", "fragreviews"), "list": lambda e: (e["tag"] == "ul") & H.has_class(e, "fragrancenotes"), "box": lambda e: (e["tag"] == "div") & H.has_class(e, "fragrancenotes"),
    }
    read = selected(pages.select(key, html), html, selectors)
    s, every = F.col("__strings"), F.col("__elements")
    scope = F.when(F.col("__head").isNull(), every).otherwise(H.inside(every, F.col("__head")))
    mark = H.first(scope, lambda e: (e["tag"] == "span") & F.coalesce(H.attr(e, "class").rlike("(?i)h1_gender"), F.lit(False)))
    heading = H.first(every, lambda e: e["tag"].isin(*NOTES_HEADS) & H.text_of(s, e, "").rlike(r"(?i)^\s*(?:fragrance\s+)?notes\s*$"))
    read = computed(read, {"__mark": mark, "__desc": F.coalesce("__itemdesc", "__fragdesc"), "__revs": F.coalesce("__rev", "__reviews"), "__heading": heading})
    colours = F.array_join(F.flatten(F.transform(F.concat(F.array("__mark"), H.inside(every, F.col("__mark"))), lambda e: F.map_values(e["attrs"]))), " ")
    said = F.filter(F.transform(F.filter(H.inside(every, F.col("__revs")), lambda e: e["tag"] == "a"), lambda e: F.regexp_extract(H.text_of(s, e), r"(?i)(\d+)\s*(?:Positive|Neutral|Negative)\s*\(\d+%\)", 0)), lambda x: x != "")
    items = F.filter(every, lambda e: (e["tag"] == "li") & (e["parent"] == F.col("__list.node")))

    def layer(e: Column) -> Column:
        h3, ul = H.first(H.inside(every, e), lambda x: x["tag"] == "h3"), H.first(H.inside(every, e), lambda x: x["tag"] == "ul")
        name = F.lower(H.text_of(s, h3, ""))
        which = F.when(F.contains(name, F.lit("head")) | F.contains(name, F.lit("top")), "top").when(F.contains(name, F.lit("heart")) | F.contains(name, F.lit("middle")), "heart").when(F.contains(name, F.lit("base")), "base")
        return F.struct(h3["node"].isNotNull().alias("headed"), F.when(ul["node"].isNotNull(), which).alias("which"), note_items(H.text_of(s, ul, ", ")).alias("notes"))

    after = F.slice(F.filter(every, lambda e: (e["parent"] == F.col("__heading.parent")) & (e["node"] > F.col("__heading.last"))), 1, SIBLINGS)
    ends = "|".join(NOTES_END)
    blocks = F.aggregate(F.transform(after, lambda e: H.text_of(s, e, "\n")), F.struct(F.lit(False).alias("over"), F.lit("").alias("text")), lambda a, t: F.when(a["over"] | F.lower(F.regexp_replace(t, r"\s+", " ")).rlike(ends), F.struct(F.lit(True).alias("over"), a["text"].alias("text"))).otherwise(F.struct(F.lit(False).alias("over"), F.concat_ws("\n", F.nullif(a["text"], F.lit("")), t).alias("text"))))
    # fields of elements are read in projections; computed() takes whole columns
    read = read.withColumns({"__colours": F.lower(F.replace(colours, F.lit(" "), F.lit(""))), "__said": said, "__layers": F.transform(items, layer), "__blocks": blocks["text"], "__listed": H.text_of(s, F.col("__list"), "\n"), "__boxed": H.text_of(s, F.col("__box"), "\n"), "__haslist": F.col("__list").isNotNull(), "__hasbox": F.col("__box").isNotNull(), "description": H.text_of(s, F.col("__desc"), "\n")})
    read = computed(read.select(key, "description", "__colours", "__said", "__layers", "__blocks", "__listed", "__boxed", "__haslist", "__hasbox"), {"__headed": F.exists("__layers", lambda x: x["headed"])})
    read = computed(read, {"__text": notes_of_text(F.when(F.col("__haslist"), F.col("__listed")).when(F.col("__hasbox"), F.col("__boxed")).otherwise(F.col("__blocks")))})
    blue, pink = F.contains("__colours", F.lit("dodgerblue")), F.contains("__colours", F.lit("hotpink"))
    gender = F.when(blue & pink, "Unisex").when(blue, "Masculine").when(pink, "Feminine").otherwise("")

    def votes(kind: str) -> Column:
        last = F.try_element_at(F.filter("__said", lambda x: F.contains(F.lower(x), F.lit(kind))), F.lit(-1))
        return F.when(last.isNotNull(), F.struct(F.regexp_extract(last, r"^(\d+)", 1).cast("long").alias("n"), F.regexp_extract(last, r"\((\d+)%", 1).cast("int").alias("pct"))).alias(kind[:3])

    by_list = lambda k: F.flatten(F.transform(F.filter("__layers", lambda x: x["which"] == k), lambda x: x["notes"]))
    layers = [F.when(F.col("__headed"), by_list(k) if k != "flat" else F.array().cast("array<string>")).otherwise(F.col("__text")[k]).alias(k) for k in LAYERS]
    return read.select(key, gender.alias("gender"), "description", F.struct(*[votes(k) for k in ("positive", "neutral", "negative")]).alias("votes"), *layers)


def third_source(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HX6: key, url, house, name, gender, status, year, accord, rating, rating_count, top, heart, base, flat, perfumers of a third-source page.

    Pages whose own address isn't that of a perfume (missing ones are answered like others) give no row. House and
    name are by the last list of crumbs in the page's data, the name else by its title before "by".
    """
    meta = lambda name: tagged("meta", property=f"og:{name}")
    selectors = {"url": meta("url"), "ogtitle": meta("title"), "ogdesc": meta("description"), "rv": tagged("", itemprop="ratingValue"), "rc": tagged("", itemprop="ratingCount"), "notes": lambda e: H.has_class(e, "notes_list")}
    read = selected(pages.select(key, html), html, selectors)
    s, every = F.col("__strings"), F.col("__elements")
    read = read.withColumn("url", X.third_url(content(F.col("__url")))).where(F.col("url").rlike(X.THIRD_PERFUME))
    stated = lambda e: F.trim(F.coalesce(F.nullif(content(F.col(e)), F.lit("")), H.text_of(s, F.col(e), "")))
    data = F.transform(F.filter(every, lambda e: (e["tag"] == "script") & F.coalesce(H.attr(e, "type") == "application/ld+json", F.lit(False))), lambda e: F.from_json(e["raw"], "`@type` string, itemListElement array<struct<name:string>>"))
    spans = F.filter(F.transform(F.filter(H.inside(every, F.col("__notes")), lambda e: H.has_class(e, "clickable_note_img")), lambda e: F.trim(H.text_of(s, e))), lambda x: x != "")
    people = F.transform(F.filter(every, lambda e: (e["tag"] == "a") & F.contains(H.attr(e, "href"), F.lit("/Perfumers/"))), lambda e: F.trim(H.text_of(s, e, "")))
    inside = F.slice(s, F.col("__notes.start") + 1, F.col("__notes.stop") - F.col("__notes.start"))
    read = read.select(
        key, "url", content(F.col("__ogdesc")).alias("__desc"), content(F.col("__ogtitle")).alias("__title"), stated("__rv").alias("rating"), stated("__rc").alias("rating_count"),
        F.filter(data, lambda d: d["@type"] == "BreadcrumbList").alias("__crumbs"), F.coalesce(spans, F.array().cast("array<string>")).alias("__spans"), F.coalesce(inside, F.array().cast("array<string>")).alias("__lines"),
        F.slice(F.array_distinct(F.filter(people, lambda x: x != "")), 1, PERFUMERS).alias("perfumers"),
    )
    at_least = lambda k: F.try_element_at(F.filter("__crumbs", lambda d: F.size(d["itemListElement"]) >= k), F.lit(-1))["itemListElement"]
    crumb_name, house = F.try_element_at(at_least(1), F.lit(-1))["name"], F.try_element_at(at_least(3), F.lit(3))["name"]
    table = F.create_map(*[F.lit(x) for kv in LAYER_HEADS.items() for x in kv])
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("flat").alias("now"), *[empty.alias(k) for k in LAYERS])

    def place(a: Column, line: Column) -> Column:
        head = F.try_element_at(table, F.lower(F.trim(line)))
        own = F.trim(F.regexp_replace(line, r"\s+", " "))
        fits = head.isNull() & F.array_contains("__spans", own)
        return F.struct(F.coalesce(head, a["now"]).alias("now"), *[F.when(fits & (a["now"] == k), F.concat(a[k], F.array(own))).otherwise(a[k]).alias(k) for k in LAYERS])

    read = computed(read, {"__layered": F.lower(F.array_join("__lines", " ")).rlike("top notes|base notes|heart notes"), "__placed": F.aggregate("__lines", start, place)})
    read = read.withColumns({f"__p_{k}": F.col("__placed")[k] for k in LAYERS})
    read = computed(read, {"__in_layers": F.concat("__p_top", "__p_heart", "__p_base"), "__low": F.lower("__desc")})
    spread = F.col("__layered") & (F.size("__in_layers") > 0)
    loose = F.concat("__p_flat", F.filter(F.array_except("__spans", F.col("__p_flat")), lambda n: ~F.array_contains("__in_layers", n)))
    both = F.col("__low").rlike("women and men|men and women")
    women, men = F.contains("__low", F.lit("for women")), F.contains("__low", F.lit("for men"))
    gender = F.when((women | both) & (men | both), "Unisex").when(women, "Feminine").when(men, "Masculine").otherwise("")
    status = F.when(F.contains("__low", F.lit("still in production")), "in_production").when(F.contains("__low", F.lit("discontinued")), "discontinued").otherwise("")
    year = F.coalesce(F.nullif(F.regexp_extract("__desc", r"released in (\d{4})", 1), F.lit("")), F.regexp_extract("__desc", r"\b(?:19|20)\d{2}\b", 0))
    named = F.coalesce(F.nullif(crumb_name, F.lit("")), F.trim(F.get(F.split("__title", r"\s+by\s+"), F.lit(0))), F.lit(""))
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return read.select(
        key, "url", tidy(house).alias("house"), tidy(named).alias("name"), gender.alias("gender"), status.alias("status"), year.alias("year"), F.regexp_extract("__low", r"scent is ([a-z\-]+)", 1).alias("accord"), "rating", "rating_count",
        *[F.when(spread, F.col(f"__p_{k}")).otherwise(empty).alias(k) for k in ("top", "heart", "base")], F.when(spread, loose).otherwise(F.col("__spans")).alias("flat"), "perfumers",
    )


def bar_share(e: Column) -> Column:
    """HX4: the percent that a bar shows, 0 to 100: by its width, a variable of its style, its stated value, its data, or as progress; null for other elements."""
    style = F.coalesce(H.attr(e, "style"), F.lit(""))
    number = lambda text: F.nullif(text, F.lit("")).try_cast("double")
    found = [number(F.regexp_extract(style, r"(?i)(?<![-\w])width\s*:\s*([\d.]+)\s*%", 1))]
    found += [number(F.regexp_extract(style, rf"(?i){name}\s*:\s*([\d.]+)\s*%?", 1)) for name in ("--w", "--width", "--progress", "--value", "--pct")]
    most = F.coalesce(number(F.trim(H.attr(e, "aria-valuemax"))), F.lit(100.0))
    found.append(F.when(most > 0, number(F.trim(H.attr(e, "aria-valuenow"))) / most * 100.0))
    found += [number(F.regexp_replace(F.trim(H.attr(e, f"data-{name}")), "%$", "")) for name in ("pct", "value", "percent", "percentage")]
    whole = number(F.trim(F.coalesce(H.attr(e, "max"), F.lit("1"))))
    found.append(F.when(e["tag"].isin("progress", "meter") & (whole > 0), number(F.trim(H.attr(e, "value"))) / whole * 100.0))
    share = F.coalesce(*found)
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)))


def metric_bars(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HX4: key, pos, card, text, pct, count: the bars of the part of a page with its performance (else of the whole page).

    A bar is of the last card title before it; its row is the nearest element around it that shows a text which is no
    title, text is what that says but for its first number, count that number. Bars without title or text are dropped.
    """
    read = selected(pages.select(key, html), html, {"part": tagged("", id="performance")})
    s, every = F.col("__strings"), F.col("__elements")
    scope = F.when(F.col("__part").isNull(), every).otherwise(H.inside(every, F.col("__part")))
    read = computed(read, {"__scope": scope})
    title = lambda e: labels.card_key(F.when(e["stop"] - e["start"] == 1, H.text_of(s, e)))
    exact = lambda e: F.regexp_replace(F.lower(H.text_of(s, e)), "[^a-z]", "").isin(*labels.TITLES)
    read = computed(read, {"__titles": F.transform(F.filter("__scope", lambda e: (e["stop"] - e["start"] == 1) & exact(e)), lambda e: F.struct(e["node"].alias("node"), title(e).alias("card")))})

    def row(e: Column) -> Column:
        shows = lambda n: F.coalesce((F.get(every, n)["stop"] > F.get(every, n)["start"]) & ~exact(F.get(every, n)), F.lit(True))
        around = F.aggregate(F.sequence(F.lit(1), F.lit(4)), e["node"], lambda n, _: F.when(shows(n), n).otherwise(F.get(every, n)["parent"]))
        text = H.text_of(s, F.get(every, around))
        card = F.array_max(F.filter("__titles", lambda x: x["node"] < e["node"]))["card"]
        number = r"\d[\d,.]*\s*[kKmM]?\b"
        return F.struct(card.alias("card"), F.trim(F.regexp_replace(F.regexp_replace(text, rf"{number}%?", " "), r"\s+", " ")).alias("text"), bar_share(e).alias("pct"), F.trim(F.regexp_extract(text, rf"({number})(?!\s*%)", 1)).alias("count"))

    rows = read.select(key, F.posexplode(F.transform(F.filter("__scope", lambda e: bar_share(e).isNotNull()), row)).alias("pos", "__r"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), "__r.*").where("card is not null and text <> ''")


def metric_data(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HX4: key, pos, card, text, pct, count of votes in the data that a page's scripts hold: objects of labels and percents, or of label, pct and count.

    The innermost objects and lists are read wherever they stand, so nesting has no limit; percents beyond 0 to 100 are dropped.
    """
    read = with_dom(pages.select(key, html), html)
    raw = F.array_join(F.transform(F.filter("__elements", lambda e: (e["tag"] == "script") & e["raw"].isNotNull()), lambda e: e["raw"]), "\n")
    read = computed(read, {"__raw": raw})
    found = F.regexp_extract_all("__raw", F.lit(r'"[^"\\]*"\s*:\s*(?:\{[^{}\[\]]*\}|\[\s*\{[^{}\[\]]*\}(?:\s*,\s*\{[^{}\[\]]*\})*\s*\])'), F.lit(0))
    rows = read.select(key, F.posexplode(found).alias("__i", "__text"))
    table = F.create_map(*[F.lit(x) for kv in VOTE_KEYS.items() for x in kv])
    rows = computed(rows, {"card": F.try_element_at(table, F.regexp_replace(F.lower(F.regexp_extract("__text", r'^"([^"]*)"', 1)), "[^a-z]", "")), "__value": F.regexp_replace("__text", r'^"[^"]*"\s*:\s*', "")}).where("card is not null")
    item = "label string, pct string, percent string, value string, count string, votes string"
    rows = computed(rows, {"__list": F.from_json(F.when(F.startswith("__value", F.lit("[")), F.col("__value")), f"array<struct<{item.replace(' string', ':string')}>>"), "__map": F.from_json(F.when(F.startswith("__value", F.lit("{")), F.col("__value")), "map<string,string>")})
    one = lambda label, pct, count: F.struct(label.alias("text"), F.regexp_replace(F.trim(pct), "%$", "").try_cast("double").alias("pct"), F.coalesce(count, F.lit("")).alias("count"))
    named = lambda get: one(get("label"), F.coalesce(get("pct"), get("percent"), get("value")), F.coalesce(get("count"), get("votes")))
    of_map = F.when(F.map_contains_key("__map", "label"), F.array(named(lambda k: F.try_element_at("__map", F.lit(k))))).when(F.forall(F.map_values("__map"), lambda v: v.try_cast("double").isNotNull()), F.transform(F.map_entries("__map"), lambda kv: one(kv["key"], kv["value"], F.lit(None).cast("string"))))
    of_list = F.transform(F.filter("__list", lambda x: x["label"].isNotNull()), lambda x: named(lambda k: x[k]))
    items = rows.select(key, "__i", "card", F.posexplode(F.coalesce(of_list, of_map)).alias("__k", "__r"))
    return items.select(key, (F.col("__i").cast("long") * 1_000_000 + F.col("__k")).alias("pos"), "card", "__r.*").where("pct between 0 and 100 and text is not null")


def metric_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HX4: key, card, label, pct, count, source (data or bars): a page's metrics with their labels as they are known.

    Each label of a card comes from the data if that has it, else from the bars; the first row of a label counts. Labels that
    are not known stand as they are.
    """
    data = metric_data(pages, key, html).select(key, F.lit(0).alias("__pass"), "pos", F.lower("card").alias("card"), "text", "pct", "count")
    bars = metric_bars(pages, key, html).select(key, F.lit(1).alias("__pass"), "pos", "card", "text", "pct", "count")
    named = labels.canonical_labels(data.unionByName(bars), "card", "text", labels.known_aliases(pages.sparkSession))
    own = named.withColumn("label", F.coalesce(F.nullif("canonical", F.lit("")), F.initcap(F.trim("text"))))
    once = own.groupBy(key, "card", "label").agg(F.min(F.struct("__pass", "pos", "pct", "count")).alias("r"))
    return once.select(key, "card", "label", F.col("r.pct").alias("pct"), F.col("r.count").alias("count"), F.when(F.col("r.__pass") == 0, "data").otherwise("bars").alias("source"))
