"""Records from HTML with the standard library's parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Page(HTMLParser):
    """Links, title, description, language and visible text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.title, self.description, self.lang, self.text, self._in = [], [], None, None, [], []

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
        elif tag == "html":
            self.lang = found.get("lang")
        elif tag == "meta" and (found.get("name") or "").lower() == "description":
            self.description = found.get("content")
        if tag in ("title", "script", "style"):
            self._in.append(tag)

    def handle_endtag(self, tag):
        if tag in self._in:
            self._in.remove(tag)

    def handle_data(self, data):
        if "title" in self._in:
            self.title.append(data)
        elif not self._in:
            self.text.append(data)


def parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _by_text_id(pages: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """Pages through a function, ids as text on the way: pandas would round large ones beside a null."""
    made = pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInPandas(rows, f"page_id string, {schema}")
    return made.withColumn("page_id", F.col("page_id").cast("long"))


def links(pages: DataFrame) -> DataFrame:
    """HX7: (page_id, pos, href), each address of a page once, in order of first sight."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, i, h) for p, html in zip(batch["page_id"], batch["html"], strict=True) for i, h in enumerate(dict.fromkeys(parsed(html).links))]
            yield pd.DataFrame(out, columns=["page_id", "pos", "href"])

    return _by_text_id(pages, rows, "pos long, href string")


def facts(pages: DataFrame) -> DataFrame:
    """HX3: (page_id, title, description, lang, n_words of the visible text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, html in zip(batch["page_id"], batch["html"], strict=True):
                page = parsed(html)
                out.append((p, " ".join("".join(page.title).split()), page.description, page.lang, len(" ".join(page.text).split())))
            yield pd.DataFrame(out, columns=["page_id", "title", "description", "lang", "n_words"])

    return _by_text_id(pages, rows, "title string, description string, lang string, n_words long")


def cheapest_offer(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """SRC26: the least price of a payload's offers with its currency (USD where none is given)."""
    offers = payloads.select(key, F.posexplode(F.from_json(F.get_json_object(payload, "$.organic"), "array<struct<title:string,price:string,currency:string>>")).alias("pos", "o"))
    price = F.regexp_replace("o.price", "[^0-9.]", "").try_cast("double")
    priced = offers.select(key, "pos", price.alias("price"), F.coalesce("o.currency", F.lit("USD")).alias("currency")).where("price > 0")
    return priced.groupBy(key).agg(F.min_by(F.struct("price", "currency"), F.struct("price", "pos")).alias("b")).select(key, "b.price", "b.currency")
