"""Text, URL and number functions as Columns; Arrow functions only where Spark has no built-in."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .steps import computed, once

#: Remains of broken encodings in scraped texts, in the order they go, and what they become.
REMAINS = (
    (r"(?i)proven[^a-z]*al\s+", ""),
    (r"(?i)ylang[^a-z]lang", "ylang-ylang"),
    ("\ufffd", ""),
    ("&#65533;", ""),
    (r"\?\(?\?\?\)?", ""),
)
#: Characters without width.
ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff\ufe00-\ufe0f]"
#: Texts of a batch that are Python's at once.
PACKED = 256
#: French particles that lose their vowel, the letters they lose it before, and words that slugs glue together.
PARTICLES, VOWELS = ("d", "l"), "aeiouyh"
GLUED = {
    "dhermes": "d'Hermes", "dorsay": "d'Orsay", "dissey": "d'Issey", "lhomme": "L'Homme", "leau": "L'Eau",
    "lair": "L'Air", "linterdit": "L'Interdit", "linstant": "L'Instant", "lartisan": "L'Artisan",
}


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _each(text: pa.Array, made: Callable[[str], str]) -> pa.Array:
    """made() of each text, a null as an empty one; PACKED at a time are Python's, the rest stays packed."""
    return pa.concat_arrays([pa.array([made(x or "") for x in text.slice(k, PACKED).to_pylist()], pa.string()) for k in range(0, max(len(text), 1), PACKED)])


@F.arrow_udf(T.StringType())
def unescaped(text: pa.Array) -> pa.Array:
    """Entities resolved; a null is empty."""
    return _each(text, lambda x: html.unescape(x) if "&" in x else x)


@F.arrow_udf(T.StringType())
def unaccented(text: pa.Array) -> pa.Array:
    """Compatibility forms without combining marks; a null is empty."""
    return _each(text, lambda x: x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def _cleaned(plain: Column) -> Column:
    for pattern, new in REMAINS:
        plain = F.regexp_replace(plain, pattern, new)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, ZERO_WIDTH, ""), r"(?U)[\s\x1c-\x1f]+", " "))


def _normalized(plain: Column) -> Column:
    plain = F.replace(plain, F.lit("&"), F.lit(" and "))
    numbered = F.regexp_replace(plain, r"(?U)\bn\s*[°ºo]?\s*(\d+)\b", "no$1")
    return F.trim(F.regexp_replace(F.regexp_replace(numbered, r"(?U)\bno\s+(\d+)\b", "no$1"), "[^a-z0-9]+", " "))


def clean(text: Column | str) -> Column:
    """SF1: entities resolved, remains of broken encodings and zero-width characters gone, white space collapsed; a null is empty."""
    return _cleaned(unescaped(_column(text)))


def normalize_identity(text: Column | str) -> Column:
    """SF2: lower case without accents, & as and, numbers as no5, letters and digits only; a null is empty."""
    return _normalized(unaccented(F.lower(clean(text))))


def with_clean(rows: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """rows plus, for each named text, <name> as clean() gives it and <name>_n as normalize_identity() does, each worked out once."""
    made = rows.withColumns({k: unescaped(c) for k, c in texts.items()})
    made = computed(made, {f"{k}_c": _cleaned(F.col(k)) for k in texts})
    made = made.withColumns({f"{k}_n": unaccented(F.lower(F.col(f"{k}_c"))) for k in texts})
    made = computed(made, {f"{k}_nn": _normalized(F.col(f"{k}_n")) for k in texts})
    return made.select(*rows.columns, *[F.col(f"{k}{old}").alias(f"{k}{new}") for old, new in (("_c", ""), ("_nn", "_n")) for k in texts])


def audit_key(text: Column) -> Column:
    """SF3: lower case, runs of other than ASCII letters and digits are one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """SF6: distinct tokens of the audit key; none for a null."""
    return F.array_remove(F.array_distinct(F.split(F.coalesce(audit_key(text), F.lit("")), " ")), "")


def blank_to_null(text: Column) -> Column:
    """SC20."""
    return F.nullif(F.trim(text), F.lit(""))


def vote_count(text: Column) -> Column:
    """SC5: the first number of a text as whole votes, with k for thousands and m for millions; 0 where there is none."""
    plain, number = F.replace(F.lower(text), F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)\s*([km]?)"
    unit = F.regexp_extract(plain, number, 2)
    factor = F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).otherwise(1)
    return F.coalesce(F.regexp_extract(plain, number, 1).try_cast("double") * factor, F.lit(0)).cast("long")


def launch_year(text: Column, brand: Column, name: Column) -> Column:
    """SF5: the latest year in a text that is no word of the brand or name; empty where there is none."""
    years = F.regexp_extract_all(clean(text), F.lit(r"(?U)\b((?:17|18|19|20)\d{2})\b"), F.lit(1))
    own = F.concat(F.split(normalize_identity(brand), " "), F.split(normalize_identity(name), " "))
    return F.coalesce(F.array_max(F.array_except(years, own)), F.lit(""))


def canonical_url(url: Column) -> Column:
    """SC1: https, host in lower case without www., path without query, fragment and last slash; null if it isn't a web address."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path))


#: The main source's host, its names in addresses without a scheme, and the address of a perfume there.
SITE, SITE_NAMES = "https://www.fragrantica.com", r"(?i)^(?:www\.|beta\.)?fragrantica\.com(?:/|$)"
SITE_PERFUME = r"^https://www\.fragrantica\.com/perfume/[^/]+/[^?#]+-\d+\.html$"
#: The third source's host and path of a perfume.
THIRD_SITE, THIRD_PERFUME = "www.parfumo.com", r"(?i)^https://www\.parfumo\.com/(?:perfumes|parfums)/[^/]+/[^/?#]+$"


def joined_url(page: Column, href: Column) -> Column:
    """An address as it stands on a page, whole, without query and fragment."""
    origin = F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(page, r"^https?://[^/?#]+([^?#]*)", 1), "[^/]*$", "")
    plain = F.regexp_replace(F.trim(href), "[?#].*$", "")
    whole = F.when(plain.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), plain).when(F.startswith(plain, F.lit("//")), F.concat(F.regexp_extract(page, "^(https?:)", 1), plain))
    return whole.when(F.startswith(plain, F.lit("/")), F.concat(origin, plain)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), plain))


def site_url(href: Column) -> Column:
    """SC1: an address on the main source, whole: its host in full, https there, without query and fragment; empty for a blank one."""
    plain = F.trim(F.replace(F.coalesce(href, F.lit("")), F.lit("&amp;"), F.lit("&")))
    named = F.when(~F.contains(plain, F.lit("://")) & plain.rlike(SITE_NAMES), F.concat(F.lit("https://"), plain)).otherwise(plain)
    whole = joined_url(F.lit(f"{SITE}/"), named)
    host = F.lower(F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/]*)", 1))
    path = F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*(.*)$", 1)
    here = host.rlike(r"^(.*\.)?fragrantica\.com$")
    scheme = F.when(here, F.lit("https")).otherwise(F.lower(F.regexp_extract(whole, "^([^:]*):", 1)))
    return F.when(plain == "", "").otherwise(F.concat(scheme, F.lit("://"), F.when(here, "www.fragrantica.com").otherwise(host), path))


def third_url(url: Column) -> Column:
    """SC1: an address on the third source: https, its host in full, without query, fragment and last slash; empty without a host."""
    plain = F.trim(F.replace(F.coalesce(url, F.lit("")), F.lit("&amp;"), F.lit("&")))
    whole = F.when(plain.rlike(r"(?i)^(?:www\.)?parfumo\.com") & ~F.contains(plain, F.lit("://")), F.concat(F.lit("https://"), plain)).otherwise(plain)
    host = F.lower(F.regexp_extract(whole, r"^[a-zA-Z]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(whole, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(host == "", "").otherwise(F.concat(F.lit("https://"), F.when(F.endswith(host, F.lit("parfumo.com")), THIRD_SITE).otherwise(host), path))


def stored_url(url: Column) -> Column:
    """SC1: an address as rows are keyed by it: scheme and host in lower case, no slash at its end, the rest as it stands; null for a blank one."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")
    head = F.regexp_extract(plain, "^([^:]*://[^/]*)", 1)
    found = F.when(head != "", F.concat(F.lower(head), F.substr(plain, F.length(head) + 1))).otherwise(plain)
    return F.nullif(F.regexp_replace(found, "/+$", ""), F.lit(""))


def brand_in_url(url: Column) -> Column:
    """SC2: the brand that a perfume's address names; empty without one."""
    return title_from_slug(F.regexp_extract(url, "/perfume/([^/]+)/", 1))


def name_in_url(url: Column) -> Column:
    """SC2: the name that a perfume's address names; empty without one."""
    return title_from_slug(F.regexp_extract(url, r"/perfume/[^/]+/([^/]+)-\d+\.html$", 1))


def url_key(url: Column) -> Column:
    """SC2: the number of a perfume's address, else the address; empty for a null."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/[^/]+-(\d+)\.html$", 1), F.lit("")), url, F.lit(""))


def url_host(url: Column) -> Column:
    """SC2; null if it isn't a web address."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)), "^www[.]", ""), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def title(text: Column) -> Column:
    """Every run of letters with a capital first letter, the rest in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def elided(text: Column) -> Column:
    """SF4: the apostrophes of French elisions that slugs lost: d and l before a vowel, and words known to be glued."""
    glued = F.create_map(*[F.lit(x) for kv in GLUED.items() for x in kv])

    def joined(words: Column) -> Column:
        low = lambda i: F.lower(F.get(words, i))
        joins = lambda i: F.coalesce(low(i).isin(*PARTICLES) & F.get(words, i + 1).rlike(f"(?i)^[{VOWELS}]"), F.lit(False))

        def one(word: Column, i: Column) -> Column:
            particle = F.when(i == 0, F.upper(word)).otherwise(F.lower(word))
            return F.when(joins(i), F.concat(particle, F.lit("'"), F.get(words, i + 1))).when(~joins(i - 1), F.coalesce(F.try_element_at(glued, F.lower(word)), word))

        return F.array_join(F.array_compact(F.transform(words, one)), " ")

    return once(F.filter(F.split(text, " "), lambda w: w != ""), joined)


def title_from_slug(slug: Column) -> Column:
    """SF4: a slug's words in title case, with the apostrophes of elisions; a null is empty."""
    plain = F.try_url_decode(F.replace(F.coalesce(slug, F.lit("")), F.lit("+"), F.lit("%2B")))
    return elided(title(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(plain, slug), "[-_]+", " "), r"\s+", " "))))


def error_bucket(error: Column) -> Column:
    """SF26: first bucket whose mark the text holds, else its first 80 characters; none where it is blank."""
    text = F.lower(F.regexp_replace(F.coalesce(error, F.lit("")), "\x1b\\[[0-9;]*m", ""))
    out = F.when(F.trim(text) == "", "none")
    for bucket, marks in ERROR_MARKS:
        for mark in marks:
            out = out.when(F.contains(text, F.lit(mark)), bucket)
    return out.otherwise(F.substring(F.trim(text), 1, 80))


#: Marks of an error's text and the bucket they mean, first match wins.
ERROR_MARKS = (
    ("fg_resolver_blocked", ("fg_resolver_blocked", "rate-limited", "rate limited")),
    ("fg_url_missing_after_resolution", ("resolver returned no fragrantica url", "fg_url_missing_after_resolution")),
    ("parser_empty_frag_cards", ("parser_empty_frag_cards", "empty frag")),
    ("api_unavailable", ("api_unavailable",)),
    ("engine_exception", ("engine_exception",)),
)


def row_id(fields: Column) -> Column:
    """SRC29: a struct as an opaque id, URL-safe base64 of its JSON."""
    return F.translate(F.base64(F.encode(F.to_json(fields), "UTF-8")), "+/\n\r", "-_")


def from_row_id(value: Column, schema: str) -> Column:
    return F.from_json(F.decode(F.unbase64(F.translate(value, "-_", "+/")), "UTF-8"), schema)


def record_key(detail_url: Column, page_url: Column, brand: Column, name: Column, year: Column) -> Column:
    """SF28: the first of detail page, second page and identity that is known."""
    identity = F.concat(F.lit("id:"), F.concat_ws("|", audit_key(brand), audit_key(name), F.coalesce(year.cast("string"), F.lit(""))))
    return F.coalesce(F.concat(F.lit("fg:"), canonical_url(detail_url)), F.concat(F.lit("bn:"), canonical_url(page_url)), identity)


def is_fact(value: Column, defaults: tuple[str, ...] = ()) -> Column:
    """PF6: whether a scalar is a real fact, neither blank nor one of the default sentinels."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(~text.isin("", *UNKNOWN, *defaults), F.lit(False))


#: Texts that stand for a missing fact.
UNKNOWN = ("unknown", "unknown family", "n/a", "na", "none", "null", "-")
