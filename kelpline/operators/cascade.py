"""Facts found by the first of several ways that gives one, as Columns in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: The gender that stands for none, labels of a vote, and what descriptions and names say.
UNSPECIFIED = "Unisex / Unspecified"
VOTED = {
    "female": "Feminine", "more female": "Feminine", "more feminine": "Feminine", "feminine": "Feminine",
    "male": "Masculine", "more male": "Masculine", "more masculine": "Masculine", "masculine": "Masculine", "unisex": "Unisex",
}
DESCRIBED = (
    (r"\bfragrance for women and men\b|\bfragrance for men and women\b|\bunisex fragrance\b", "Unisex"),
    (r"\bfragrance for women\b|\bfor women\b", "Feminine"),
    (r"\bfragrance for men\b|\bfor men\b", "Masculine"),
)
NAMED = (
    (r"\b(for women|pour femme|for her|femme|for ladies|women)\b", "Feminine"),
    (r"\b(for men|pour homme|for him|homme|men)\b", "Masculine"),
    (r"\b(unisex|shared)\b", "Unisex"),
)
#: What a launch sentence, a year and an unknown year look like.
LAUNCHED = r"(?i)(?:launched in|was launched in)\s*(\b(?:17|18|19|20)\d{2}\b)"
YEAR = r"\b((?:17|18|19|20)\d{2})\b"
YEAR_UNKNOWN = r"(?i)release year is unknown"
#: What product types say of a concentration, first match wins, and the labels that other sources use for it.
PRODUCT_TYPES = (
    (r"extrait|extract", "Extrait"),
    (r"eau de parfum|\bedp\b", "Eau de Parfum"),
    (r"eau de toilette|\bedt\b", "Eau de Toilette"),
    (r"eau de cologne|\bedc\b", "Eau de Cologne"),
    (r"eau fraiche", "Eau de Cologne"),
    (r"body spray|body mist|hair mist", "Body Spray"),
    (r"elixir|le parfum|^parfum$", "Parfum"),
    (r"^(perfume|fragrance)$", "Parfum"),
)
DISPLAYED = {
    "EDP (Eau de Parfum)": "Eau de Parfum", "EDT (Eau de Toilette)": "Eau de Toilette", "EDC (Cologne)": "Eau de Cologne",
    "Extrait / Parfum Extract": "Extrait", "Parfum (Profumo)": "Parfum", "Le Parfum": "Parfum", "Elixir": "Elixir",
    "EDP Intense": "Eau de Parfum Intense", "EDT Intense": "Eau de Toilette Intense", "Eau Fraiche": "Eau Fraiche",
    "Body Mist / Hair Mist": "Body Mist", "Aftershave": "Aftershave",
}
STORED = {
    "EDP (Eau de Parfum)": "Eau de Parfum", "EDT (Eau de Toilette)": "Eau de Toilette", "EDC (Cologne)": "Eau de Cologne",
    "Extrait / Parfum Extract": "Extrait", "Parfum (Profumo)": "Parfum", "Le Parfum": "Parfum", "Elixir": "Elixir",
    "EDP Intense": "Eau de Parfum", "EDT Intense": "Eau de Toilette", "Body Mist / Hair Mist": "Body Spray",
    "Eau Fraiche": "Eau de Cologne", "Aftershave": "Eau de Cologne",
}
#: Confidences of the tiers that say a concentration.
CATALOG_CONFIDENCE, EXPLICIT_CONFIDENCE, BRAND_CONFIDENCE, PILLAR_CONFIDENCE = 95, 100, 70, 80
#: Sources of a fact's note that say it can't be known.
UNKNOWN_YEAR_SOURCE = "decodo_serp_authoritative_unknown"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _first(text: Column, patterns) -> Column:
    out = F.when(text.rlike(patterns[0][0]), patterns[0][1])
    for pattern, value in patterns[1:]:
        out = out.when(text.rlike(pattern), value)
    return out


def gender(known: Column, cards: Column, description: Column, name: Column) -> Column:
    """SF33: a known gender, else the most voted label of the gender card, else what the description says, else the name; null for none."""
    rows = F.coalesce(F.get(F.filter(cards, lambda c: F.lower(c["card"]) == "gender"), F.lit(0))["rows"], F.array().cast("array<struct<label:string,value:string,pct:double,count:string>>"))
    weight = lambda r: F.coalesce(F.nullif(X.vote_count(r["count"]), F.lit(0).cast("long")).cast("double"), r["pct"], F.lit(0.0))
    placed = F.transform(F.filter(rows, lambda r: F.coalesce(r["label"], F.lit("")) != ""), lambda r, i: F.struct(weight(r).alias("w"), (-i).alias("i"), F.lower(F.trim(r["label"])).alias("label")))
    voted = _lookup(VOTED, F.array_max(placed)["label"])
    said = F.nullif(F.nullif(F.trim(F.coalesce(known, F.lit(""))), F.lit("")), F.lit(UNSPECIFIED))
    return F.coalesce(said, voted, _first(F.lower(F.coalesce(description, F.lit(""))), DESCRIBED), _first(F.lower(F.coalesce(name, F.lit(""))), NAMED))


def year(known: Column, captured: Column, description: Column, title: Column, brand: Column, name: Column) -> Column:
    """SF33: a known year (not 0), else the one captured, the launch sentence's, the title's, the first of the description, the name's; empty for none."""
    given = lambda c: F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))
    found = lambda text, pattern: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))
    titled = F.nullif(X.launch_year(title, brand, name), F.lit(""))
    return F.coalesce(F.nullif(given(known), F.lit("0")), given(captured), found(description, LAUNCHED), titled, found(description, YEAR), found(name, YEAR), F.lit(""))


def product_concentration(product_type: Column) -> Column:
    """SF31: what a product's type says of its concentration, Unknown where it says nothing."""
    return F.coalesce(_first(X.audit_key(F.coalesce(product_type, F.lit(""))), PRODUCT_TYPES), F.lit("Unknown"))


def displayed_concentration(label: Column) -> Column:
    """SF31: a voted label as it is shown; others as they are."""
    return F.coalesce(_lookup(DISPLAYED, label), label)


def stored_concentration(label: Column) -> Column:
    """SF31: a voted label as rows store it, Unknown for others."""
    return F.coalesce(_lookup(STORED, label), F.lit("Unknown"))


def concentration(catalog: Column, explicit: Column, brand_prior: Column, pillar: Column, voted: Column, voted_confidence: Column) -> Column:
    """SF32: struct of value, confidence and source of the first tier that says one: catalogue, name, brand, pillar, votes; null for none."""
    tier = lambda value, confidence, source: F.when(F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("Unknown")) != "Unknown", F.struct(F.trim(value).alias("value"), confidence.cast("int").alias("confidence"), F.lit(source).alias("source")))
    fixed = ((catalog, CATALOG_CONFIDENCE, "catalog"), (explicit, EXPLICIT_CONFIDENCE, "explicit"), (brand_prior, BRAND_CONFIDENCE, "brand"), (pillar, PILLAR_CONFIDENCE, "pillar"))
    return F.coalesce(*[tier(value, F.lit(confidence), source) for value, confidence, source in fixed], tier(voted, voted_confidence, "votes"))


def performance_delta(value: Column, old: Column, new: Column, boosts: dict[str, int], default: int = 5) -> Column:
    """SC18: a whole score moved by what two concentrations' boosts differ by; an unknown one boosts nothing."""
    table = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    boost = lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0))
    return F.coalesce(value, F.lit(default)) - boost(old) + boost(new)


def unknown_years(rows: DataFrame, key: str, brand: str, name: str, title: str, snippet: str, url: str, domains: tuple[str, ...], most: int = 4) -> DataFrame:
    """AG27: records whose year is said to be unknown by an authoritative page about them: domains, how many, and the first evidence.

    Of each domain the first row counts; brand and name must have all their words in title or snippet. Rows have a column pos, their order.
    """
    if "pos" not in rows.columns:
        raise ValueError("rows need a column pos, their order")
    said = X.normalize_identity(F.concat_ws(" ", F.col(title), F.col(snippet)))
    asked = F.array_remove(F.split(X.normalize_identity(F.concat_ws(" ", F.col(brand), F.col(name))), " "), "")
    host = F.coalesce(X.url_host(F.col(url)), F.lit(""))
    known = F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    hits = rows.withColumn("__d", host).where(known & F.col(snippet).rlike(YEAR_UNKNOWN) & (F.size(F.array_except(asked, F.split(said, " "))) == 0))
    first = hits.groupBy(key, "__d").agg(F.min(F.struct("pos", F.col(url).alias("u"))).alias("e"))
    return first.groupBy(key).agg(F.array_sort(F.collect_set("__d")).alias("domains"), F.count("*").alias("evidence_count"), F.transform(F.slice(F.array_sort(F.collect_list("e")), 1, most), lambda e: e["u"]).alias("evidence"))  # a row a domain


def marks_unknown(source: Column, marker: str = UNKNOWN_YEAR_SOURCE) -> Column:
    """PF28: whether a fact's note says that it can't be known."""
    return F.coalesce(source == marker, F.lit(False))


def ballot_weight(tier: Column, field: Column, position: Column, tiers: dict[str, float], fields: dict[str, float], decay: tuple[float, ...]) -> Column:
    """AG24: a ballot's weight: its source's tier times its field's weight times the decay of its position; positions past the list weigh nothing."""
    of = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(0.0))
    return of(tiers, tier) * of(fields, field) * F.coalesce(F.get(F.array(*[F.lit(d) for d in decay]), position), F.lit(0.0))


def vote(rows: DataFrame, key: str, choice: str, weight: Column) -> DataFrame:
    """AG24: summed ballots: each key's choices with weight, share in percent and rank; the weights are summed before the window."""
    sums = rows.groupBy(key, choice).agg(F.sum(weight).alias("weight")).where("weight > 0")
    at = W.partitionBy(key)
    return sums.withColumns({"share": F.col("weight") * 100.0 / F.sum("weight").over(at), "rank": F.row_number().over(at.orderBy(F.desc("weight"), choice)).cast("long")})
