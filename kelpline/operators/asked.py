"""What a query asks: questions cut to what they are about, facts that are asked for, and spellings of houses put right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import computed, unused
from .repair import KINDS, SIGNS, meaningful, normalized_query

#: Words that open a question, and those after which it is no longer about a fragrance's identity.
OPENERS = ("does", "do", "did", "is", "are", "was", "were", "can", "could", "should", "would", "will", "what", "which", "why", "how", "where", "when")
INTENTS = ("smell", "smells", "smelling", "last", "lasting", "perform", "performs", "performance", "project", "projects", "projection", "worth", "compliment", "compliments")
#: Words from which on a suggestion is cut, and volumes that end one.
CUTS = (
    "which", "what", "who", "where", "when", "why", "how", "best", "better", "top", "list", "rank", "ranks", "ranked", "ranking", "rankings", "compare",
    "comparison", "vs", "versus", "similar", "smells like", "review", "reviews", "rating", "ratings", "rated", "description", "descriptions", "overview",
    "summary", "details", "info", "information", "profile", "notes", "accords", "ingredients", "pyramid", "longevity", "sillage", "projection", "season",
    "seasons", "weather", "occasion", "occasions", "price", "prices", "pricing", "buy", "sale", "sell", "shop", "shopping", "discount", "coupon",
    "coupons", "deal", "deals", "sample", "samples", "decant", "decants", "tester", "amazon", "walmart", "ebay", "etsy", "sephora", "ulta", "macys",
    "macy's", "nordstrom", "fragrancenet", "fragrancex", "microperfumes", "scentbird", "scentbox", "reddit", "tiktok", "youtube", "facebook",
    "instagram", "pinterest", "twitter", "fragrantica", "basenotes", "parfumo", "wikipedia", "search", "result", "results", "image", "images", "video",
    "videos", "news", "map", "maps", "cached", "cache", "translate", "translation", "login", "sign in", "official site", "dupe", "dupes", "clone",
    "clones", "alternative", "alternatives",
)
VOLUME = r"(?i)\b\d[\d.,]*\s*(?:ml|mls|oz|fl\.?\s*oz|ounces?)\b.*$"
#: Spellings of houses and what they are, and phrases of a concentration.
HOUSES = {
    "initio": "Initio Parfums Privés", "initio parfums": "Initio Parfums Privés", "penhaligons": "Penhaligon's", "lataffa": "Lattafa", "lattafa perfumes": "Lattafa",
    "pull bear": "Pull&Bear", "pull and bear": "Pull&Bear", "d s and durga": "D.S. & Durga", "d s durga": "D.S. & Durga", "ds durga": "D.S. & Durga",
    "maitre parfumeur et gantier": "Maitre Parfumeur et Gantier", "le jardin retrouve": "Le Jardin Retrouvé", "victorias secret": "Victoria's Secret",
    "bath and body works": "Bath & Body Works", "body shop": "The Body Shop", "the body shop": "The Body Shop",
}
CONCENTRATIONS = r"(?i)\b(?:eau\s+de\s+parfum(?:\s+intense)?|eau\s+de\s+toilette(?:\s+intense)?|eau\s+de\s+cologne|eau\s+fraiche|extrait\s+de\s+parfum|esprit\s+de\s+parfum|parfum\s+de\s+toilette|elixir\s+de\s+parfum|edp|edt|edc)\b"
#: Facts that are asked for, and their names in questions.
FACTS = {
    "concentration": ("concentration", "strength"), "year": ("release year", "launch year", "released", "year"),
    "family": ("fragrance family", "scent family", "olfactive family", "family"), "gender": ("gender", "marketed gender", "target gender"),
}
_NAMES = "|".join(sorted((a for names in FACTS.values() for a in names), key=len, reverse=True))
QUESTIONS = (
    rf"(?i)^(?:what(?:'s| is)?|whats|tell me|show me|find|grab|get|give me)?\s*(?:the\s+)?(?<alias>{_NAMES})\s+(?:for|of|on|in)\s+(?<target>.+)$",
    rf"(?i)^(?:what(?:'s| is)?|whats)\s+(?:the\s+)?(?<alias>{_NAMES})\s+(?:for|of|on|in)?\s*(?<target>.+)$",
    rf"(?i)^(?<target>.+?)\s+(?<alias>{_NAMES})$",
)


def _one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_suggestion(cleaned: Column) -> Column:
    """SF21: a cleaned suggestion without tags, a search page's words around it, volumes, what follows a word that ends it, and signs."""
    text = F.regexp_replace(F.regexp_replace(cleaned, "(?i)<[^>]+>", " "), r"(?i)^(?:showing results for|search instead for|did you mean:?|including results for)\s*", "")
    text = F.regexp_replace(text, r"(?i)\b(?:search instead for|showing results for|including results for|search only for)\b.*$", "")
    text = F.regexp_replace(F.regexp_replace(text, VOLUME, ""), rf"(?i)\b(?:{'|'.join(CUTS)})\b.*$", "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, KINDS, " "), SIGNS, " "), r"\s+[-–—/]\s*$", "")
    return _one_space(F.regexp_replace(text, r"^[ \-–—/\t\n\r]+|[ \-–—/\t\n\r]+$", ""))


def with_question_cut(rows: DataFrame, query: str, out: str = "about") -> DataFrame:
    """SF21: rows plus what a question is about: without its opener and its intent; empty for others, and where fewer than two words that name something are left."""
    own = X.with_clean(unused(rows, out), {"__q": F.col(query)})
    own = computed(own, {"__o": normalized_query(F.col("__q"))}).drop("__q", "__q_n")
    opener = rf"(?i)^(?:{'|'.join(OPENERS)})\s+"
    cut = F.regexp_replace(F.regexp_replace("__o", opener, ""), rf"(?i)\b(?:{'|'.join(INTENTS)})\b.*$", "")
    own = X.with_clean(computed(own, {"__cut": clean_suggestion(cut)}), {"__a": F.col("__o"), "__b": F.col("__cut")})
    asks = F.get(F.split("__a_n", " "), F.lit(0)).isin(*OPENERS)
    good = asks & (F.size(meaningful(F.col("__b_n"))) >= 2) & (F.col("__a_n") != F.col("__b_n"))
    return own.select(*rows.columns, F.when(good, normalized_query(F.col("__cut"))).otherwise("").alias(out))


def house_aliases(query: Column) -> Column:
    """SF24: a query with known spellings of houses as the houses are spelt, longest first; one that has the right spelling already stays."""
    for key, house in sorted(HOUSES.items(), key=lambda kv: -len(kv[0])):
        pattern = r"(?i)\b" + r"\s+".join(key.split()) + r"\b"
        query = F.when(F.contains(F.lower(query), F.lit(house.lower())), query).otherwise(F.regexp_replace(query, pattern, house))
    return query


def unconcentrated(text: Column) -> Column:
    """SF24: a text without phrases of a concentration; as it is where nothing would be left."""
    left = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(text, CONCENTRATIONS, " "), r"\s+", " ")), "^[ \\-–—|:]+|[ \\-–—|:]+$", "")
    return F.when(left != "", left).otherwise(text)


def without_repeats(text: Column) -> Column:
    """SF24: a text's words, each once whatever its case, where it stands first."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.filter(words, lambda w, i: ~F.exists(F.slice(words, 1, i), lambda x: F.lower(x) == F.lower(w))), " ")


def with_search_text(rows: DataFrame, query: str, out: str = "search_text") -> DataFrame:
    """SF24: rows plus their query as it is searched: houses, concentrations and repeats put right; empty for a blank one."""
    own = computed(unused(rows, out), {"__s": _one_space(F.coalesce(F.col(query), F.lit("")))})
    for key, house in sorted(HOUSES.items(), key=lambda kv: -len(kv[0])):
        pattern = r"(?i)\b" + r"\s+".join(key.split()) + r"\b"
        own = computed(own.withColumnRenamed("__s", "__t"), {"__s": F.when(F.contains(F.lower("__t"), F.lit(house.lower())), F.col("__t")).otherwise(F.regexp_replace("__t", pattern, house))}).drop("__t")
    own = computed(own, {"__u": unconcentrated(F.col("__s"))})
    return own.select(*rows.columns, F.when(F.col("__s") == "", "").otherwise(without_repeats(F.col("__u"))).alias(out))


def apostrophes(name: Column) -> Column:
    """SF24: a name with the apostrophes that imports lost after d and l ("Dhermes"); empty where no word looks so."""
    garbled = "(?i)^([dl])([aeiouh][a-z]+)$"
    fits = lambda w: w.rlike(garbled) & (F.length(w) >= 4)
    words = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    put = lambda w: F.concat(F.lower(F.substring(w, 1, 1)), F.lit("'"), F.upper(F.substring(w, 2, 1)), F.substr(w, F.lit(3)))
    return F.when(F.exists(words, fits), F.array_join(F.transform(words, lambda w: F.when(fits(w), put(w)).otherwise(w)), " ")).otherwise("")


def with_fact_question(rows: DataFrame, query: str) -> DataFrame:
    """SF25: rows plus field, label and target of a query that asks for a fact of a fragrance; nulls for others.

    Three forms are tried in order: the fact "of" or "for" something, a question without that, and a fact at the end. A plain
    "year of the" is a name, not a question; what is left must be something, and not the whole query.
    """
    field_of = F.create_map(*[F.lit(x) for field, names in FACTS.items() for a in names for x in (a, field)])
    start = unused(rows, "field", "label", "target")
    raw = F.trim(F.coalesce(F.col(query), F.lit("")))
    own = computed(start, {"__raw": raw, "__text": F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), "^[ ?!.]+|[ ?!.]+$", "")})
    order = ((1, 2), (1, 2), (2, 1))  # groups of name and target in each form

    def target(k: int) -> Column:
        text = F.regexp_replace(_one_space(F.regexp_extract("__text", QUESTIONS[k], order[k][1])), "^[ ?!.]+|[ ?!.]+$", "")
        return F.trim(F.regexp_replace(text, r"(?i)^(?:is|are|the|a|an)\s+", ""))

    own = computed(own, {**{f"__a{k}": F.regexp_extract("__text", QUESTIONS[k], order[k][0]) for k in range(3)}, **{f"__t{k}": target(k) for k in range(3)}})
    texts = ("__raw", "__t0", "__t1", "__t2")
    own = X.with_clean(own, {f"{c}c": F.col(c) for c in texts})
    own = computed(own, {f"{c}q": normalized_query(F.col(f"{c}c")) for c in texts}).drop(*[f"{c}c{end}" for c in texts for end in ("", "_n")])
    own = X.with_clean(own, {f"{c}i": F.col(f"{c}q") for c in texts})
    asks = F.col("__text").rlike(r"(?i)^(?:what|whats|what's|tell|show|find|grab|get|give)\b")
    named = F.col("__text").rlike(r"(?i)^(?:release\s+|launch\s+)?year\s+(?:of|for|in)\b")
    found = None
    for k in range(3):
        field = F.try_element_at(field_of, F.lower(f"__a{k}"))
        good = field.isNotNull() & (F.col(f"__t{k}") != "") & ~((field == "year") & ~asks & named) & (F.col(f"__t{k}i_n") != F.col("__rawi_n"))
        made = F.struct(field.alias("field"), F.col(f"__a{k}").alias("label"), F.col(f"__t{k}").alias("target"))
        found = F.when(good, made) if found is None else found.when(good, made)
    own = computed(own, {"__found": found}).withColumns({c: F.col("__found")[c] for c in ("field", "label", "target")})
    return own.select(*rows.columns, "field", "label", "target")
