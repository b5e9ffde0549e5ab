"""Data-quality audit: issue tags, duplicates, histograms and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import computed, unused
from ..functions.text import audit_key
from . import predicates as P


# What a stored row may say, and marks of a broken encoding.
CONCENTRATIONS = (
    "Eau de Cologne", "Eau Fraiche", "Eau de Toilette", "Eau de Parfum", "Parfum", "Extrait", "Elixir", "Aftershave",
    "Body Spray", "Body Mist", "Perfume Oil", "Soie de Parfum",
)
GENDERS = ("Masculine", "Feminine", "Unisex")
FAMILY_WORDS = (
    "Floral", "Amber", "Woody", "Fresh", "Aromatic", "Citrus", "Chypre", "Fougere", "Gourmand", "Leather", "Aquatic", "Green",
    "Fruity", "Spicy", "Musk", "Powdery", "Sweet", "Animalic", "Smoky", "Balsamic", "Mossy", "Conifer", "Marine", "Earthy", "White", "Oriental",
)
DEPRECATED_FAMILIES = ("oriental",)
MOJIBAKE = ("\ufffd", "Ã", "Â", "â€", "ðŸ")
#: Words of a page that get into the texts of its reviews.
INTERFACE = r"\b(?:show all reviews|reply|like|dislike|report)\b"


def tags(rules: dict[str, Column]) -> Column:
    """SF30: names of the rules that hold (a null doesn't), in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def identity_rules(name: Column, brand: Column) -> dict[str, Column]:
    """The rules of SF30 on name and brand."""
    n, b = F.coalesce(F.trim(name), F.lit("")), F.coalesce(F.trim(brand), F.lit(""))
    parts = F.array_remove(F.array_distinct(F.transform(F.split(F.lower(n), "[|]"), F.trim)), "")
    both = F.concat_ws(" ", b, n)
    return {
        "brand_missing": b == "",
        "name_missing": n == "",
        "identity_mojibake": F.exists(F.array(*[F.lit(m) for m in MOJIBAKE]), lambda m: F.contains(both, m)),
        "name_equals_brand": (n != "") & (b != "") & (F.lower(n) == F.lower(b)),
        "name_self_dup": F.contains(n, F.lit("|")) & (F.size(parts) == 1),
        "name_has_year": F.regexp_like(n, F.lit(r"\b(19|20)\d{2}\b")),
    }


def row_rules(row: dict[str, Column], today: Column | None = None) -> dict[str, Column]:
    """The 23 rules of SF30 on a stored row that is an object, in the order that they are reported in; with_blob_tags() has the 24th.

    row has brand (or, where that is blank, house), name, source_url, accords (array of strings), family, concentration, gender and year (text); a year is a
    number as text where year_is_text says so. today is the date that years are held against (the present one if not given).
    """
    blank = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*P.NO_FAMILY)
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    brand = F.coalesce(F.nullif(F.trim(row["brand"]), F.lit("")), row["house"]) if "house" in row else row["brand"]
    own = identity_rules(row["name"], brand)
    url, accords, family = said(row["source_url"]), row["accords"], row["family"]
    good = F.filter(accords, lambda a: ~P.accord_junk(a))
    low = F.lower(F.trim(family))
    unknown, deprecated, typo = blank(family), low.isin(*DEPRECATED_FAMILIES), low.isin(*P.FAMILY_TYPOS)
    words = F.filter(F.split(F.trim(family), r"\s+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    year = F.trim(row["year"]).try_cast("int")
    latest = F.year(F.current_date() if today is None else today) + 1
    return {
        **{k: own[k] for k in ("brand_missing", "name_missing", "identity_mojibake")},
        "source_url_malformed": (url != "") & ~url.rlike(r"^(?i:https?)://[^/?#]+"),
        "accord_junk": F.size(good) < F.size(accords),
        "accord_case": F.exists(good, lambda a: a != P.accord_title(a)),
        "accords_empty": F.size(accords) == 0,
        "single_accord": (F.size(accords) > 0) & (F.size(good) == 1),
        "accords_missing": accords.isNull(),
        "family_unknown": unknown,
        "family_deprecated": ~unknown & deprecated,
        "family_typo": ~unknown & ~deprecated & typo,
        "family_case": ~unknown & ~deprecated & ~typo & (family != P.family_cleaned(family)),
        "family_unexpected": ~unknown & F.exists(words, lambda w: ~capital(w).isin(*FAMILY_WORDS)),
        "concentration_unknown": blank(row["concentration"]),
        "concentration_unexpected": ~blank(row["concentration"]) & ~said(row["concentration"]).isin(*CONCENTRATIONS),
        "gender_missing": blank(row["gender"]),
        "gender_unexpected": ~blank(row["gender"]) & ~said(row["gender"]).isin(*GENDERS),
        "year_string": row["year_is_text"] & F.trim(row["year"]).rlike(r"^\d+$"),
        "year_range": (year < 1800) | (year > latest),
        **{k: own[k] for k in ("name_equals_brand", "name_self_dup", "name_has_year")},
    }


BLOB = "name string, brand string, house string, source_url string, accords array<string>, family string, concentration string, gender string, year string"


def with_blob_tags(rows: DataFrame, blob: str, out: str = "tags", today: Column | None = None) -> DataFrame:
    """SF30: rows plus the tags of a stored row as JSON text, in order: bad_blob alone where it is no object, else those of row_rules(). The text is read once."""
    own = computed(unused(rows, out), {"__kind": F.schema_of_variant(F.try_parse_json(blob)), "__quoted": F.schema_of_variant(F.try_variant_get(F.try_parse_json(blob), "$.year", "variant")) == "STRING", "__year": F.get_json_object(blob, "$.year")})
    own = own.withColumn("__read", F.from_json(blob, BLOB))
    fields = ("name", "brand", "house", "source_url", "accords", "family", "concentration", "gender")
    own = own.withColumns({f"__{k}": F.col("__read")[k] for k in fields}).drop("__read")
    own = computed(own, {f"__f_{k}": F.col(f"__{k}") for k in fields})
    row = {k: F.col(f"__f_{k}") for k in fields} | {"year": F.col("__year"), "year_is_text": F.coalesce("__quoted", F.lit(False))}
    found = F.when(F.startswith("__kind", F.lit("OBJECT")), tags(row_rules(row, today))).otherwise(F.array(F.lit("bad_blob")))
    return own.select(*rows.columns, found.alias(out))


def review_copies(rows: DataFrame, scope: list[str], text: str, row_id: str, width: int | None = None, least: int = 30) -> DataFrame:
    """AG33: the first row and the number of each group of reviews that say the same; those of fewer than `least` characters go.

    Words of the page's interface don't count. width, for short reviews, compares that many characters alone; the whole text if not given.
    """
    key = F.trim(F.regexp_replace(F.regexp_replace(audit_key(F.col(text)), INTERFACE, " "), " +", " "))
    key = key if width is None else F.substring(key, 1, width)
    keyed = rows.select(*scope, row_id, key.alias("__k")).where(F.length("__k") >= least)
    return keyed.groupBy(*scope, F.sha2("__k", 256).alias("__h")).agg(F.min(row_id).alias(row_id), F.count("*").alias("copies")).drop("__h")


def histogram(rows: DataFrame, column: str = "issues") -> DataFrame:
    """AG6: how many rows carry each tag."""
    return rows.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def duplicates(rows: DataFrame, scope: list[str], text: str, row_id: str) -> DataFrame:
    """AG34: row ids whose text has the same key as another row's of their scope, with the copies' number.

    Keys are hashed before they are counted: partial counts make a hot group one row a task, and only the
    groups that have copies are joined back.
    """
    keyed = rows.select(*scope, row_id, F.sha2(audit_key(F.col(text)), 256).alias("key"))
    groups = keyed.groupBy(*scope, "key").agg(F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(groups, [*scope, "key"]).select(row_id, "copies")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """J20, SO5: for each tag of two tables (tag, row_id) how many rows are resolved, new and persistent."""
    sides = before.distinct().withColumn("old", F.lit(1)).join(after.distinct().withColumn("new", F.lit(1)), ["tag", "row_id"], "full_outer")
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return sides.groupBy("tag").agg(count(F.col("new").isNull(), "resolved"), count(F.col("old").isNull(), "added"), count(F.col("old").isNotNull() & F.col("new").isNotNull(), "persistent"))


def zero_filled(counts: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """AG1: a count for every value of a fixed domain."""
    values = counts.sparkSession.createDataFrame([(v,) for v in domain], f"{key} string")
    return values.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
