"""Which facts of a record are missing, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import computed, unused
from . import predicates as P

#: A record's facts in the order that they are reported in, texts that stand for a missing one, those that do so in one field, and facts that the metrics' coverage says.
FACTS = ("name", "house", "year", "gender", "concentration", "family", "main_accords", "wear_profile", "performance_score", "value_score", "community_interest_score", "notes", "reviews")
BLANK = ("", "unknown", "n/a", "none", "null")
DEFAULTS = {"gender": ("unisex / unspecified",), "family": ("unknown family",), "season": ("universal",)}
COVERED = ("performance_score", "value_score", "community_interest_score")
#: The family that an accord belongs to.
FAMILIES = {
    "aldehydic": "Floral", "amber": "Amber", "ambery": "Amber", "animalic": "Musk", "aquatic": "Aquatic", "aromatic": "Aromatic", "balsamic": "Amber",
    "cacao": "Gourmand", "caramel": "Gourmand", "cherry": "Fruity", "chocolate": "Gourmand", "cinnamon": "Spicy", "citrus": "Citrus", "coffee": "Gourmand",
    "earthy": "Woody", "floral": "Floral", "fresh": "Fresh", "fresh spicy": "Spicy", "fruity": "Fruity", "green": "Green", "honey": "Gourmand",
    "iris": "Floral", "lactonic": "Gourmand", "lavender": "Aromatic", "leather": "Leather", "marine": "Aquatic", "mossy": "Chypre", "musky": "Musk",
    "oud": "Woody", "patchouli": "Chypre", "powdery": "Musk", "rose": "Floral", "rum": "Gourmand", "smoky": "Woody", "soft spicy": "Spicy",
    "spicy": "Spicy", "sweet": "Gourmand", "tobacco": "Amber", "tuberose": "Floral", "vanilla": "Gourmand", "warm spicy": "Spicy",
    "white floral": "Floral", "woody": "Woody", "yellow floral": "Floral",
}
_LAYERS = ("top", "heart", "base", "flat")
_NOTES = f"struct<{','.join(f'{k}:array<string>' for k in _LAYERS)}>"
RAW = f"concentration string, raw_identity struct<gender:string,concentration:string>, notes {_NOTES}, reviews array<struct<text:string>>"
METRICS = f"main_accords struct<top_accords:array<string>,scent_vector:array<struct<accord:string,score:double>>>, wear_profile struct<primary_seasons:array<string>,primary_time:string>, source_coverage struct<{','.join(f'{k}:boolean' for k in COVERED)}>"


def complete(value: Column, field: str = "") -> Column:
    """PF6: whether a scalar is a real fact of a field; false for a null."""
    return F.coalesce(~F.lower(F.trim(value.cast("string"))).isin(*BLANK, *DEFAULTS.get(field, ())), F.lit(False))


def any_complete(values: Column, field: str = "") -> Column:
    """PF6 of an array, or of map_values() of a map: whether one of its texts is a real fact."""
    return F.coalesce(F.exists(values, lambda x: complete(x, field)), F.lit(False))


def families_of(accords: Column) -> Column:
    """SF35: struct of primary_family, families (in the order of the accords, each once), and confidence of the mapping (null without a family)."""
    table = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    found = F.array_distinct(F.array_compact(F.transform(accords, lambda a: F.try_element_at(table, F.lower(F.trim(a))))))
    return F.struct(F.get(found, F.lit(0)).alias("primary_family"), found.alias("families"), F.when(F.size(found) > 0, 85).alias("confidence"))


def with_fact_status(rows: DataFrame, fields: dict[str, str], out: str = "facts") -> DataFrame:
    """SC16: rows plus a struct of the 13 facts of a stored record, whether each is complete, and absent, the names of those that aren't.

    fields names the columns of name, house, year, gender, and of the JSON texts fg_raw, bn_raw and derived_metrics. Broken
    and null texts have nothing. The family is what the accords map to; accords are the top ones, else the vector's by score.
    """
    unused(rows, out, "absent")
    own = rows.withColumns({"__fg": F.from_json(fields["fg_raw"], RAW), "__bn": F.from_json(fields["bn_raw"], RAW), "__m": F.from_json(fields["derived_metrics"], METRICS)})
    taken = {
        "__conc": F.coalesce(F.nullif(F.col("__fg.concentration"), F.lit("")), F.col("__fg.raw_identity.concentration")), "__sex": F.col("__fg.raw_identity.gender"), "__top": F.col("__m.main_accords.top_accords"),
        "__vector": F.col("__m.main_accords.scent_vector"), "__seasons": F.col("__m.wear_profile.primary_seasons"), "__time": F.col("__m.wear_profile.primary_time"),
        **{f"__c_{k}": F.col(f"__m.source_coverage.{k}") for k in COVERED}, **{f"__{s}_{k}": F.col(f"__{s}.notes.{k}") for s in ("fg", "bn") for k in _LAYERS}, **{f"__{s}_r": F.col(f"__{s}.reviews") for s in ("fg", "bn")},
    }
    own = own.withColumns(taken).drop("__fg", "__bn", "__m")
    by_score = F.transform(F.array_sort(F.transform("__vector", lambda x, i: F.struct((-F.coalesce(x["score"], F.lit(0.0))).alias("o"), i.alias("i"), x["accord"].alias("a")))), lambda x: x["a"])
    own = computed(own, {"__all": F.coalesce("__top", by_score, F.array().cast("array<string>"))})
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    own = computed(own, {"__accords": F.filter(F.transform("__all", lambda a: F.trim(F.coalesce(a, F.lit("")))), lambda a: (a != "") & ~P.junk_accord(a, folds=plain))})
    some = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    said = lambda c: F.coalesce(F.exists(F.col(c), lambda r: F.trim(F.coalesce(r["text"], F.lit(""))) != ""), F.lit(False))
    either = lambda conditions: conditions[0] if len(conditions) == 1 else conditions[0] | either(conditions[1:])
    status = {
        "name": complete(F.col(fields["name"])), "house": complete(F.col(fields["house"])), "year": complete(F.col(fields["year"])),
        "gender": complete(F.col(fields["gender"]), "gender") | complete(F.col("__sex"), "gender"), "concentration": complete(F.col("__conc")),
        "family": F.coalesce(families_of(F.col("__accords"))["primary_family"].isNotNull(), F.lit(False)), "main_accords": F.size("__accords") > 0,
        "wear_profile": any_complete(F.col("__seasons"), "season") | complete(F.col("__time"), "season"), **{k: F.coalesce(F.col(f"__c_{k}"), F.lit(False)) for k in COVERED},
        "notes": either([some(f"__{s}_{k}") for s in ("fg", "bn") for k in _LAYERS]), "reviews": said("__fg_r") | said("__bn_r"),
    }
    own = computed(own, {f"__is_{k}": status[k] for k in FACTS})
    absent = missing({k: F.col(f"__is_{k}") for k in FACTS})
    return own.select(*rows.columns, F.struct(*[F.col(f"__is_{k}").alias(k) for k in FACTS]).alias(out), absent.alias("absent"))


def missing(facts: dict[str, Column]) -> Column:
    """SC16: ordered names of the facts that aren't complete; facts maps names to booleans."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in facts.items()]))


def missing_counts(rows: DataFrame, column: str = "missing") -> DataFrame:
    """AG4: how many rows miss each fact."""
    return rows.select(F.explode(column).alias("fact")).groupBy("fact").agg(F.count("*").alias("n"))


def actionable(absent: Column, unsuppliable: Column) -> Column:
    """SO4: what is missing without what no source can supply; the order stays."""
    return F.filter(absent, lambda x: ~F.array_contains(unsuppliable, x))


def heal_decision(*, status: Column, absent: Column, can_heal: Column, has_page: Column, stale: Column, attempts: Column, most: int = 10) -> Column:
    """SC19: queue, or the first reason not to."""
    return (
        F.when(F.size(absent) == 0, "skip_complete")
        .when(status == "ignored", "skip_ignored")
        .when(status.isin("pending", "processing"), "skip_live")
        .when(attempts >= most, "skip_exhausted")
        .when(F.size(F.array_intersect(absent, can_heal)) == 0, "skip_unsuppliable")
        .when(~has_page & ~stale, "skip_no_page")
        .otherwise("queue")
    )


def families(accords: Column, table: dict[str, str]) -> Column:
    """SF34, SF35: accords split on hyphens, commas and slashes, and the families they belong to, in order, once each."""
    mapping = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    parts = F.flatten(F.transform(accords, lambda a: F.split(F.lower(a), r"\s*[-,/]\s*")))
    return F.array_distinct(F.array_compact(F.transform(parts, lambda a: mapping[F.trim(a)])))


def record_scalars(fields: dict[str, Column]) -> Column:
    """SC12: struct of concentration, year, gender and image_url of a stored record: the column where it says a real one, else the JSON
    text fg_raw, its raw_identity first for images. fields has year, gender, image_url and fg_raw; nulls where none is real."""
    of = lambda path: F.get_json_object(fields["fg_raw"], f"$.{path}")
    first = lambda field, *values: F.coalesce(*[F.when(complete(v, field), F.trim(v)) for v in values])
    address = lambda *values: F.coalesce(*[F.when(F.trim(v).rlike("^https?://"), F.trim(v)) for v in values])
    stated = lambda v: F.when((F.trim(v) != "") & (F.lower(F.trim(v)) != "unknown"), F.trim(v))
    images = [of(p) for p in ("raw_identity.image_url", "raw_identity.imageUrl", "image_url", "imageUrl")]
    return F.struct(
        F.coalesce(stated(of("concentration")), stated(of("raw_identity.concentration"))).alias("concentration"), first("year", fields["year"].cast("string"), of("raw_identity.year")).alias("year"),
        first("gender", fields["gender"], of("raw_identity.gender")).alias("gender"), address(fields["image_url"], *images).alias("image_url"),
    )
