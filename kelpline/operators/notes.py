"""Notes of a pyramid: one name for one note, each in the first layer that has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Layers in the order that keeps a note, and the levels that a product's notes name.
LAYERS = ("top", "heart", "base", "flat")
LEVELS = {"top": "top", "head": "top", "middle": "heart", "heart": "heart", "base": "base", "drydown": "base"}
#: What parts two names of one note, and signs that no note has.
OR = r"(?i)\s+or\s+|\s+/\s+"
SIGNS = r"[.™®©℠℗•·¶§⁃◦]"
#: Other names of a note, and words at the ends of its name that make it no other note: where it comes from, how it was made, and fillers.
SYNONYMS = {
    "cedarwood": "cedar", "cedar wood": "cedar", "agarwood": "oud", "agar wood": "oud", "oudh": "oud", "aoud": "oud", "oud wood": "oud",
    "guaiacwood": "guaiac wood", "gaiac wood": "guaiac wood", "gaiacwood": "guaiac wood", "guaiac": "guaiac wood", "santal": "sandalwood",
    "olibanum": "frankincense", "patchouly": "patchouli", "vetivert": "vetiver", "mandarine": "mandarin", "ylangylang": "ylang ylang",
    "ylang": "ylang ylang", "ambrox": "ambroxan", "ambroxide": "ambroxan", "iso e": "iso e super", "isoe super": "iso e super",
    "muguet": "lily of the valley", "helichrysum": "immortelle", "everlasting flower": "immortelle", "orris root": "orris", "iris root": "iris",
    "tonka bean": "tonka", "tonka beans": "tonka", "vanilla bean": "vanilla", "vanilla beans": "vanilla", "ambrette seed": "ambrette",
    "ambrette seeds": "ambrette",
}
QUALIFIERS = (
    "madagascar", "madagascan", "papua", "guinea", "guinean", "new", "indonesian", "indonesia", "tahitian", "tahiti", "sicilian", "sicily",
    "calabrian", "calabria", "italian", "egyptian", "bulgarian", "turkish", "moroccan", "morocco", "haitian", "brazilian", "australian", "russian",
    "somalian", "somali", "ethiopian", "virginian", "virginia", "mysore", "ceylon", "javanese", "java", "bourbon", "reunion", "florida", "indian",
    "india", "chinese", "china", "japanese", "japan", "vietnamese", "vietnam", "cambodian", "cambodia", "thai", "thailand", "sri", "lankan", "lanka",
    "burmese", "spanish", "spain", "french", "greek", "portuguese", "tunisian", "algerian", "lebanese", "syrian", "iranian", "persian", "arabian",
    "corsican", "corsica", "mexican", "peruvian", "guatemalan", "kenyan", "comorian", "comoros", "balkan", "absolute", "essence", "extract", "oil",
    "co2", "infusion", "tincture", "resinoid", "resin", "concrete", "isolate", "accord", "note", "notes", "natural", "synthetic", "type", "scent",
)


def pieces(note: Column) -> Column:
    """A note's names: "X or Y" and "X / Y" are two where both have two letters, else it is one."""
    parts = F.filter(F.transform(F.split(note, OR), F.trim), lambda p: F.length(p) > 1)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(note))


def shown(note: Column) -> Column:
    """A note as it is shown: without signs and dangling punctuation."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(note, SIGNS, ""), r"\s+", " "))
    return F.regexp_replace(plain, r"^[ \-–—,;:]+|[ \-–—,;:]+$", "")


def _unqualified(identity: Column, qualifiers: tuple[str, ...]) -> Column:
    """identity without qualifying words at its start and end."""
    words = F.filter(F.split(identity, " "), lambda w: w != "")
    plain = F.transform(words, lambda w, i: F.when(~w.isin(*qualifiers), i))
    first, last = F.array_min(F.array_compact(plain)), F.array_max(F.array_compact(plain))
    return F.when(first.isNull(), "").otherwise(F.array_join(F.slice(words, first + 1, last - first + 1), " "))


def _synonym(synonyms: dict[str, str]) -> Callable[[Column], Column]:
    table = F.create_map(*[F.lit(x) for kv in (synonyms or {"": ""}).items() for x in kv])
    return lambda x: F.coalesce(F.try_element_at(table, x), x)


def _named(rows: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """rows plus __text, __raw without what says it twice: "outer (inner)" where both are synonyms."""
    named = _synonym(synonyms)
    outer = F.trim(F.regexp_extract("__raw", r"^(.*?)\s*\(([^()]+)\)\s*$", 1))
    inner = F.trim(F.regexp_extract("__raw", r"^(.*?)\s*\(([^()]+)\)\s*$", 2))
    rows = rows.withColumns({"__o": outer, "__i": inner}).withColumns({"__on": X.normalize_identity("__o"), "__in": X.normalize_identity("__i")})
    same = (F.col("__o") != "") & (F.col("__i") != "") & (named(F.col("__on")) != "") & (named(F.col("__on")) == named(F.col("__in")))
    plain_side = F.when(F.col("__in") == named(F.col("__on")), F.col("__i")).when(F.col("__on") == named(F.col("__on")), F.col("__o")).otherwise(F.col("__i"))
    return rows.withColumn("__text", F.when(same, plain_side).otherwise(F.col("__raw")))


def deduped(notes: DataFrame, key: str, layer: str, position: str, note: str, synonyms: dict[str, str] = SYNONYMS, qualifiers: tuple[str, ...] = QUALIFIERS) -> DataFrame:
    """AG32: the notes of each record, one row a note, with the layer that keeps it, its place there and how it is shown.

    notes has a row for each note: key, layer (0 is first), position and note. Names that are synonyms are one note; one
    that qualifies another, or its plural, is folded onto it only where the record has that other (or two that qualify it).
    The plain name is shown where it occurs, else the shortest. A record's notes meet by its key, which none has many of.
    """
    named = _synonym(synonyms)
    rows = _named(notes.select(key, layer, position, F.posexplode(pieces(F.col(note))).alias("__k", "__raw")), synonyms)
    rows = rows.withColumn("__norm", X.normalize_identity("__text")).withColumn("__id", named(F.col("__norm")))
    rows = rows.withColumn("__core", named(_unqualified(F.col("__id"), qualifiers)))
    of = W.partitionBy(key)
    rows = rows.withColumn("__all", F.collect_set(F.col("__id")).over(of))
    rows = rows.withColumn("__folded", F.collect_set(F.when((F.col("__core") != "") & (F.col("__core") != F.col("__id")), F.struct(F.col("__core").alias("core"), F.col("__id").alias("id")))).over(of))
    shares = F.size(F.filter("__folded", lambda x: x["core"] == F.col("__core"))) >= 2
    onto_core = (F.col("__core") != "") & (F.col("__core") != F.col("__id")) & (F.array_contains(F.col("__all"), F.col("__core")) | shares)
    one = F.regexp_replace("__id", "s$", "")
    plural = (F.length("__id") > 4) & F.endswith("__id", F.lit("s")) & F.array_contains(F.col("__all"), one)
    rows = rows.withColumn("__key", F.when(onto_core, F.col("__core")).when(plural, named(one)).otherwise(F.col("__id")))
    rows = rows.withColumn("__shown", shown(X.clean("__text"))).where("__key <> '' and __shown <> ''")
    place = F.struct(layer, position, "__k")
    best = F.struct((F.col("__norm") != F.col("__key")).alias("other"), F.length("__shown").alias("size"), F.col(layer), F.col(position), F.col("__k"))
    found = rows.groupBy(key, "__key").agg(F.min(place).alias("p"), F.min_by("__shown", best).alias("note"))
    return found.select(key, F.col(f"p.{layer}").alias(layer), F.row_number().over(W.partitionBy(key, f"p.{layer}").orderBy("p")).alias("place"), "note")


def tokens_cleaned(notes: DataFrame, key: str, layer: str, position: str, note: str, synonyms: dict[str, str] = SYNONYMS) -> DataFrame:
    """SC15: each layer's notes on their own: names joined by "or" parted, a synonym in brackets folded, signs gone, each once (the first).

    Rows as for deduped(), but nothing is folded across layers or onto plainer names. Blank notes go.
    """
    rows = _named(notes.select(key, layer, position, F.posexplode(pieces(F.col(note))).alias("__k", "__raw")), synonyms)
    rows = X.with_clean(rows, {"__c": F.col("__text")}).withColumn("__shown", shown(F.col("__c")))
    rows = X.with_clean(rows.drop("__c", "__c_n"), {"__s": F.col("__shown")}).where("__s_n <> '' and __shown <> ''")
    first = rows.groupBy(key, layer, "__s_n").agg(F.min(F.struct(position, "__k", "__shown")).alias("f"))
    return first.select(key, layer, F.row_number().over(W.partitionBy(key, layer).orderBy("f")).alias("place"), F.col("f.__shown").alias("note"))


def from_product(notes: Column) -> Column:
    """SC13: struct of the four layers from a product's notes (name, pyramidLevel): those without a known level are flat."""
    level = lambda x: F.try_element_at(F.create_map(*[F.lit(v) for kv in LEVELS.items() for v in kv]), F.lower(F.trim(F.coalesce(x["pyramidLevel"], F.lit("")))))
    named = F.filter(notes, lambda x: F.trim(F.coalesce(x["name"], F.lit(""))) != "")
    layer = lambda k: F.array_distinct(F.transform(F.filter(named, lambda x: F.coalesce(level(x), F.lit("flat")) == k), lambda x: F.trim(x["name"])))
    return F.struct(*[layer(k).alias(k) for k in LAYERS])
