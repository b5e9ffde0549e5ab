"""Identities that are spelt in several ways: keys that bridge them, and names and houses read from addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions.steps import computed
from . import identity
from . import predicates as P

#: Words of a house that tell no house from another, spellings of a number, labels of gender that stand before a name (longest first), and how well a prefix must be covered by the house.
GENERIC = ("perfume", "perfumes", "parfum", "parfums", "fragrance", "fragrances", "beauty", "cosmetics", "industries", "industry", "llc", "ltd", "inc")
NUMBER = r"(?i)\bn(?:o|[°º]|umber)?\.?\s*(\d+)\b"
LABELS = (("pour homme", "Men"), ("pour femme", "Women"), ("for men", "Men"), ("for women", "Women"), ("for him", "Men"), ("for her", "Women"), ("homme", "Men"), ("femme", "Women"))
PREFIX_COVERED = 0.82


def plain_key(brand: Column, name: Column) -> Column:
    """SF29: letters and digits of a brand and a name, in lower case."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(F.concat_ws(" ", text(brand), text(name))), "[^a-z0-9]+", "")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def brandless(brand: Column, name: Column) -> Column:
    """SF29: a name without the words of its house; empty where that changes nothing or leaves nothing."""
    kill = F.filter(_tokens(brand), lambda t: (F.length(t) > 1) & ~t.isin(*GENERIC))
    own = _tokens(name)
    kept = F.filter(own, lambda t: ~F.array_contains(kill, t))
    return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(own)), F.array_join(kept, " ")).otherwise("")


def numbered(text: Column) -> Column:
    """SF29: every spelling of a number ("No 5", "N°5", "number 5") as no5."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NUMBER, "no$1")


def identity_keys(brand: Column, name: Column) -> Column:
    """SF29: the keys of an identity, best first: as it is, without the house in the name, and both with numbers in one spelling; each once."""
    alias = brandless(brand, name)
    keys = [plain_key(brand, name), F.when(alias != "", plain_key(brand, alias)), plain_key(numbered(brand), numbered(name)), F.when(alias != "", plain_key(numbered(brand), numbered(alias)))]
    return F.filter(F.array_distinct(F.array_compact(F.array(*keys))), lambda k: k != "")


def leading_gender(name: Column) -> Column:
    """SF29: struct of what follows a label of gender at a name's start, and the gender; null without one, or where nothing follows."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    found = [F.when(F.startswith(low, F.lit(f"{label} ")), F.struct(F.trim(F.substr(low, F.lit(len(label) + 1))).alias("rest"), F.lit(gender).alias("gender"))) for label, gender in LABELS]
    out = F.coalesce(*found)
    return F.when(out["rest"] != "", out)


def inherited(rows: DataFrame, index: DataFrame, row_id: str, entry: str, brand: str, name: str) -> DataFrame:
    """(row_id, entry, by, gender): the entry of an index that a row's identity leads to.

    The row's keys are tried in their order, each leads to the entry of smallest id that has it among its own; then a row
    whose key is what follows a label of gender in exactly one entry's name has that one, and its gender. by is the
    place of the key (0 first), or -1 by gender. Rows without a match are left out. row_id and entry are ids of one row each.
    """
    known = index.select(F.col(entry).alias("__entry"), F.explode(identity_keys(F.col(brand), F.col(name))).alias("__key")).groupBy("__key").agg(F.min("__entry").alias("__entry"))
    asked = rows.select(row_id, F.posexplode(identity_keys(F.col(brand), F.col(name))).alias("__at", "__key"))
    direct = asked.join(known, "__key").groupBy(row_id).agg(F.min(F.struct("__at", "__entry")).alias("m")).select(row_id, F.col("m.__entry").alias(entry), F.col("m.__at").alias("by"), F.lit(None).cast("string").alias("gender"))
    core = index.select(F.col(entry).alias("__entry"), leading_gender(F.col(name)).alias("__g"), F.col(brand).alias("__b")).where("__g is not null")
    core = core.groupBy(plain_key(F.col("__b"), F.col("__g.rest")).alias("__key")).agg(F.min("__entry").alias("low"), F.max("__entry").alias("high"), F.min("__g.gender").alias("gender")).where("low = high")
    rest = rows.join(direct.select(row_id), row_id, "left_anti").select(row_id, plain_key(F.col(brand), F.col(name)).alias("__key"))
    by_core = rest.join(core, "__key").select(row_id, F.col("low").alias(entry), F.lit(-1).alias("by"), "gender")
    return direct.unionByName(by_core)


def _compared(normal: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normal, " ")), lambda t: (t != "") & (t != "and"))


def recovered(rows: DataFrame, name: str, house: str, url: str, second_url: str) -> DataFrame:
    """SF36: rows with name and house read from their addresses where they are weak.

    Weak is blank, "unknown" or what can't be an identity. The main address also wins where it says more of the name than
    the row does, or where a name begins with the address's house under another house; and its house where the row's
    is a part of it. The second address fills what is still weak. At last a house at the start of the name goes.
    """
    start = rows.withColumns({"__name": F.trim(F.coalesce(F.col(name), F.lit(""))), "__house": F.trim(F.coalesce(F.col(house), F.lit("")))})
    slug = X.title_from_slug(F.regexp_replace(F.regexp_extract(F.coalesce(F.col(second_url), F.lit("")), r"([^/]*)/*$", 1), r"\.\d+$", ""))
    start = computed(start, {"__un": F.coalesce(X.name_in_url(F.col(url)), F.lit("")), "__uh": F.coalesce(X.brand_in_url(F.col(url)), F.lit("")), "__slug": slug})
    by = F.contains("__slug", F.lit(" By "))
    start = computed(start, {"__sn": F.when(by, F.trim(F.regexp_extract("__slug", r"^(.*) By ", 1))).otherwise(F.col("__slug")), "__sh": F.when(by, F.trim(F.regexp_extract("__slug", r".* By (.*)$", 1))).otherwise("")})
    texts = {f"__{k}c": F.col(f"__{k}") for k in ("name", "house", "un", "uh")}
    own = X.with_clean(start, texts).withColumns({f"__{k}real": P.looks_real(F.col(f"__{k}")) for k in ("name", "house", "sn", "sh")})
    own, mine = identity.with_brand(own, "__housec_n", "__mine")
    own, theirs = identity.with_brand(own, "__uhc_n", "__theirs")
    n, un = F.col("__namec_n"), F.col("__unc_n")
    prefix = F.when(F.endswith(n, F.concat(F.lit(" "), un)) & (un != ""), F.trim(F.substr(n, F.lit(1), F.length(n) - F.length(un)))).otherwise("")
    own = computed(own, {"__prefix": _compared(prefix), "__hw": _compared(F.col("__housec_n")), "__uw": _compared(F.col("__uhc_n")), "__same": identity.same_brand(mine, theirs), "__more": (n != "") & (un != "") & (F.size(F.split(un, " ")) > F.size(F.split(n, " ")))})
    own = own.withColumn("__cover", S.token_coverage("__prefix", "__uw"))
    weak = lambda c: (F.col(f"__{c}") == "") | (F.lower(f"__{c}") == "unknown") | ~F.col(f"__{c}real")
    led = (F.col("__house") != "") & (F.col("__uh") != "") & ~F.col("__same") & (F.size("__prefix") > 0) & (F.size("__uw") > 0) & (F.col("__cover") >= PREFIX_COVERED)
    part = (F.col("__house") != "") & ~F.col("__same") & (F.size("__hw") > 0) & (F.size("__uw") > F.size("__hw")) & (F.size(F.array_except("__hw", "__uw")) == 0)
    take_name, take_house = (F.col("__un") != "") & (weak("name") | F.col("__more") | led), (F.col("__uh") != "") & (weak("house") | part)
    # what the main address gave is not weak; the second fills the rest
    fill = lambda taken, c, first, second: F.when(taken, F.col(first)).when(weak(c) & (F.col(second) != "") & F.col(f"{second}real"), F.col(second)).otherwise(F.col(f"__{c}"))
    own = computed(own, {"__full": fill(take_name, "name", "__un", "__sn"), "__maker": fill(take_house, "house", "__uh", "__sh")})
    rest = [c for c in rows.columns if c not in (name, house)]
    found = identity.with_stripped_name(own.select(*rest, "__full", "__maker"), "__full", "__maker", "__stripped")
    both = (F.col("__full") != "") & (F.col("__maker") != "")
    return found.select(*[F.when(both, F.col("__stripped")).otherwise(F.col("__full")).alias(name) if c == name else F.col("__maker").alias(house) if c == house else F.col(c) for c in rows.columns])
