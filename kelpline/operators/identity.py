"""Brands, names and how alike two identities are: what admits, ranks and links rows.

Everything is Columns over token arrays; only the ratios of strings are Arrow functions. Rows are scored where
they are, so an operator here never shuffles; pairs should come from a blocked join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions.steps import computed, unused

# Words of a name that tell no fragrance from another, those of a query that must not rank a row, and what answers leave out.
STOPWORDS = (
    "cologne", "perfume", "fragrance", "edt", "edp", "edc", "extrait", "parfum", "toilette", "eau", "de", "du", "la", "le", "l", "pour",
    "homme", "femme", "men", "women", "man", "woman", "male", "female", "unisex", "spray", "version", "original", "new", "intense",
)
CONNECTORS = ("the", "of", "and", "or", "a", "an", "by", "to", "with", "el", "des", "di", "et", "il", "lo")
NOT_DISPLAYED = ("cologne", "perfume", "fragrance", "spray", "version", "new", "by", "for", "men", "women", "male", "female", "unisex")
GENDERS = {
    "homme": "masculine", "men": "masculine", "man": "masculine", "male": "masculine",
    "femme": "feminine", "women": "feminine", "woman": "feminine", "female": "feminine",
}
MARKERS = ("eau",)
CONCENTRATION_PHRASE = r"\beau\s+de\s+(?:parfum|toilette|cologne)\b"
BRAND_SUFFIXES = ("beauty", "cosmetics", "fragrance", "fragrances", "parfum", "parfums", "paris", "perfume", "perfumes", "prive", "prives")
STARTERS = ("and", "de", "du", "di", "et", "van", "von")
# Forms of one brand, the canonical one first.
ALIASES = (
    ("dior", "christian dior"),
    ("ysl", "yves saint laurent", "yves st laurent"),
    ("armani", "giorgio armani"),
    ("hermes",),
    ("prada",),
    ("chanel",),
    ("versace",),
    ("tom ford", "tf", "ford"),
    ("maison francis kurkdjian", "mfk"),
    ("jean paul gaultier", "jpg"),
    ("dolce and gabbana", "dolce gabbana", "d and g", "dg"),
    ("casamorati", "casamorati 1888", "xerjoff"),
    ("maison margiela", "maison martin margiela", "martin margiela", "replica"),
    ("thom browne", "thombrony"),
    ("hugo boss", "boss"),
    ("montblanc", "mont blanc"),
    ("parfums de marly", "pdm"),
    ("le labo",),
    ("jo malone", "jo malone london"),
    ("comme des garcons", "cdg"),
    ("acqua di parma", "adp"),
    ("van cleef and arpels", "van cleef arpels", "van cleef", "vca"),
    ("frederic malle", "editions de parfums frederic malle"),
    ("by kilian", "kilian"),
    ("paco rabanne", "paco"),
    ("viktor and rolf", "viktor rolf"),
    ("bvlgari", "bulgari"),
    ("initio", "initio parfums prives"),
)
# Lines of a house that have a page of their own and its label; whole queries that stand for others; lines whose house is often left out.
LINES = {"casamorati": "Casamorati 1888", "casamorati 1888": "Casamorati 1888", "replica": "Maison Margiela"}
REWRITES = {
    "monet blanco": "Montblanc",
    "mont blanco": "Montblanc",
    "ysev saint laurent": "Yves Saint Laurent",
    "baccarat": "Maison Francis Kurkdjian Baccarat Rouge 540",
    "br540": "Maison Francis Kurkdjian Baccarat Rouge 540",
    "layton": "Parfums de Marly Layton",
}
LINE_HOUSES = (("baccarat rouge", "Maison Francis Kurkdjian"), ("le male", "Jean Paul Gaultier"), ("bottled night", "Hugo Boss"), ("layton", "Parfums de Marly"))
# Weight of a filler word, least letters of a fuzzy match, floors of a result, of the names' coverage and of what covers a word, and the cap without one.
FILLER_WEIGHT, FUZZY_LETTERS, RESULT_FLOOR, COVERAGE, COVERED, UNCOVERED_CAP = 0.15, 3, 0.72, 0.86, 0.8, 0.50
# Scores of two names by how their tokens overlap, of a sequence ratio where they don't, and what years add.
SAME, LINE, OVERLAP, PART, LARGE_SHARE, SHARE = 0.96, 0.90, 0.90, 0.68, 0.84, 0.74
SEQUENCE, SEQUENCE_ALONE, SAME_YEAR, NEXT_YEAR = 0.86, 0.80, 0.04, -0.15


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _within(a: Column, b: Column) -> Column:
    """Whether a (not empty) is a part of b."""
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)


def prepared(rows: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """rows plus, for each named text, <name> cleaned and <name>_n normalized: what the scores read.

    The Arrow functions run here once; array functions cannot hold them.
    """
    return X.with_clean(unused(rows, *[f"{k}{end}" for k in texts for end in ("", "_n")]), texts)


def words(normal: Column) -> Column:
    """Distinct tokens of a normalized text, in order."""
    return F.array_remove(F.array_distinct(F.split(normal, " ")), "")


def distinctive(tokens: Column) -> Column:
    return F.array_except(tokens, _array(STOPWORDS))


@dataclass(frozen=True)
class Brand:
    """What is read of a normalized brand: its forms, those without generic words at their end, and the tokens of all forms."""

    normal: Column
    forms: Column
    bare: Column
    words: Column

    @classmethod
    def of(cls, normal: Column | Brand) -> Brand:
        if isinstance(normal, Brand):
            return normal
        forms = _forms(normal)
        return cls(normal, forms, _bare(forms), _form_words(forms))


def with_brand(rows: DataFrame, normal: str, name: str) -> tuple[DataFrame, Brand]:
    """rows with what is read of a brand in columns of their own, so that a plan has the table of forms once, however often they are read."""
    made = computed(rows, {f"{name}_forms": _forms(F.col(normal))})
    made = computed(made, {f"{name}_bare": _bare(F.col(f"{name}_forms")), f"{name}_words": _form_words(F.col(f"{name}_forms"))})
    return made, Brand(F.col(normal), *[F.col(f"{name}_{k}") for k in ("forms", "bare", "words")])


def _forms(brand: Column) -> Column:
    groups = {form: group for group in ALIASES for form in group}
    table = F.create_map(*[x for form, group in groups.items() for x in (F.lit(form), _array(group))])
    return F.array_remove(F.array_distinct(F.concat(F.array(brand), F.coalesce(F.try_element_at(table, brand), _array(())))), "")


def _bare(forms: Column) -> Column:
    tail = rf"( ?\b({'|'.join(BRAND_SUFFIXES)}))+$"
    return F.array_remove(F.array_distinct(F.transform(forms, lambda f: F.regexp_replace(f, tail, ""))), "")


def _form_words(forms: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(forms, words)))


def brand_forms(brand: Column | Brand) -> Column:
    """SF8: all forms of a normalized brand, itself first; none for a blank one."""
    return Brand.of(brand).forms


def brand_words(brand: Column | Brand) -> Column:
    """Tokens of all forms of a normalized brand."""
    return Brand.of(brand).words


def without_suffixes(brand: Column | Brand) -> Column:
    """SF9: the forms of a normalized brand without generic words at their end."""
    return Brand.of(brand).bare


def same_brand(a: Column | Brand, b: Column | Brand) -> Column:
    """SF9: whether two normalized brands share a form, with or without generic words at its end."""
    a, b = Brand.of(a), Brand.of(b)
    return (a.normal == b.normal) | F.arrays_overlap(a.forms, b.forms) | F.arrays_overlap(a.bare, b.bare)


def name_words(name: Column, brand: Column | Brand, kept: bool = False) -> Column:
    """SF6: tokens of a normalized name without those of its brand; kept leaves stop words in."""
    tokens, own = words(name), brand_words(brand)
    return F.array_except(tokens, own) if kept else F.array_except(distinctive(tokens), distinctive(own))


def _unconcentrated(name: Column, brand: Column | Brand) -> Column:
    """Tokens with stop words, but without phrases that say a concentration."""
    return name_words(F.regexp_replace(name, CONCENTRATION_PHRASE, " "), brand, kept=True)


def gender_groups(name: Column, brand: Column | Brand) -> Column:
    """SF7: the genders that a normalized name's words stand for, sorted."""
    table = F.create_map(*[F.lit(x) for kv in GENDERS.items() for x in kv])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(name_words(name, brand, kept=True), lambda t: F.try_element_at(table, t)))))


def required_markers(name: Column, brand: Column | Brand) -> Column:
    """SF7: words that a normalized name must share with one of the same fragrance."""
    return F.array_sort(F.array_intersect(_unconcentrated(name, brand), _array(MARKERS)))


def _lead(normal: Column) -> Column:
    """The first distinctive word of a normalized name, empty without one."""
    return F.coalesce(F.get(distinctive(words(normal)), F.lit(0)), F.lit(""))


def line_label(name: Column, normal: Column, first: Column, house: Column | Brand, lead: Column | Brand | None = None) -> Column:
    """The first word of a cleaned name where it names a line of the house, not the house itself; else empty.

    normal and house are normalized, first is the name's first word normalized; lead is its first distinctive word, if that is known.
    """
    lead, house = Brand.of(_lead(normal) if lead is None else lead), Brand.of(house)
    fits = (house.normal != "") & (F.size(distinctive(words(normal))) >= 2) & (F.length(lead.normal) >= 4) & ~F.array_contains(distinctive(house.words), lead.normal)
    return F.when(fits & ~same_brand(lead, house) & (first == lead.normal), F.get(F.split(name, " "), F.lit(0))).otherwise("")


def same_catalog_brand(house: Column | Brand, other: Column | Brand, name: Column, line: Column | None = None) -> Column:
    """SF9: whether a catalogue's brand is the house, or the line of it that a name is of. All are normalized; line is line_label(), if that is known."""
    house, other = Brand.of(house), Brand.of(other)
    line = line_label(name, name, F.get(F.split(name, " "), F.lit(0)), house) if line is None else line
    found = same_brand(house, other) | ((line != "") & F.contains(other.normal, line))
    for key, label in LINES.items():
        found = found | ((F.contains(name, F.lit(key)) | F.contains(line, F.lit(key))) & ((other.normal == label.lower()) | F.contains(other.normal, F.lit(key))))
    return found


def display_words(text: Column) -> Column:
    """Tokens of a normalized text that an answer shows."""
    return F.array_except(words(text), _array(NOT_DISPLAYED))


def brand_only(query: Column | Brand, brand: Column | Brand) -> Column:
    """PF17: whether a brand's forms explain every word of a query, and the query is that brand. Both are normalized."""
    query, brand = Brand.of(query), Brand.of(brand)
    asked = display_words(query.normal)

    def without(left: Column, form: Column) -> Column:
        own = display_words(form)
        return F.when(_within(own, left), F.array_except(left, own)).otherwise(left)

    rest = F.aggregate(brand.forms, asked, without)
    return (brand.normal != "") & (F.size(asked) > 0) & (F.size(rest) == 0) & same_brand(query, brand)


def query_words(query: Column, brand: Column | Brand) -> Column:
    """The words of a normalized query that the brand doesn't explain; all of them where none are left."""
    asked = display_words(query)

    def without(left: Column, form: Column) -> Column:
        own = display_words(form)
        plain = F.filter(own, lambda t: ~t.rlike("^[0-9]+$"))
        part = (F.size(plain) < F.size(own)) & _within(plain, left)
        return F.when(_within(own, left), F.array_except(left, own)).when(part, F.array_except(left, plain)).otherwise(left)

    rest = F.aggregate(brand_forms(brand), asked, without)
    return F.when(F.size(rest) > 0, rest).otherwise(asked)


def canonical_brand(query: Column) -> Column:
    """SF10: the canonical form of a normalized query that is a brand's form; empty for others."""
    table = F.create_map(*[F.lit(x) for group in ALIASES for form in group for x in (form, group[0])])
    return F.coalesce(F.try_element_at(table, query), F.lit(""))


def _short_forms() -> dict[str, str]:
    """Initials of two or three letters to the brand's longest form."""
    return {form: max(group, key=lambda f: (len(f.split()), len(f))) for group in ALIASES for form in group if " " not in form and 2 <= len(form) <= 3}


def expanded_query(query: Column, cleaned: Column, normal: Column) -> Column:
    """SF10: a query that is a known shorthand rewritten, swapped initials of a brand put right, a line's missing house put first; others as they are.

    cleaned and normal are the query cleaned and normalized.
    """
    tokens, rewrites = F.split(normal, " "), F.create_map(*[F.lit(x) for kv in REWRITES.items() for x in kv])
    trimmed = F.regexp_replace(normal, rf"( ({'|'.join(STOPWORDS)}))+$", "")
    out = F.when(normal == "", query).when(F.coalesce(F.try_element_at(rewrites, normal), F.try_element_at(rewrites, trimmed)).isNotNull(), F.coalesce(F.try_element_at(rewrites, normal), F.try_element_at(rewrites, trimmed)))
    first, tail = F.get(tokens, F.lit(0)), F.regexp_replace(cleaned, r"^\S+ ?", "")
    unknown = ~first.isin(*[form for group in ALIASES for form in group])
    for short, full in _short_forms().items():
        out = out.when(unknown & S.one_swap(first, F.lit(short)), F.trim(F.concat_ws(" ", F.lit(full), tail)))
    spaced = F.concat(F.lit(" "), normal, F.lit(" "))
    for k, (phrase, house) in enumerate(LINE_HOUSES):
        earlier = reduce(lambda a, b: a | b, [F.contains(spaced, F.lit(f" {p} ")) for p, _ in LINE_HOUSES[:k]], F.lit(False))
        there = F.exists(brand_forms(F.lit(house.lower())), lambda f: _within(distinctive(words(f)), words(normal)))
        out = out.when(F.contains(spaced, F.lit(f" {phrase} ")) & ~there & ~earlier, F.concat_ws(" ", F.lit(house), cleaned))
    return out.otherwise(query)


def stripped_name(name: Column, normals: Column, house: Column) -> Column:
    """SF11: a cleaned name without its house at the start, or "by house" at the end; as it is where nothing good would be left.

    normals are the name's words, each normalized (normal_words()); house is normalized.
    """
    forms = F.array_sort(brand_forms(house), lambda a, b: F.length(b) - F.length(a))
    tokens = F.split(name, " ")
    n = F.size(tokens)
    trim = r"^[ \-–—|:]+|[ \-–—|:]+$"

    def after(form: Column) -> Column:
        """What follows the first words that are this form, or null."""
        k = F.size(F.split(form, " "))
        head = lambda size: F.trim(F.array_join(F.slice(normals, 1, size), " "))
        at = F.when(head(k) == form, k).when(head(F.least(k + 1, n)) == form, k + 1)
        rest = F.regexp_replace(F.array_join(F.slice(tokens, at + 1, F.greatest(n, F.lit(1))), " "), trim, "")
        lead = F.get(F.split(F.trim(F.array_join(F.slice(normals, at + 1, F.greatest(n, F.lit(1))), " ")), " "), F.lit(0))
        return F.when((rest != "") & ~((k == 1) & lead.isin(*STARTERS)), rest)

    def before(form: Column) -> Column:
        """What precedes "by" and this form at the end, or null."""
        k = F.size(F.split(form, " "))
        by = F.lower(F.get(tokens, n - k - 1)) == "by"
        rest = F.regexp_replace(F.array_join(F.slice(tokens, 1, F.greatest(n - k - 1, F.lit(0))), " "), trim, "")
        return F.when(by & (n > k + 1) & (F.array_join(F.slice(normals, F.greatest(n - k + 1, F.lit(1)), k), " ") == form) & (rest != ""), rest)

    whole = F.trim(F.regexp_replace(F.array_join(normals, " "), " +", " "))
    found = F.array_compact(F.transform(forms, lambda f: F.when(f == whole, name).otherwise(F.coalesce(F.when(F.startswith(whole, F.concat(f, F.lit(" "))), after(f)), before(f)))))
    return F.coalesce(F.get(found, F.lit(0)), name)


def normal_words(name: Column) -> Column:
    """The words of a cleaned name, each without case, accents and signs."""
    return F.split(F.regexp_replace(F.replace(X.unaccented(F.lower(name)), F.lit("&"), F.lit("and")), "[^a-z0-9 ]", ""), " ")


def with_stripped_name(rows: DataFrame, name: str, house: str, out: str) -> DataFrame:
    """rows plus stripped_name() of two columns."""
    made = rows.withColumns({"__name": X.clean(name), "__house": X.normalize_identity(house), "__words": normal_words(X.clean(name))})
    return made.withColumn(out, stripped_name(F.col("__name"), F.col("__words"), F.col("__house"))).drop("__name", "__house", "__words")


def phrases(name: Column, brand: Column | Brand) -> Column:
    """A normalized name, alone and with each form of its brand before and after it."""
    both = F.transform(brand_forms(brand), lambda f: F.array(F.concat_ws(" ", f, name), F.concat_ws(" ", name, f)))
    return F.array_remove(F.concat(F.array(name), F.when(name == "", _array(())).otherwise(F.flatten(both))), "")


def _best_phrase(query: Column, found: Column) -> Column:
    return F.when(query == "", 0.0).otherwise(F.coalesce(F.get(S.best_ratios(F.array(query), found), F.lit(0)), F.lit(0.0)))


def fused_score(query: Column, name: Column, brand: Column | Brand) -> Column:
    """SF14: the best ratio of a query and a name, alone or with a form of its brand before or after it. All are normalized."""
    return _best_phrase(query, phrases(name, brand))


def _filler(token: Column) -> Column:
    return token.isin(*STOPWORDS, *CONNECTORS)


def with_relevance(rows: DataFrame, query: str, name: str, brand: str, least: float = RESULT_FLOOR) -> DataFrame:
    """SF15, PF14: rows plus score and relevant.

    score, 0 to 1, says how well a row answers its query: words count fully, fillers a little; a word may be met by one
    like it. 1 where the query is the row's brand alone; at most 0.5 where none of its distinctive words is met; the
    likeness of whole phrases otherwise or beside. relevant: a score of at least `least`, and the query's own words covered
    by the name's where it has two or more. Nulls are empty texts. A column score or relevant of rows is refused.

    What several parts of the score read is a column of a step of its own: the plan stays short.
    """
    own = prepared(unused(rows, "score", "relevant"), {"__q": F.col(query), "__n": F.col(name), "__b": F.col(brand)})
    own, house = with_brand(own, "__b_n", "__b_own")
    own, wanted = with_brand(own, "__q_n", "__q_own")
    nq, nn, nb = (F.col(f"{c}_n") for c in ("__q", "__n", "__b"))
    tokens = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    own = computed(own, {"__ql": F.lower("__q"), "__nl": F.lower("__n"), "__bl": F.lower("__b"), "__alone": brand_only(wanted, house)})
    own = computed(own, {"__target": F.trim(F.concat_ws(" ", "__bl", "__nl")), "__asked": tokens(F.col("__ql"))})
    own = computed(own, {"__found": tokens(F.col("__target")), "__phrases": phrases(nn, house)})
    phrase = F.greatest(S.sequence_ratio("__ql", "__nl"), S.sequence_ratio("__ql", "__bl"), S.sequence_ratio("__ql", "__target"), _best_phrase(nq, F.col("__phrases")))
    own = own.withColumns({"__ratios": S.best_ratios("__asked", "__found"), "__phrase": phrase})

    def met(t: Column, r: Column) -> Column:
        near = F.when(F.array_contains("__found", t), 1.0).when(~_filler(t) & (F.length(t) >= FUZZY_LETTERS), r).otherwise(0.0)
        return F.struct(near.alias("r"), _filler(t).alias("filler"), F.when(_filler(t), FILLER_WEIGHT).otherwise(1.0).alias("w"))

    own = computed(own, {"__met": F.zip_with("__asked", "__ratios", met)})
    total = F.aggregate("__met", F.lit(0.0), lambda s, x: s + x["w"])
    matched = F.aggregate("__met", F.lit(0.0), lambda s, x: s + x["r"] * x["w"])
    covered = F.exists("__met", lambda x: ~x["filler"] & (x["r"] >= COVERED))
    own = computed(own, {"__best": F.greatest(F.try_divide(matched, total), "__phrase"), "__covered": covered, "__anchored": F.exists("__met", lambda x: ~x["filler"])})
    remainder = (F.size(F.split(nb, " ")) == 1) & (nb != "") & F.get(F.split(nn, " "), F.lit(0)).isin(*STARTERS)
    empty = (F.size("__asked") == 0) | (F.size("__found") == 0)
    score = F.when(remainder, 0.0).when(F.col("__alone"), 1.0).when(empty, 0.0).when(~F.col("__anchored"), F.col("__phrase"))
    own = computed(own, {"score": score.when(~F.col("__covered"), F.least("__best", F.lit(UNCOVERED_CAP))).otherwise(F.col("__best"))})
    own = computed(own, {"__plain": name_words(nn, house), "__all": name_words(nn, house, kept=True), "__rest": query_words(nq, house)})
    own = computed(own, {"__short": distinctive(F.col("__rest"))})
    own = computed(own, {"__own": F.when(F.size("__plain") > 0, F.col("__plain")).otherwise(F.col("__all")), "__left": F.when((F.size("__plain") > 0) & (F.size("__short") > 0), F.col("__short")).otherwise(F.col("__rest"))})
    own = computed(own, {"__extra": F.array_except("__left", "__own")})
    own = own.withColumns({"__byname": S.token_coverage("__left", "__own"), "__byhouse": S.token_coverage("__extra", house.words)})
    single = (F.size("__own") == 1) & F.arrays_overlap("__left", "__own") & ((F.size("__extra") == 0) | ((F.size(house.words) > 0) & (F.col("__byhouse") >= COVERAGE)))
    few = (F.size("__left") < 2) | (F.size("__own") == 0)
    fits = (F.coalesce("score", F.lit(0.0)) >= least) & (F.col("__alone") | few | single | (F.col("__byname") >= COVERAGE))
    return computed(own, {"relevant": fits}).select(*rows.columns, "score", "relevant")


def names_score(a: Column, b: Column) -> Column:
    """SF16: a score of two arrays of name words by how they overlap; 0 where they don't enough."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    jaccard, coverage = shared / union, shared / shorter
    extra = F.array_except(F.array_union(a, b), F.array_intersect(a, b))
    lines = _array(sorted({w for line in LINES for w in line.split()}))
    part = (coverage >= 0.92) & (longer > shorter)
    score = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(F.size(extra) == 0, SAME)
    score = score.when(part & _within(extra, lines), LINE).when(part, PART).when(coverage >= 0.92, OVERLAP)
    return score.when(jaccard >= 0.75, LARGE_SHARE).when((jaccard >= 0.55) & (coverage >= 0.70), SHARE).otherwise(0.0)


def _identity_side(pairs: DataFrame, side: str) -> tuple[DataFrame, Brand]:
    """pairs plus, for one of their sides, the words and marks of its name and the line that it may be of."""
    at = f"__{side}"
    pairs, house = with_brand(pairs, f"{at}brand_n", f"{at}own")
    name = F.col(f"{at}name_n")
    pairs = computed(pairs, {f"{at}all": name_words(name, house, kept=True), f"{at}plain": name_words(name, house), f"{at}lean": _unconcentrated(name, house), f"{at}lead": _lead(name)})
    pairs, lead = with_brand(pairs, f"{at}lead", f"{at}first")
    table = F.create_map(*[F.lit(x) for kv in GENDERS.items() for x in kv])
    genders = F.array_sort(F.array_distinct(F.array_compact(F.transform(f"{at}all", lambda t: F.try_element_at(table, t)))))
    label = line_label(name, name, F.get(F.split(name, " "), F.lit(0)), house, lead)
    return computed(pairs, {f"{at}genders": genders, f"{at}marks": F.array_sort(F.array_intersect(f"{at}lean", _array(MARKERS))), f"{at}line": label}), house


def _sequence_fallback() -> Column:
    """Names whose words don't overlap: the same letters, or as many words of which none begins another, and a high ratio."""
    left, right = F.replace("__aname_n", F.lit(" "), F.lit("")), F.replace("__bname_n", F.lit(" "), F.lit(""))
    only_a, only_b = F.array_except("__aplain", "__bplain"), F.array_except("__bplain", "__aplain")
    begins = F.exists(only_a, lambda x: F.exists(only_b, lambda y: F.startswith(x, y) | F.startswith(y, x)))
    ratio = F.col("__ratio")
    return F.when((left == right) & (F.length(left) >= 4), SAME).when((F.size("__aplain") == F.size("__bplain")) & ~begins & (ratio >= SEQUENCE), ratio).otherwise(0.0)


def with_identity_score(pairs: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], out: str = "score") -> DataFrame:
    """SF16: pairs plus a score, 0 to 1, of whether their (brand, name, year) columns are one fragrance.

    0 where the brands are known and differ, where words of gender or "eau" differ, where the names don't match,
    or where the years lie more than one apart. Nulls are empty texts. What several parts of the score read of a
    side is a column of a step of its own: the plan stays short.
    """
    texts = {f"__{side}{k}": F.col(c).cast("string") for side, columns in (("a", a), ("b", b)) for k, c in zip(("brand", "name", "year"), columns, strict=True)}
    own, house_a = _identity_side(prepared(pairs, texts), "a")
    own, house_b = _identity_side(own, "b")
    unknown = lambda c: c.isin("", "unknown")
    brands = unknown(house_a.normal) | unknown(house_b.normal) | same_catalog_brand(house_a, house_b, F.col("__aname_n"), F.col("__aline")) | same_catalog_brand(house_b, house_a, F.col("__bname_n"), F.col("__bline"))
    marks = (F.col("__agenders") == F.col("__bgenders")) & (F.col("__amarks") == F.col("__bmarks"))
    own = own.withColumn("__ratio", S.sequence_ratio("__aname_n", "__bname_n"))
    own = computed(own, {"__both": (F.size("__aplain") > 0) & (F.size("__bplain") > 0), "__alike": brands & marks})
    own = computed(own, {f"__{side}used": F.when(F.col("__both"), F.col(f"__{side}plain")).otherwise(F.col(f"__{side}lean")) for side in "ab"})
    own = computed(own, {"__first": names_score(F.col("__aused"), F.col("__bused")), "__second": F.when(F.col("__both"), _sequence_fallback()).when(F.col("__ratio") >= SEQUENCE_ALONE, F.col("__ratio")).otherwise(0.0)})
    own = computed(own, {"__score": F.when(F.col("__first") > 0, F.col("__first")).otherwise(F.col("__second"))})
    year_a, year_b, score = F.col("__ayear"), F.col("__byear"), F.col("__score")
    apart = F.abs(year_a.try_cast("int") - year_b.try_cast("int"))
    dated = (year_a != "") & (year_b != "") & (year_a != year_b)
    made = F.when(~F.col("__alike") | (score == 0) | (dated & (apart.isNull() | (apart > 1))), 0.0).when(dated, score + NEXT_YEAR).when((year_a != "") & (year_a == year_b), score + SAME_YEAR).otherwise(score)
    return own.withColumn(out, F.greatest(F.lit(0.0), F.least(made, F.lit(1.0)))).select(*pairs.columns, out)


def subset_identity(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Whether two (brand, name, year) differ in stop words alone, or a has words more and the years are equal. All are normalized."""
    (ba, na, ya), (bb, nb, yb) = a, b
    kept_a, kept_b = name_words(na, ba, kept=True), name_words(nb, bb, kept=True)
    stop = _array(STOPWORDS + CONNECTORS)
    less, more = (F.array_except(F.array_except(x, y), stop) for x, y in ((kept_b, kept_a), (kept_a, kept_b)))
    dated = (F.size(F.array_except(kept_a, kept_b)) > 0) & (ya != "") & (ya == yb)
    return F.arrays_overlap(kept_a, kept_b) & (F.size(less) == 0) & ((F.size(more) == 0) | dated)


def variant_ok(relevant: Column, score: Column, query: Column, variant: Column, name: Column, brand: Column) -> Column:
    """PF16: whether a row found by another form of a query is kept: it is relevant for the query itself, or the variant is one word
    of five letters or more, not the query, that the name covers by 0.90, with a score of 0.80. Texts are normalized."""
    asked, plain = words(variant), name_words(name, brand)
    target = F.when(F.size(plain) > 0, plain).otherwise(name_words(name, brand, kept=True))
    lone = (F.size(asked) == 1) & (F.length(F.get(asked, F.lit(0))) >= 5) & (variant != query)
    return relevant | (lone & (score >= 0.80) & (S.token_coverage(asked, target) >= 0.90))


def ranked_candidates(rows: DataFrame, query: str, order: list[Column], tie: str, cap: int | None = None) -> DataFrame:
    """Rows of each query by several keys, largest first, ties by `tie`; rank from 1, the first `cap` alone if given. A column rank is refused."""
    ranked = unused(rows, "rank").withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*[F.desc_nulls_last(o) for o in order], tie)).cast("long"))
    return ranked if cap is None else ranked.where(F.col("rank") <= cap)


def diagnostics(results: DataFrame, query: str, url: str, shown: int) -> DataFrame:
    """AG30, TK6: for each query how many rows it has, how many are linked, whether none is, and how many were cut off."""
    counts = results.groupBy(query).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col(url), F.lit("")) != "").alias("linked"))
    return counts.select(query, "total", "linked", ((F.col("total") > 0) & (F.col("linked") == 0)).alias("degraded"), F.greatest(F.lit(0), F.col("total") - shown).alias("truncated"))


def needs_repair(scores: DataFrame, query: str, score: str, native: str) -> DataFrame:
    """PF24: whether a query's best rows are too poor: native ones below 0.72 and all below 0.78, or no row of 0.72 at all."""
    best = scores.groupBy(query).agg(F.max(F.when(F.col(native), F.col(score))).alias("best_native"), F.max(score).alias("best"))
    good = (F.coalesce("best_native", F.lit(0.0)) >= RESULT_FLOOR) | (F.coalesce("best", F.lit(0.0)) >= 0.78)
    return best.select(query, "best_native", "best", (~good & (F.coalesce("best", F.lit(0.0)) < RESULT_FLOOR)).alias("repair"))
