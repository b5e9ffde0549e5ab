"""All metrics of a record from its cards, in the row: no shuffle, whatever a card holds.

A record's cards are an array of structs (card, rows), rows an array of structs (label, value, pct, count) of texts
and a double. A group without votes is null and left out of what is blended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import computed
from . import metrics as M
from . import predicates as P

CARDS = "array<struct<card:string,rows:array<struct<label:string,value:string,pct:double,count:string>>>>"
#: Seasons and times of day as labels name them.
SEASONS = {"winter": "Winter", "spring": "Spring", "summer": "Summer", "autumn": "Autumn/Fall", "fall": "Autumn/Fall"}
TIMES = {"day": "Day", "night": "Night"}
#: Shown order of cards by what their name holds.
CARD_RANKS = (
    ("fragrantica rating", 0), ("main accords", 1), ("longevity", 2), ("sillage", 3), ("projection", 3),
    ("gender", 4), ("price value", 5), ("value", 5), ("when to wear", 6), ("season", 6),
)
#: What a label's words are worth in the older scorecard, first match wins, and its weights.
WORDS = (
    (r"eternal|very long|long lasting|long", 92), (r"moderate", 62), (r"weak|soft", 36), (r"very weak", 18), (r"enormous|room filling", 96),
    (r"strong|heavy", 82), (r"intimate|close", 35), (r"excellent|great|amazing", 94), (r"good|high", 76), (r"okay|ok|average|fair", 55),
    (r"poor|bad|low|overpriced", 28), (r"like it|love it|really like", 84), (r"dislike|hate", 18),
)
SCORECARD = {"rating": 0.45, "approval": 0.25, "performance": 0.20, "value": 0.10}
NEUTRAL = 0.35


def card(cards: Column, *needles: str) -> Column:
    """SC8: the rows of the first card whose name holds one of the words, whatever its case; none without such a card."""
    holds = lambda c: F.lower(c["card"]).rlike("|".join(needles))
    return F.coalesce(F.get(F.filter(cards, holds), F.lit(0))["rows"], F.array().cast(ROWS))


def card_rank(name: Column) -> Column:
    """A card's place among those shown, 20 for others; ties are by name."""
    out = F.when(F.contains(F.lower(name), F.lit(CARD_RANKS[0][0])), CARD_RANKS[0][1])
    for needle, rank in CARD_RANKS[1:]:
        out = out.when(F.contains(F.lower(name), F.lit(needle)), rank)
    return out.otherwise(20)


ROWS = "array<struct<label:string,value:string,pct:double,count:string,votes:bigint>>"


def counted(cards: Column) -> Column:
    """Cards whose rows also have their votes as a number: what the groups read."""
    read = lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value"), r["pct"].alias("pct"), r["count"].alias("count"), F.coalesce(X.vote_count(r["count"]), F.lit(0).cast("long")).alias("votes"))
    return F.transform(cards, lambda c: F.struct(c["card"].alias("card"), F.transform(c["rows"], read).alias("rows")))


def _votes(row: Column) -> Column:
    return row["votes"]


def _label(row: Column) -> Column:
    return F.trim(F.coalesce(row["label"], F.lit("")))


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0).cast("double"), lambda s, r: s + value(r))


def adequacy(rows: Column, worths: dict[str, int]) -> Column:
    """AG8, AG13: struct of the vote-weighted worth of known labels (null without votes) and their votes."""
    known = F.filter(rows, lambda r: M.worth(_label(r), worths).isNotNull() & (_votes(r) > 0))
    votes = _total(known, _votes)
    return F.struct(F.when(votes > 0, _total(known, lambda r: M.worth(_label(r), worths) * _votes(r)) / votes).alias("score"), votes.cast("long").alias("votes"))


def dominant(rows: Column) -> Column:
    """AG9: the label of most votes, the first of equal ones; null without labels."""
    named = F.transform(F.filter(rows, lambda r: _label(r) != ""), lambda r, i: F.struct(_votes(r).alias("n"), (-i).alias("i"), _label(r).alias("label")))
    return F.array_max(named)["label"]


def _stated(rows: Column) -> Column:
    """The first row of a summary that says "x / 5"."""
    return F.get(F.filter(rows, lambda r: r["value"].rlike(r"[0-5](\.\d+)?\s*/\s*5")), F.lit(0))


def _stars(value: Column) -> Column:
    return F.regexp_extract(value, r"([0-5](?:\.\d+)?)\s*/\s*5", 1).try_cast("double")


def with_rating(rows: DataFrame, distribution: str, summary: str, out: str) -> DataFrame:
    """AG10: rows plus a struct of score, mean stars, share of 4 and 5, votes and basis: of the distribution's rows, else of the summary's "x / 5"; null without both."""
    star = lambda r: F.coalesce(F.trim(r["value"]).try_cast("int"), F.nullif(F.regexp_extract(r["label"], "[1-5]", 0), F.lit("")).try_cast("int"))
    made = computed(rows, {"__starred": F.transform(distribution, lambda r: F.struct(star(r).alias("star"), _votes(r).alias("votes"))), "__stated_value": _stated(F.col(summary))["value"], "__stated_votes": _stated(F.col(summary))["votes"]})
    known = lambda r: r["star"].isNotNull()
    sums = lambda worth: F.aggregate(F.filter("__starred", known), F.lit(0.0), lambda s, r: s + worth(r))
    made = computed(made, {"__votes": sums(_votes), "__sum": sums(lambda r: r["star"] * r["votes"]), "__liked": sums(lambda r: F.when(r["star"].isin(4, 5), r["votes"]).otherwise(0)), "__stars": _stars(F.col("__stated_value"))})
    each = lambda mean, share, votes, basis: F.struct((mean / 5.0 * 100.0).alias("score"), mean.alias("mean"), share.alias("positive_share"), votes.cast("long").alias("votes"), F.lit(basis).alias("basis"))
    votes, stars = F.col("__votes"), F.col("__stars")
    found = F.when(votes > 0, each(F.try_divide("__sum", votes), F.try_divide("__liked", votes), votes, "rating_distribution")).when(stars.isNotNull(), each(stars, F.lit(None).cast("double"), F.col("__stated_votes"), "rating_summary"))
    return computed(made, {out: found}).drop("__starred", "__stated_value", "__stated_votes", "__votes", "__sum", "__liked", "__stars")


def performance(long: Column, trail: Column, a: Column, b: Column) -> Column:
    """AG12: struct of the blended score, both parts (adequacy() scores a and b of both cards' rows), and the dominant labels; null without votes."""
    score = M.blend({"longevity": a, "sillage": b}, M.PERFORMANCE)
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(score.alias("score"), a.alias("longevity"), b.alias("sillage"), dominant(long).alias("longevity_label"), dominant(trail).alias("sillage_label")))


def value(rows: Column, score: Column) -> Column:
    """AG13: struct of score (of adequacy()) and dominant label; null without votes."""
    return F.when(score.isNotNull(), F.struct(score.alias("score"), dominant(rows).alias("dominant_label")))


def with_wear(rows: DataFrame, votes: str, out: str, near: float = 0.05) -> DataFrame:
    """AG14: rows plus a struct of the one or two seasons of most votes, the time of day, and the votes of both; null without such labels."""

    def ordered(names: dict[str, str]) -> Column:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        named = F.transform(votes, lambda r, i: F.struct((-_votes(r)).alias("n"), i.alias("i"), F.try_element_at(table, F.lower(_label(r))).alias("name")))
        return F.array_sort(F.filter(named, lambda x: x["name"].isNotNull()))

    made = computed(rows, {"__seasons": ordered(SEASONS), "__times": ordered(TIMES)})
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s - x["n"])
    made = computed(made, {"__season_votes": total("__seasons"), "__time_votes": total("__times"), **{f"__{k}{i}": F.get("__seasons", F.lit(i))[k] for k in ("n", "name") for i in (0, 1)}})
    both = F.try_divide(F.col("__n1") - F.col("__n0"), "__season_votes") <= near
    primary = F.when(F.col("__season_votes") > 0, F.when(both, F.array("__name0", "__name1")).otherwise(F.array("__name0")))
    time = F.when(F.col("__time_votes") > 0, F.get("__times", F.lit(0))["name"])
    none = F.lit(0).cast("long")
    found = F.struct(primary.alias("primary_seasons"), time.alias("primary_time"), F.nullif("__season_votes", none).alias("season_votes"), F.nullif("__time_votes", none).alias("time_votes"))
    return computed(made, {out: F.when((F.size("__seasons") > 0) | (F.size("__times") > 0), found)}).drop("__seasons", "__times", "__season_votes", "__time_votes", "__n0", "__n1", "__name0", "__name1")


def with_interest(rows: DataFrame, votes: str, out: str) -> DataFrame:
    """AG15: rows plus metrics.interest() of the have, had and want rows; null without votes. Of rows that repeat a label the last counts."""
    named = lambda r: F.lower(F.trim(F.coalesce(F.nullif(r["value"], F.lit("")), r["label"], F.lit(""))))
    count = lambda name: F.coalesce(_votes(F.try_element_at(F.filter(votes, lambda r: named(r) == name), F.lit(-1))), F.lit(0))
    made = computed(rows, {f"__{k}": count(k) for k in ("have", "had", "want")})
    have, had, want = (F.col(f"__{k}") for k in ("have", "had", "want"))
    return computed(made, {out: F.when(have + had + want > 0, M.interest(have, had, want))}).drop("__have", "__had", "__want")


def with_accords(rows: DataFrame, votes: str, identity: Column, out: str, most: int = 7) -> DataFrame:
    """AG16: rows plus a struct of all accords by falling share (junk goes, ties keep their order), the first `most`, and a sentence; null without any.

    identity is an array of the record's own name and brand, folded, which no accord may be.
    """
    own = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    placed = F.transform(F.filter(votes, lambda r: _label(r) != ""), lambda r, i: F.struct((-F.coalesce(r["pct"], F.lit(0.0))).alias("o"), i.alias("i"), _label(r).alias("label"), own(_label(r)).alias("own")))
    made = computed(rows, {"__placed": placed, "__identity": identity})
    good = F.array_sort(F.filter("__placed", lambda x: ~P.junk_accord(x["label"], folds=own) & ~((x["own"] != "") & F.array_contains("__identity", x["own"]))))
    made = computed(made, {"__good": good})
    made = computed(made, {"__top": F.transform(F.slice("__good", 1, most), lambda x: x["label"])})
    made = computed(made, {"__low": F.transform("__top", F.lower)})
    low, n = F.col("__low"), F.size("__low")
    head = F.get(low, F.lit(0))
    tail = F.when(n == 2, F.get(low, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(low, 2, F.greatest(n - 2, F.lit(0))), ", "), F.lit(" and "), F.get(low, n - 1)))
    said = F.when(n == 1, F.concat(F.lit("A predominantly "), head, F.lit(" fragrance."))).otherwise(F.concat(F.lit("A "), head, F.lit(" fragrance with "), tail, F.lit(" facets.")))
    vector = F.transform("__good", lambda x: F.struct(x["label"].alias("accord"), F.bround(-x["o"], 2).alias("score")))
    found = F.when(F.size("__good") > 0, F.struct(vector.alias("scent_vector"), F.col("__top").alias("top_accords"), said.alias("summary")))
    return computed(made, {out: found}).drop("__placed", "__identity", "__good", "__top", "__low")


def sentiment(pos: Column, neu: Column, neg: Column) -> Column:
    """AG11 of numbers of votes, a null counts as 0; null without votes."""
    pos, neu, neg = (F.coalesce(c.cast("long"), F.lit(0).cast("long")) for c in (pos, neu, neg))
    return F.when(pos + neu + neg > 0, F.struct(M.sentiment(pos, neu, pos + neu + neg).alias("score"), (pos + neu + neg).alias("votes")))


#: The cards of each group, by what their names hold.
CARD_OF = {
    "distribution": ("rating distribution",),
    "summary": ("fragrantica rating",),
    "longevity": ("longevity",),
    "sillage": ("sillage", "projection"),
    "value": ("price value", "value"),
    "wear": ("when to wear", "season"),
    "interest": ("community interest", "wardrobe"),
    "accords": ("main accord",),
}


def with_bundle(rows: DataFrame, cards: str, consensus: str, notes: str, name: str, brand: str, out: str = "metrics") -> DataFrame:
    """AG18: rows plus the struct of all their metrics: the groups, the headline that blends them, and whether each was there.

    notes is a struct of arrays (top, heart, base, flat); it is kept as it is where one of them has a note. No shuffle:
    votes are read once and each card is looked up once; what later steps read is a column of its own.
    """
    own = rows.withColumns({"__name": P.folded(F.col(name)), "__brand": P.folded(F.col(brand))})
    own = computed(own, {"__cards": counted(F.col(cards)), "__mine": F.array("__name", "__brand")})
    own = computed(own, {f"__c_{k}": card(F.col("__cards"), *names) for k, names in CARD_OF.items()})
    scores = {k: adequacy(F.col(f"__c_{k}"), worths)["score"] for k, worths in (("longevity", M.LONGEVITY), ("sillage", M.SILLAGE), ("value", M.VALUE))}
    own = computed(own, {f"__s_{k}": v for k, v in scores.items()})
    votes, layers = ("pos", "neu", "neg"), ("top", "heart", "base", "flat")
    own = own.withColumns({**{f"__v_{k}": F.col(consensus)[k] for k in votes}, **{f"__l_{k}": F.col(notes)[k] for k in layers}})
    filled = F.coalesce(F.size(F.concat(*[F.coalesce(f"__l_{k}", F.array().cast("array<string>")) for k in layers])) > 0, F.lit(False))
    groups = {
        "sentiment": sentiment(*[F.col(f"__v_{k}") for k in votes]),
        "performance": performance(*[F.col(f"__{x}_{k}") for x in "cs" for k in ("longevity", "sillage")]),
        "value": value(F.col("__c_value"), F.col("__s_value")),
        "notes": F.when(filled, F.col(notes)),
    }
    own = computed(own, {f"__g_{k}": g for k, g in groups.items()})
    own = with_rating(own, "__c_distribution", "__c_summary", "__g_rating")
    own = with_interest(own, "__c_interest", "__g_interest")
    own = with_wear(own, "__c_wear", "__g_wear_profile")
    own = with_accords(own, "__c_accords", F.col("__mine"), "__g_main_accords")
    blended, found = ("rating", "sentiment", "performance", "value", "interest"), ("rating", "sentiment", "performance", "value", "interest", "wear_profile", "main_accords", "notes")
    own = computed(own, {"__head": M.headline({k: F.col(f"__g_{k}")["score"] for k in blended})})
    covered = F.struct(*[F.col(f"__g_{k}").isNotNull().alias(k) for k in found])
    return own.select(*rows.columns, F.struct(F.col("__head").alias("headline"), *[F.col(f"__g_{k}").alias(k) for k in found], covered.alias("coverage")).alias(out))


def with_scorecard(rows: DataFrame, cards: str, consensus_pct: str, out: str = "scorecard") -> DataFrame:
    """AG19: rows plus the older card: rating, approval (positive and 0.35 neutral percent), labels scored by their words and weighted by percent.

    consensus_pct is a struct (pos, neu) of percents or null. Struct of overall, its four parts, and how many there are.
    No shuffle; a label's words are read once.
    """
    groups = {k: CARD_OF[k] for k in ("longevity", "sillage", "value")}
    own = computed(rows, {"__cards": counted(F.col(cards))})
    named = lambda needles: F.get(F.filter("__cards", lambda c: F.lower(c["card"]).rlike("|".join(needles))), F.lit(0))
    own = computed(own, {"__summary": _stated(card(F.col("__cards"), *CARD_OF["summary"]))["value"], **{f"__r_{k}": named(needles)["rows"] for k, needles in groups.items()}, **{f"__h_{k}": F.lower(named(needles)["card"]) for k, needles in groups.items()}})
    own = own.withColumns({"__pos": F.col(consensus_pct)["pos"], "__neu": F.col(consensus_pct)["neu"]})
    own = computed(own, {"__liked": F.col("__pos") + F.col("__neu") * NEUTRAL, "__stars": _stars(F.col("__summary")) / 5.0 * 100.0})

    def said(k: str) -> Column:
        text = lambda r: F.trim(F.regexp_replace(F.concat_ws(" ", f"__h_{k}", F.lower(r["label"])), "[^a-z0-9]+", " "))
        return F.transform(F.filter(f"__r_{k}", lambda r: r["pct"] > 0), lambda r: F.struct(text(r).alias("said"), r["pct"].alias("pct")))

    def worth(x: Column) -> Column:
        score = F.when(F.contains(x["said"], F.lit("very weak")), 18.0)
        for pattern, points in WORDS:
            score = score.when(x["said"].rlike(pattern), float(points))
        return F.struct(score.alias("worth"), x["pct"].alias("pct"))

    own = computed(own, {f"__t_{k}": said(k) for k in groups})
    own = computed(own, {f"__w_{k}": F.filter(F.transform(f"__t_{k}", worth), lambda x: x["worth"].isNotNull()) for k in groups})
    sums = lambda k, each: F.aggregate(f"__w_{k}", F.lit(0.0), lambda s, x: s + each(x))
    own = computed(own, {**{f"__a_{k}": sums(k, lambda x: x["worth"] * x["pct"]) for k in groups}, **{f"__b_{k}": sums(k, lambda x: x["pct"]) for k in groups}})
    within = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)))
    own = computed(own, {**{f"__p_{k}": F.try_divide(f"__a_{k}", f"__b_{k}") for k in groups}})
    own = computed(own, {"__approval": within(F.col("__liked")), **{f"__q_{k}": within(F.col(f"__p_{k}")) for k in groups}})
    own = computed(own, {"__works": M.blend({"a": F.col("__q_longevity"), "b": F.col("__q_sillage")}, {"a": 0.5, "b": 0.5})})
    parts = {"rating": F.col("__stars"), "approval": F.col("__approval"), "performance": F.col("__works"), "value": F.col("__q_value")}
    used = sum((p.isNotNull().cast("int") for p in parts.values()), F.lit(0))
    return own.select(*rows.columns, F.struct(M.blend(parts, SCORECARD).alias("overall"), *[p.alias(k) for k, p in parts.items()], used.alias("n_parts")).alias(out))


SCENT = "struct<scent_vector:array<struct<accord:string,score:double>>,top_accords:array<string>,summary:string>"


def sanitized(rows: DataFrame, scent: str, name: str, brand: str, out: str = "changed", most: int = 7) -> DataFrame:
    """MG25: rows whose stored accords (a struct of scent_vector, top_accords and summary) are without junk and the record's own identity,
    the vector by falling score, the top ones and the sentence made of it anew; out says whether that changed anything. A null stays one,
    as does a struct without a vector."""
    own = rows.withColumns({"__vector": F.col(scent)["scent_vector"], "__old": F.to_json(scent), "__name": P.folded(F.col(name)), "__brand": P.folded(F.col(brand))})
    as_rows = F.transform("__vector", lambda x: F.struct(x["accord"].alias("label"), F.lit(None).cast("string").alias("value"), x["score"].alias("pct"), F.lit(None).cast("string").alias("count"), F.lit(0).cast("bigint").alias("votes")))
    own = computed(own, {"__rows": F.coalesce(as_rows, F.array().cast(ROWS))})
    made = with_accords(own, "__rows", F.array("__name", "__brand"), "__new", most)
    new = F.coalesce(F.col("__new"), F.struct(F.array().cast("array<struct<accord:string,score:double>>").alias("scent_vector"), F.array().cast("array<string>").alias("top_accords"), F.lit(None).cast("string").alias("summary")))
    kept = F.when(F.col("__vector").isNull(), F.col(scent)).otherwise(new.cast(SCENT))
    made = made.withColumn("__kept", kept)
    return made.select(*[F.col("__kept").alias(scent) if c == scent else F.col(c) for c in rows.columns], F.coalesce(~F.to_json("__kept").eqNullSafe(F.col("__old")), F.lit(False)).alias(out))
