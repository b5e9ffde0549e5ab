"""Labels of metric cards: which card a title names, and which known label a text holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import computed

#: Titles of cards without other than letters, and the card they mean.
TITLES = {
    "pricevalue": "price value", "valueformoney": "price value", "longevity": "longevity", "sillage": "sillage", "projection": "projection",
    "gender": "gender", "whentowear": "when to wear", "season": "season",
}
_WEAK, _LASTING, _WORTH, _WHEN = (("Very Weak",), ("Weak", "Soft")), (("Long Lasting", "Long-Lasting", "Longlasting"), ("Eternal",)), (("Way Overpriced",), ("Overpriced",), ("Ok", "Okay"), ("Good Value",), ("Great Value",)), (("Winter",), ("Spring",), ("Summer",), ("Fall", "Autumn"), ("Day",), ("Night",), ("Day or Night",))
_TRAIL = (("Intimate", "Close"), ("Moderate",), ("Strong", "Heavy"), ("Enormous", "Room Filling"))
#: Each card's labels, every one with its other names, in the order in which cards are looked for in longer titles.
LABELS = {
    "longevity": (*_WEAK, ("Moderate",), *_LASTING),
    "sillage": (*_TRAIL, *_WEAK, *_LASTING),
    "projection": _TRAIL,
    "gender": (("Female",), ("More Female", "More Feminine"), ("Unisex",), ("More Male", "More Masculine"), ("Male",)),
    "price value": _WORTH,
    "value": _WORTH,
    "when to wear": _WHEN,
    "season": _WHEN,
}
#: Most rows of aliases that are broadcast after a count.
FEW = 100_000


def card_key(title: Column) -> Column:
    """SC9: the card that a title names: by its letters alone, else the first card whose name it holds; empty for others."""
    low = F.lower(F.coalesce(title, F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    held = F.filter(F.array(*[F.lit(k) for k in LABELS]), lambda k: F.contains(low, k))
    return F.coalesce(F.try_element_at(table, F.regexp_replace(low, "[^a-z]", "")), F.get(held, F.lit(0)), F.lit(""))


def known_aliases(spark) -> DataFrame:
    """card, alias, label of the fixed labels."""
    return spark.createDataFrame([(card, alias, group[0]) for card, groups in LABELS.items() for group in groups for alias in group], "card string, alias string, label string")


def canonical_labels(rows: DataFrame, card: str, text: str, aliases: DataFrame, out: str = "canonical") -> DataFrame:
    """SC9: rows plus the label whose alias, of the same card, a text is or holds as whole words: the longest alias, of equal ones the greatest label; empty without one.

    A dictionary of any size: its aliases are keyed by their words, a text offers its runs of up to as many words as the
    longest alias has, and both meet in a join (by broadcast where the aliases were counted to be few). Texts are compared
    normalized. Repeated rows stay; a null text or card has none.
    """
    known = X.with_clean(aliases.select("card", "alias", "label"), {"__a": F.col("alias")}).select("card", F.col("__a_n").alias("__key"), "label").where("__key <> ''")
    known = known.groupBy("card", "__key").agg(F.max("label").alias("label")).withColumn("__n", F.size(F.split("__key", " ")))
    longest = known.agg(F.max("__n")).first()[0] or 0
    texts = rows.select(F.col(card).alias("card"), F.col(text).alias("__text")).distinct()
    texts = X.with_clean(texts, {"__t": F.col("__text")})
    texts = computed(texts, {"__words": F.filter(F.split("__t_n", " "), lambda w: w != "")})
    sizes = F.array(*[F.lit(k) for k in range(1, longest + 1)]) if longest else F.array().cast("array<int>")
    runs = F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("__words"), F.lit(1))), lambda i: i + k <= F.size("__words") + 1), lambda i: F.array_join(F.slice("__words", i, k), " ")))))
    offered = texts.select("card", "__text", F.explode(runs).alias("__key"))
    side = F.broadcast(known) if known.count() <= FEW else known
    best = offered.join(side, ["card", "__key"]).groupBy("card", "__text").agg(F.max(F.struct(F.length("__key").alias("k"), F.col("label").alias("label"))).alias("b"))
    best = best.select(F.col("card").alias(card), F.col("__text").alias(text), F.col("b.label").alias("__found"))
    return rows.join(best, [card, text], "left").withColumn(out, F.coalesce("__found", F.lit(""))).select(*rows.columns, out)
