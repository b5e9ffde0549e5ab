"""Votes to scores. Every step is a partial sum: a product with a third of all votes is no special case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What each label of a vote is worth, 0 to 100.
LONGEVITY = {"Very Weak": 20, "Weak": 40, "Moderate": 70, "Long Lasting": 90, "Eternal": 100}
SILLAGE = {"Intimate": 55, "Moderate": 80, "Strong": 85, "Enormous": 70}
VALUE = {"Way Overpriced": 20, "Overpriced": 40, "Ok": 60, "Good Value": 80, "Great Value": 100}
#: Weights of the blended scores.
PERFORMANCE = {"longevity": 0.60, "sillage": 0.40}
INTEREST = {"popularity": 0.60, "want": 0.25, "retention": 0.15}
HEADLINE = {"rating": 0.45, "sentiment": 0.20, "performance": 0.15, "value": 0.10, "interest": 0.10}
BANDS = ((85, "Crowd Favorite"), (70, "Well Liked"), (55, "Generally Liked"), (40, "Mixed Reception"))
LOWEST = "Polarizing"


def worth(label: Column, values: dict[str, int]) -> Column:
    """A label's worth whatever its case; null for others."""
    out = reduce(lambda w, kv: w.when(F.lower(F.trim(label)) == kv[0].lower(), kv[1]), list(values.items())[1:], F.when(F.lower(F.trim(label)) == next(iter(values)).lower(), next(iter(values.values()))))
    return out


def weighted_adequacy(votes: DataFrame, keys: list[str], label: str, count: str, values: dict[str, int]) -> DataFrame:
    """AG8, AG13: sum(worth * votes) / sum(votes) over known labels with votes; null where there are none."""
    w = worth(F.col(label), values)
    known = w.isNotNull() & (F.col(count) > 0)
    sums = votes.groupBy(*keys).agg(F.sum(F.when(known, w * F.col(count))).alias("__s"), F.sum(F.when(known, F.col(count))).alias("votes"))
    return sums.select(*keys, (F.col("__s").cast("double") / F.col("votes").cast("double")).alias("score"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))


def blend(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """AG12: the weighted mean of what is there, weights renormalised; null where nothing is."""
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    above = total([F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in weights.items()])
    below = total([F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()])
    return F.when(below > 0, above / below)


def interest(have: Column, had: Column, want: Column) -> Column:
    """AG15: struct of want and retention ratios, a logarithmic popularity up to 100, and their blend."""
    n = have + had + want
    want_ratio, kept = F.try_divide(want.cast("double"), (have + want).cast("double")), F.try_divide(have.cast("double"), (have + had).cast("double"))
    popularity = F.least(F.lit(100.0), F.log10(n.cast("double") + 1) / 5 * 100)
    score = F.when(n > 0, blend({"want": want_ratio * 100, "retention": kept * 100, "popularity": popularity}, INTEREST))
    return F.struct(want_ratio.alias("want_ratio"), kept.alias("retention_ratio"), popularity.alias("popularity_index"), score.alias("score"))


def sentiment(positive: Column, neutral: Column, total: Column) -> Column:
    """AG11: (positive + half the neutral) / total * 100."""
    return F.try_divide((positive + neutral / 2.0) * 100.0, total.cast("double"))


def headline(parts: dict[str, Column]) -> Column:
    """AG17: struct of the half-even whole score, the raw one, its band's label and how many parts it rests on."""
    raw = blend(parts, HEADLINE)
    whole = F.bround(raw).cast("int")
    label = F.when(raw.isNull(), F.lit(None).cast("string"))
    for least, name in BANDS:
        label = label.when(whole >= least, name)
    used = reduce(lambda a, b: a + b, [parts[k].isNotNull().cast("int") for k in HEADLINE])
    return F.struct(whole.alias("score"), raw.alias("score_raw"), label.otherwise(LOWEST).alias("label"), used.alias("n_components"))


def rating(votes: DataFrame, keys: list[str], stars: str, count: str) -> DataFrame:
    """AG10: mean stars as a share of 5, share of 4 and 5 stars in percent, and all votes."""
    n = F.col(count).cast("long")
    sums = votes.where((F.col(stars).between(1, 5)) & (n > 0)).groupBy(*keys).agg(F.sum(F.col(stars) * n).alias("__s"), F.sum(F.when(F.col(stars) >= 4, n).otherwise(0)).alias("__p"), F.sum(n).alias("votes"))
    return sums.select(*keys, (F.col("__s") * 20.0 / F.col("votes")).alias("score"), (F.col("__p") * 100.0 / F.col("votes")).alias("positive_share"), F.col("votes").cast("long").alias("votes"))


def distribution(counts: DataFrame, card: str, label: str, count: str) -> DataFrame:
    """AG20, AG22: each label's percent of its card, and whether it is the dominant one (ties: first label).

    counts has one row a label, so a card is as small as its labels are few.
    """
    at = W.partitionBy(card)
    top = F.row_number().over(at.orderBy(F.desc(count), label)) == 1
    return counts.select(card, label, count, (F.col(count) * 100.0 / F.sum(count).over(at)).alias("pct"), top.alias("dominant"))


def max_normalized(counts: DataFrame, card: str, label: str, count: str) -> DataFrame:
    """AG21: each label's share of its card's largest; labels without votes go."""
    return counts.where(F.col(count) > 0).select(card, label, count, (F.col(count).cast("double") / F.max(count).over(W.partitionBy(card))).alias("share"))


def main_accords(accords: Column, junk: tuple[str, ...] = (), most: int = 7) -> Column:
    """AG16: of an array of structs (label, pct), the largest by pct without junk labels; ties keep their order."""
    placed = F.transform(F.filter(accords, lambda x: ~F.lower(x["label"]).isin(*junk) if junk else F.lit(True)), lambda x, i: F.struct((-x["pct"]).alias("o"), i.alias("i"), x["label"].alias("label"), x["pct"].alias("pct")))
    return F.transform(F.slice(F.array_sort(placed), 1, most), lambda x: F.struct(x["label"].alias("label"), x["pct"].alias("pct")))


def wear_profile(votes: DataFrame, keys: list[str], label: str, count: str, near: float = 0.05) -> DataFrame:
    """AG14: the season with the most votes and a second one if its share is within `near`; ties by name."""
    shares = votes.groupBy(*keys, label).agg(F.sum(count).alias("n"))
    ordered = shares.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(label).alias("label")))).alias("s"), F.sum("n").alias("total"))  # a row a label
    second = F.get("s", F.lit(1))
    keeps = (second["o"] - F.get("s", F.lit(0))["o"]) / F.col("total") <= near
    return ordered.select(*keys, F.get("s", F.lit(0))["label"].alias("primary"), F.when(keeps, second["label"]).alias("second"), F.col("total").cast("long").alias("votes"))


def merge_passes(rows: DataFrame, card: str, label: str, order: str) -> DataFrame:
    """AG23: the earliest pass wins for a card's label whatever its case; percents outside 0 to 100 go."""
    kept = rows.where(F.col("pct").between(0, 100)).withColumn("__label", F.lower(F.trim(label)))
    best = kept.groupBy(card, "__label").agg(F.min_by(F.struct(*[c for c in rows.columns]), order).alias("e"))
    return best.select("e.*")
