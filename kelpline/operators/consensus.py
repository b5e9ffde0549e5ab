"""Votes over evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: An answer is ambiguous if the second has this share and the first less than so many times as much.
SECOND, TIMES, DOMINANT = 25.0, 2.0, 35.0


def ballots(rows: DataFrame, query: str, choice: str, weight: Column) -> DataFrame:
    """AG24, AG25: each query's winner by summed weights, shares in percent, runner-up, and whether it is ambiguous.

    The weights are summed per choice first, so the window sees a row a choice.
    """
    sums = rows.groupBy(query, choice).agg(F.sum(weight).alias("w"))
    at = W.partitionBy(query)
    order = at.orderBy(F.desc("w"), choice)
    ranked = sums.withColumns({"share": F.col("w") * 100.0 / F.sum("w").over(at), "r": F.row_number().over(order), "runner_up": F.lead(choice).over(order)})
    ranked = ranked.withColumn("runner_share", F.coalesce(F.lead("share").over(order), F.lit(0.0)))
    unclear = (F.col("runner_share") >= SECOND) & (F.col("share") < TIMES * F.col("runner_share")) | (F.col("share") < DOMINANT)
    return ranked.where("r = 1").select(query, F.col(choice).alias("winner"), "share", "runner_up", "runner_share", unclear.alias("ambiguous"))


def unique_year(evidence: DataFrame, key: str, year: str, domain: str) -> DataFrame:
    """AG26: the year where all evidence names one; confidence 98 with two domains or more, else 95."""
    sums = evidence.groupBy(key).agg(F.min(year).alias("year"), F.max(year).alias("__high"), F.count_distinct(domain).alias("domains"), F.count("*").alias("evidence_count"))
    return sums.where(F.col("year") == F.col("__high")).select(key, "year", F.when(F.col("domains") >= 2, 98).otherwise(95).alias("confidence"), "evidence_count")


def majority(rows: DataFrame, query: str, label: str, position: str) -> DataFrame:
    """AG28: the label that max(2, half) of a query's rows share; ties: the one seen first."""
    sums = rows.groupBy(query, label).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    best = sums.groupBy(query).agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), "p")).alias("b"), F.sum("n").alias("total"))
    return best.where(F.col("b.n") >= F.greatest(F.lit(2), F.ceil(F.col("total") / 2))).select(query, F.col(f"b.{label}").alias(label), F.col("b.n").alias("n"))


#: A sentence, a statement of a release in it, marks of a date that is no release, and the statement where it follows a name at once.
SENTENCE = r"[^.!?\n]+(?:[.!?]|$)"
RELEASE = r"(?i)\b(?:was\s+|is\s+)?(?:first\s+)?(?:released|launched|introduced|debuted|created)\s+(?:in|on|during)\s+((?:17|18|19|20)\d{2})\b"
DATED = r"(?i)(?:\b(?:copyright|updated|published|posted)\b|\b©\b)"
AT_ONCE = r"\s+(?:(?:was|is)\s+)?(?:first\s+)?(?:released|launched|introduced|debuted|created)\s+(?:in|on|during)\s+(?:17|18|19|20)\d{2}\b"


def _words_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def release_years(rows: DataFrame, key: str, brand: str, name: str, title: str, snippet: str, host: Column, now_year: int) -> DataFrame:
    """SF27: (key, year, domain, sentence): what sentences of snippets state as the release of a fragrance, each once.

    The sentence says "released", "launched" and so on in a year from 1700 to next year that is no word of brand or name, at once after the
    very name; before the name stands nothing, or a word of the brand; and the brand stands there or in the title.
    Sentences of copyrights and updates say nothing. Each sentence is a row of its own: nothing of a key is gathered. Nulls give no rows.
    """
    own = rows.select(key, _words_only(F.col(brand)).alias("__b"), _words_only(F.col(name)).alias("__n"), _words_only(F.col(title)).alias("__t"), F.lower(F.coalesce(host, F.lit(""))).alias("domain"), F.explode(F.regexp_extract_all(F.coalesce(F.col(snippet), F.lit("")), F.lit(SENTENCE), F.lit(0))).alias("__raw"))
    own = own.select(key, "__b", "__n", "__t", "domain", F.trim(F.regexp_replace("__raw", r"(?U)\s+", " ")).alias("sentence")).where(F.col("sentence").rlike(RELEASE) & ~F.col("sentence").rlike(DATED) & (F.col("__n") != ""))
    own = own.withColumns({"year": F.regexp_extract("sentence", RELEASE, 1).cast("int"), "__s": _words_only(F.col("sentence"))})
    before = F.when(F.col("__b") != "", F.concat(F.lit("|(?:^|\\s)(?:"), F.replace("__b", F.lit(" "), F.lit("|")), F.lit(")\\s"))).otherwise("")
    leads = F.regexp_like("__s", F.concat(F.lit("(?:^"), before, F.lit(")"), "__n", F.lit(AT_ONCE)))
    identity = F.concat(F.lit(" "), "__b", F.lit(" "), "__n", F.lit(" "))
    stated = (F.col("__b") == "") | F.contains("__s", F.col("__b")) | F.contains("__t", F.col("__b"))
    good = F.col("year").between(1700, now_year + 1) & ~F.contains(identity, F.concat(F.lit(" "), F.col("year").cast("string"), F.lit(" "))) & leads & stated
    return own.where(good).groupBy(key, "year", "domain", "__s").agg(F.min("sentence").alias("sentence")).select(key, "year", "domain", "sentence")
