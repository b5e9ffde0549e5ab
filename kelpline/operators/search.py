"""Tiered retrieval over a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.steps import unused

#: Most rows of an answer; of one for a query that names a brand alone.
CAP, BRAND_CAP = 24, 50


def matches(text: Column, query: Column) -> Column:
    """PF4: one token of one or two characters matches whole words alone, other queries any part; a blank one nothing.

    % and _ are wildcards and a backslash takes the next character as it stands; in short queries all stand for themselves.
    """
    q = F.trim(query)
    short = (F.length(q) <= 2) & ~q.rlike(r"\s")
    word = F.concat(F.lit(r"(?i)(^|[^\p{L}\p{N}])"), F.regexp_replace(q, r"([^\p{L}\p{N}])", r"\\$1"), F.lit(r"([^\p{L}\p{N}]|$)"))
    # LIKE knows a backslash before %, _ and itself alone
    part = F.regexp_replace(F.concat(F.lit("%"), F.lower(q), F.lit("%")), r"(\\[%_\\])|\\(.)", "$1$2")
    return F.when(q == "", F.lit(False)).when(short, F.regexp_like(text, word)).otherwise(F.like(F.lower(text), part))


def tier(query: Column, name: Column, brand: Column, forms: tuple[str, ...] = ()) -> Column:
    """0 the brand has an alias form of the query, 1 brand and name together match, 2 the name, 3 the brand, 4 name and brand; null if nothing.

    forms are alias forms of a brand; those of fewer than three letters are left out, as are all for a short query.
    """
    both, flipped = F.concat_ws(" ", brand, name), F.concat_ws(" ", name, brand)
    long = [f.strip() for f in forms if len(f.strip()) >= 3]
    alias = F.lit(False)
    for form in long:
        alias = alias | F.contains(F.lower(brand), F.lit(form.lower()))
    q = F.trim(query)
    asked = (F.length(q) > 2) | q.rlike(r"\s")
    return F.when(asked & alias, 0).when(matches(both, query), 1).when(matches(name, query), 2).when(matches(brand, query), 3).when(matches(flipped, query), 4)


def search(catalog: DataFrame, query: str, key: str, name: str, brand: str, seen: str, cap: int = 15, forms: tuple[str, ...] = ()) -> DataFrame:
    """PF2, W2: the best rows for one query by tier, then the latest seen (ties by key), 1 to 50 of them: a top-k, so no global sort."""
    found = unused(catalog, "tier").withColumn("tier", tier(F.lit(query), F.col(name), F.col(brand), forms)).where("tier is not null")
    return found.orderBy("tier", F.desc(seen), key).limit(max(1, min(cap, BRAND_CAP)))


def search_batch(catalog: DataFrame, queries: DataFrame, key: str, name: str, brand: str, seen: str, cap: int = CAP, most: int = 1_000) -> DataFrame:
    """The same for a stated set of queries (query_id, query): a block of queries against all rows.

    The set is counted and must have `most` queries at most, so what is broadcast is bounded; each row is held against each of
    them, so the work is rows times queries. The window's partial top-k keeps `cap` rows of a query in each task before
    the shuffle. Columns tier, rank, query and query_id of the catalogue are refused.
    """
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries: search them in blocks")
    t = tier(F.col("query"), F.col(name), F.col(brand))
    found = unused(catalog, "tier", "rank", "query", "query_id").join(F.broadcast(queries), t.isNotNull()).withColumn("tier", t)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("tier", F.desc(seen), key)).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= cap)


def first_nonempty_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """SO1: for each key the rows of the first table that has any."""
    rows = unused(tiers[0], "source_tier").withColumn("source_tier", F.lit(0))
    for i, more in enumerate(tiers[1:], 1):
        rows = rows.unionByName(more.withColumn("source_tier", F.lit(i)))
    best = rows.groupBy(key).agg(F.min("source_tier").alias("source_tier"))
    return rows.join(best, [key, "source_tier"], "left_semi")


def query_variants(query: Column, most: int = 8) -> Column:
    """SF23: the query, its pairs of neighbouring words, first and last word, and words of five letters."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    n = F.size(words)
    pairs = F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    ends = F.when(n > 2, F.array(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, n - 1)))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(F.array(F.concat_ws(" ", words)), pairs, ends, F.filter(words, lambda w: F.length(w) >= 5))), 1, most)
