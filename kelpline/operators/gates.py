"""What may be shown, stored or queued: gates on candidates, and the answers that pass them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import computed, unused
from . import identity, keys
from . import predicates as P

#: The score that a record found by identity needs to answer for a fact, and the priority of jobs that a sweep queues.
FACT_SCORE, SWEPT = 0.98, -10
#: The fields of a row of search results.
SHOWN = ("id", "name", "house", "year", "gender", "concentration", "image_url", "fg_url", "bn_url", "score", "source")


def _weak(text: Column) -> Column:
    return (text == "") | (F.lower(text) == "unknown") | ~P.looks_real(text)


def displayable(rows: DataFrame, name: str, house: str, url: str, second_url: str) -> DataFrame:
    """PF13: rows whose name and house, read from their addresses where they are weak, can be shown; both are put right, and a name that is its house again is no name."""
    found = keys.recovered(rows, name, house, url, second_url)
    own = computed(found, {"__n": F.col(name), "__h": F.col(house)})
    return own.where(~_weak(F.col("__n")) & ~_weak(F.col("__h")) & ~P.house_echo(F.col("__n"), F.col("__h"))).select(*found.columns)


def storable(name: Column, house: Column, url: Column) -> Column:
    """PF12: whether an identity may be stored: name and house are there, neither an echo nor a remainder, and a perfume's address names them too, if there is one."""
    named = X.site_url(url).rlike(X.SITE_PERFUME)
    agrees = F.arrays_overlap(X.tokens(name), X.tokens(X.name_in_url(X.site_url(url)))) | F.arrays_overlap(X.tokens(name), X.tokens(X.brand_in_url(X.site_url(url))))
    return P.safe_identity(name, house) & (~F.coalesce(named, F.lit(False)) | agrees)


def queueable(rows: DataFrame, name: str, house: str, url: str, second_url: str, year: str, priority: int = SWEPT) -> DataFrame:
    """EX9: rows as jobs (job_key, name, house, year, fg_url, bn_url, priority), once a key, without what is no perfume or has no key.

    The key is the main address, else the second, else the identity. Of rows of one key that of least name, house counts.
    """
    flagged = P.non_perfume(F.col(name), F.col(house), F.col(url), F.col(second_url), F.lit(None).cast("string"))
    ident = F.concat_ws("|", X.audit_key(F.coalesce(house, F.lit(""))), X.audit_key(F.coalesce(name, F.lit(""))))
    main, second = (F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in (url, second_url))
    own = computed(rows, {"__no": flagged["flag"], "__site": X.site_url(main), "__second": X.canonical_url(second), "__ident": ident})
    key = F.coalesce(F.when(F.col("__site").rlike(X.SITE_PERFUME), F.col("__site")), "__second", F.when(F.col("__ident") != "|", F.concat(F.lit("id:"), "__ident")))
    jobs = computed(own, {"__key": key}).where(~F.col("__no") & F.col("__key").isNotNull())
    first = jobs.groupBy(F.col("__key").alias("job_key")).agg(F.min(F.struct(F.coalesce(name, F.lit("")).alias("name"), F.coalesce(house, F.lit("")).alias("house"), F.col(year).cast("string").alias("year"), main.alias("fg_url"), second.alias("bn_url"))).alias("j"))
    return first.select("job_key", "j.*", F.lit(priority).alias("priority"))


def fact_records(items: DataFrame, records: DataFrame, item: str) -> DataFrame:
    """(item, record_key, by): the record that answers for an item: by its first address, its second, or else its identity.

    items: item, name, house, fg_url, bn_url; records: record_key, name, house, fg_url, bn_url. By identity the record must have the
    item's words in house and name, and a relevance of 0.98; of several the best, then the least key. Records are one row a
    key in every join. Items without a record are left out.
    """
    found = None
    for rank, c in enumerate(("fg_url", "bn_url")):
        known = records.where(F.col(c) != "").groupBy(c).agg(F.min("record_key").alias("record_key"))
        hits = items.where(F.col(c) != "").join(known, c).select(item, F.struct(F.lit(rank).alias("p"), F.lit(0.0).alias("s"), "record_key").alias("h"))
        found = hits if found is None else found.unionByName(hits)
    direct = found.groupBy(item).agg(F.min("h").alias("h"))
    words = lambda n, h: F.array_join(F.array_sort(X.tokens(F.concat_ws(" ", F.col(h), F.col(n)))), " ")
    rest = items.join(direct.select(item), item, "left_anti").select(item, words("name", "house").alias("__w"), F.trim(F.concat_ws(" ", "house", "name")).alias("__sought")).where("__w <> ''")
    named = records.select("record_key", words("name", "house").alias("__w"), F.col("name").alias("__rname"), F.col("house").alias("__rhouse"))
    # of records that say the same in the same words one is scored
    named = named.groupBy("__w", "__rname", "__rhouse").agg(F.min("record_key").alias("record_key"))
    scored = identity.with_relevance(rest.join(named, "__w"), "__sought", "__rname", "__rhouse").where(F.col("score") >= FACT_SCORE)
    by_name = scored.groupBy(item).agg(F.min(F.struct(F.lit(2).alias("p"), (-F.col("score")).alias("s"), "record_key")).alias("h"))
    return direct.unionByName(by_name).select(item, "h.record_key", F.element_at(F.array(*[F.lit(x) for x in ("fg_url", "bn_url", "identity")]), F.col("h.p") + 1).alias("by"))


def with_catalogue(results: DataFrame, catalogue: DataFrame, query: str, key: list[str], score: str, cap: int) -> DataFrame:
    """SO2: results with the catalogue's rows behind them that they lack, each identity once, the first `cap` of a query; rank and origin tell the place.

    Both have the same columns. Results come first, by score, then the catalogue, by score; of equal keys (not null) the first stays.
    """
    unused(results, "origin", "rank")
    both = results.withColumn("origin", F.lit(0)).unionByName(catalogue.withColumn("origin", F.lit(1)))
    columns = [c for c in both.columns if c not in (query, *key)]
    order = F.struct("origin", F.negative(F.coalesce(F.col(score), F.lit(0.0))), *[c for c in columns if c not in ("origin", score)])
    once = both.groupBy(query, *key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(query, *key, "r.*")
    at = W.partitionBy(query).orderBy("origin", F.desc_nulls_last(score), *key)
    return once.withColumn("rank", F.row_number().over(at).cast("long")).where(F.col("rank") <= cap)


def shown(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """PF31, PF33: rows as a search shows them: the 11 fields in their order, blank texts for missing ones; fields says where they are."""
    return rows.select(*[(F.coalesce(fields[k].cast("string"), F.lit("")) if k in fields else F.lit("")).alias(k) for k in SHOWN])
