"""Queries of query repair, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from ..sources.tables import table as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def kept(made):
        QUERIES[name] = made
        if sql:
            ORACLES[name] = sql
        return made

    return kept


def _words(rows, column: str, out: str):
    """Distinct words of a column, letters only, in lower case."""
    return rows.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))).alias(out))


_NAMES = "SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part"


@query("near_words", f"""WITH n AS ({_NAMES}), a AS (SELECT w AS word FROM n UNION SELECT w[1] || w[3:] FROM n), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS known FROM documents)
  SELECT word, known, levenshtein(word, known)::INT AS distance FROM a, k WHERE abs(length(word) - length(known)) <= 2 AND levenshtein(word, known) <= 2""")
def near_words(spark, d):
    names = _words(t(spark, d, "part"), "p_name", "word").distinct()
    asked = names.unionByName(names.select(F.concat(F.substring("word", 1, 1), F.substr("word", F.lit(3))).alias("word")))
    return repair.near_words(asked, _words(t(spark, d, "documents"), "text", "known"), "word", "known")


@query("repaired_words")
def repaired_words(spark, d):
    """Every word of benchmark texts and part names that lost its second letter, by the words of all documents."""
    known = _words(t(spark, d, "documents"), "text", "known").groupBy("known").agg(F.count("*").alias("often"))
    meant = _words(t(spark, d, "benchmark"), "text", "word").unionByName(_words(t(spark, d, "part"), "p_name", "word")).distinct()
    lost = meant.select(F.concat(F.substring("word", 1, 1), F.substr("word", F.lit(3))).alias("word"))
    return repair.repaired_words(lost, known, "word", "known", "often")


@query("query_evidence", """WITH e AS (SELECT user_id % 40 AS q, event_type || ' item ' || (user_id % 7) AS key, CASE WHEN user_id % 3 = 0 THEN 'fragrantica.com' WHEN user_id % 3 = 1 THEN 'site' || user_id % 5 || '.org' ELSE '' END AS host, event_id % 4 = 0 AS proven, event_id % 5 = 0 AS direct, event_id % 2 = 0 AS title, (event_id % 8)::DOUBLE / 8 AS bonus FROM events)
  SELECT q, key, count(*) AS occurrences, count(*) FILTER (proven) AS proven, count(*) FILTER (title) AS title, count(*) FILTER (direct) AS direct, sum(bonus) AS bonus, coalesce(string_agg(DISTINCT CASE WHEN host <> '' AND ((proven AND host = 'fragrantica.com') OR direct) THEN host END, '|' ORDER BY CASE WHEN host <> '' AND ((proven AND host = 'fragrantica.com') OR direct) THEN host END), '') AS domains FROM e GROUP BY 1, 2""")
def query_evidence(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    text = F.concat(F.when(e % 2 == 0, F.initcap("event_type")).otherwise(F.upper("event_type")), F.lit(" Item  "), (u % 7).cast("string"), F.when(e % 3 == 0, F.lit(" perfume?")).otherwise(""))
    host = F.when(u % 3 == 0, "www.Fragrantica.com").when(u % 3 == 1, F.concat(F.lit("Site"), (u % 5).cast("string"), F.lit(".org")))
    rows = t(spark, d, "events").select((u % 40).alias("q"), text.alias("text"), "event_id", host.alias("host"), (e % 4 == 0).alias("proven"), (e % 5 == 0).alias("direct"), (e % 2 == 0).alias("title"), ((e % 8) / 8).alias("bonus"))
    found = repair.evidence(rows, "q", "text", "event_id", "host", "proven", "title", "direct", "bonus")
    return found.select("q", "key", "occurrences", "proven", "title", "direct", "bonus", F.array_join(F.array_sort("domains"), "|").alias("domains"))


@query("query_suggestions")
def query_suggestions(spark, d):
    """The repair of every part's damaged name, by what order lines say of parts of its brand."""
    p, sold = t(spark, d, "part"), t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    asked = p.select("p_brand", F.regexp_replace("p_name", r"(\w)\w(\w+)$", "$1$2").alias("query"), "p_name").distinct()
    names = p.join(sold, p["p_partkey"] == sold["l_partkey"]).groupBy("p_brand", F.col("p_name").alias("candidate")).agg(F.sum("n").alias("n"), F.min("p_partkey").alias("pos"))
    rows = asked.join(names, "p_brand").where(F.array_size(F.array_intersect(F.split("p_name", " "), F.split("candidate", " "))) > 0)
    rows = rows.select(F.concat_ws(" ", "p_brand", "query").alias("query"), F.concat_ws(" ", "p_brand", "candidate").alias("candidate"), "pos", F.lit("www.fragrantica.com").alias("source"), (F.col("pos") % 2 == 0).alias("proven"), F.lit(False).alias("title"), (F.col("pos") % 2 == 1).alias("direct"), (F.col("n") / 1e6).alias("bonus"))
    made = repair.evidence(rows, "query", "candidate", "pos", "source", "proven", "title", "direct", "bonus")
    return repair.suggestions(made, "query").select("query", "suggestion", F.round("score", 9).alias("score"))


@query("anchor_queries", f"""WITH q AS (SELECT p_partkey, lower(trim(regexp_replace(p_type || ' ' || p_name || ' ' || p_size, '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM part),
  w AS (SELECT p_partkey, norm, list_filter(string_split(norm, ' '), lambda x: x <> '' AND x NOT IN ({", ".join(f"'{g}'" for g in repair.GENERIC)})) AS w FROM q),
  r AS (SELECT p_partkey, w, norm, len(w) AS n, i, k, w[(i + 1):(i + k)] AS a FROM w, range(0, 12) s(i), (VALUES (2), (3)) v(k) WHERE len(w) >= 3 AND i + k <= len(w) AND (k = 2 OR len(w) >= 4)),
  b AS (SELECT p_partkey, arg_max(array_to_string(a, ' '), [(i = 0)::INT, -(i + k = n)::INT, k, len(list_filter(a, lambda x: length(x) >= 5)), len(list_filter(a, lambda x: length(x) >= 4)), list_sum(list_transform(a, lambda x: length(x)))::INT, -i::INT]) AS best FROM r WHERE list_min(list_transform(a, lambda x: length(x))) >= 3 AND array_to_string(a, ' ') <> norm GROUP BY 1)
  SELECT p_partkey, CASE WHEN len(w) < 3 THEN '' WHEN length(w[-1]) <= 2 AND length(w[-2]) >= 3 AND w[-2] || ' ' || w[-1] <> norm THEN w[-2] || ' ' || w[-1]
    WHEN len(w) >= 4 AND length(w[1]) <= 3 AND length(w[-1]) <= 3 AND array_to_string(w[2:], ' ') <> norm THEN array_to_string(w[2:], ' ') ELSE coalesce(best, '') END AS anchor FROM w LEFT JOIN b USING (p_partkey)""")
def anchor_queries(spark, d):
    identity = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", "p_type", "p_name", "p_size"), "[^A-Za-z0-9]+", " ")))
    return t(spark, d, "part").select("p_partkey", repair.anchor_query(identity).alias("anchor"))
