"""Scores, audit, merge and state queries."""

from __future__ import annotations


from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, consensus, facts, merge, metrics, state
from ..sources.tables import table as t

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


NOW = "2024-01-31 00:00:00"
#: How the test tables' codes stand for labels of a vote.
_FLAG = {"A": "Weak", "N": "Moderate", "R": "Long Lasting"}


def _label(column, mapping):
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


@query("weighted_adequacy", "SELECT l_suppkey, sum(w * q)::DOUBLE / sum(q)::DOUBLE AS score, sum(q)::BIGINT AS votes FROM (SELECT l_suppkey, l_quantity::BIGINT AS q, CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN 70 WHEN 'R' THEN 90 END AS w FROM lineitem) GROUP BY l_suppkey")
def weighted_adequacy(spark, d):
    votes = t(spark, d, "lineitem").select("l_suppkey", _label("l_returnflag", _FLAG).alias("label"), F.col("l_quantity").cast("long").alias("q"))
    return metrics.weighted_adequacy(votes, ["l_suppkey"], "label", "q", metrics.LONGEVITY)


@query("performance_blend", """WITH a AS (SELECT l_partkey, sum(CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN 70 WHEN 'R' THEN 90 END * l_quantity::BIGINT)::DOUBLE / sum(l_quantity::BIGINT) AS s FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1),
  b AS (SELECT l_partkey, sum(CASE l_linestatus WHEN 'O' THEN 85 WHEN 'F' THEN 55 END * l_quantity::BIGINT)::DOUBLE / sum(l_quantity::BIGINT) AS s FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
  SELECT l_partkey, (coalesce(a.s * 0.6::DOUBLE, 0) + coalesce(b.s * 0.4::DOUBLE, 0)) / (CASE WHEN a.s IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN b.s IS NULL THEN 0 ELSE 0.4::DOUBLE END) AS score FROM a FULL JOIN b USING (l_partkey)""")
def performance_blend(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", "l_linenumber", _label("l_returnflag", _FLAG).alias("a"), _label("l_linestatus", {"O": "Strong", "F": "Intimate"}).alias("b"), F.col("l_quantity").cast("long").alias("q"))
    one = metrics.weighted_adequacy(rows.where("l_linenumber % 2 = 0"), ["l_partkey"], "a", "q", metrics.LONGEVITY).select("l_partkey", F.col("score").alias("x"))
    two = metrics.weighted_adequacy(rows.where("l_linenumber % 2 = 1"), ["l_partkey"], "b", "q", metrics.SILLAGE).select("l_partkey", F.col("score").alias("y"))
    return one.join(two, "l_partkey", "full").select("l_partkey", metrics.blend({"longevity": F.col("x"), "sillage": F.col("y")}, metrics.PERFORMANCE).alias("score"))


@query("rating_distribution", "SELECT l_partkey, sum(s * q) * 20.0::DOUBLE / sum(q)::DOUBLE AS score, sum(CASE WHEN s >= 4 THEN q ELSE 0 END) * 100.0::DOUBLE / sum(q)::DOUBLE AS positive_share, sum(q)::BIGINT AS votes FROM (SELECT l_partkey, l_linenumber AS s, l_quantity::BIGINT AS q FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5) WHERE q > 0 GROUP BY l_partkey")
def rating_distribution(spark, d):
    return metrics.rating(t(spark, d, "lineitem"), ["l_partkey"], "l_linenumber", "l_quantity")


@query("distribution_pct", "SELECT user_id, event_type, n, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS pct, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1 AS dominant FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def distribution_pct(spark, d):
    n = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return metrics.distribution(n, "user_id", "event_type", "n")


@query("max_normalized", "SELECT user_id, event_type, n, n::DOUBLE / max(n) OVER (PARTITION BY user_id) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def max_normalized(spark, d):
    n = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return metrics.max_normalized(n, "user_id", "event_type", "n")


@query("community_interest", """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS have, count(*) FILTER (event_type = 'signup') AS had, count(*) FILTER (event_type = 'view') AS want FROM events GROUP BY 1),
  r AS (SELECT *, have + had + want AS n, want::DOUBLE / nullif(have + want, 0) AS w, have::DOUBLE / nullif(have + had, 0) AS k, least(100.0::DOUBLE, log10(have + had + want + 1.0::DOUBLE) / 5 * 100) AS p FROM c)
  SELECT user_id, round(w, 4) AS want_ratio, round(k, 4) AS retention_ratio, round(p, 3) AS popularity_index, CASE WHEN n > 0 THEN round((p * 0.6::DOUBLE + coalesce(w * 100 * 0.25::DOUBLE, 0) + coalesce(k * 100 * 0.15::DOUBLE, 0)) / (0.6::DOUBLE + CASE WHEN w IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN k IS NULL THEN 0 ELSE 0.15::DOUBLE END), 4) END AS score FROM r""")
def community_interest(spark, d):
    count = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    c = t(spark, d, "events").groupBy("user_id").agg(count("purchase").alias("have"), count("signup").alias("had"), count("view").alias("want"))
    i = c.select("user_id", metrics.interest(F.col("have"), F.col("had"), F.col("want")).alias("i"))
    return i.select("user_id", *[F.round(f"i.{c}", k).alias(c) for c, k in (("want_ratio", 4), ("retention_ratio", 4), ("popularity_index", 3), ("score", 4))])


@query("headline_bands", """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 101)::DOUBLE END AS a, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 89)::DOUBLE END AS b FROM customer),
  s AS (SELECT c_custkey, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n_components, (coalesce(a * 0.45::DOUBLE, 0) + coalesce(b * 0.2::DOUBLE, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.2::DOUBLE END, 0) AS raw FROM p)
  SELECT c_custkey, round_even(raw, 0)::INT AS score, n_components, CASE WHEN raw IS NULL THEN NULL WHEN round_even(raw, 0) >= 85 THEN 'Crowd Favorite' WHEN round_even(raw, 0) >= 70 THEN 'Well Liked' WHEN round_even(raw, 0) >= 55 THEN 'Generally Liked' WHEN round_even(raw, 0) >= 40 THEN 'Mixed Reception' ELSE 'Polarizing' END AS label FROM s""")
def headline_bands(spark, d):
    k, none = F.col("c_custkey"), F.lit(None).cast("double")
    h = metrics.headline({"rating": F.when(k % 3 > 0, (k % 101).cast("double")), "sentiment": F.when(k % 5 > 0, (k % 89).cast("double")), "performance": none, "value": none, "interest": none})
    return t(spark, d, "customer").select("c_custkey", h.alias("h")).select("c_custkey", "h.score", "h.n_components", "h.label")


@query("sentiment_score", "SELECT doc_id // 10 AS card, (count(*) FILTER (quality = 1 AND toxic = 0) + count(*) FILTER (quality = 0 AND toxic = 0) / 2.0::DOUBLE) * 100.0::DOUBLE / count(*)::DOUBLE AS score FROM labels GROUP BY 1")
def sentiment_score(spark, d):
    count = lambda cond: F.count(F.when(F.expr(cond), 1))
    c = t(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 10).alias("card")).agg(count("quality = 1 and toxic = 0").alias("p"), count("quality = 0 and toxic = 0").alias("n"), F.count("*").alias("total"))
    return c.select("card", metrics.sentiment(F.col("p"), F.col("n"), F.col("total")).alias("score"))


@query("wear_profile", """WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS total FROM s)
  SELECT a.user_id, a.event_type AS primary, CASE WHEN (a.n - b.n) / a.total::DOUBLE <= 0.05::DOUBLE THEN b.event_type END AS second, a.total::BIGINT AS votes FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.k = 2 WHERE a.k = 1""")
def wear_profile(spark, d):
    return metrics.wear_profile(t(spark, d, "events").select("user_id", "event_type", F.lit(1).alias("one")), ["user_id"], "event_type", "one")


@query("main_accords", "SELECT p_brand, string_agg(p_type, ',' ORDER BY k) AS accords FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_type <> 'PROMO' GROUP BY ALL)) WHERE k <= 3 GROUP BY p_brand")
def main_accords(spark, d):
    n = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    cards = n.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(F.col("p_type").alias("label"), F.col("n").alias("pct")))).alias("a"))
    return cards.select("p_brand", F.array_join(F.transform(metrics.main_accords(F.col("a"), ("promo",), 3), lambda x: x["label"]), ",").alias("accords"))


@query("merge_passes", "SELECT o_custkey, o_orderpriority, arg_min(pct, (pass, o_orderkey)) AS pct FROM (SELECT o_custkey, o_orderpriority, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS pass, (o_orderkey % 120)::DOUBLE AS pct FROM orders) WHERE pct BETWEEN 0 AND 100 GROUP BY 1, 2")
def merge_passes(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", "o_orderpriority", F.struct(F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("p"), "o_orderkey").alias("o"), (F.col("o_orderkey") % 120).cast("double").alias("pct"))
    best = metrics.merge_passes(rows.withColumn("card", F.col("o_custkey")), "card", "o_orderpriority", "o")
    return best.select("o_custkey", "o_orderpriority", "pct")


@query("status_counts_zero_filled", "SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X'), ('Y')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def status_counts(spark, d):
    n = t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return audit.zero_filled(n, "o_orderstatus", ["F", "O", "P", "X", "Y"])


@query("recent_window_count", f"SELECT user_id, count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS recent, count(*) AS n FROM events GROUP BY user_id")
def recent_window_count(spark, d):
    recent = F.expr(f"ts > timestamp_ntz '{NOW}' - interval 7 days")
    return t(spark, d, "events").groupBy("user_id").agg(F.count(F.when(recent, 1)).alias("recent"), F.count("*").alias("n"))


_ERRORS = "CASE event_type WHEN 'error' THEN 'HTTP 429: Rate limited' WHEN 'click' THEN 'worker: API_UNAVAILABLE' WHEN 'view' THEN '' ELSE 'Odd ' || event_type END"


@query("error_bucket_hist", f"SELECT event_type, CASE WHEN e = '' THEN 'none' WHEN contains(lower(e), 'rate limited') THEN 'fg_resolver_blocked' WHEN contains(lower(e), 'api_unavailable') THEN 'api_unavailable' ELSE lower(e)[:80] END AS bucket, count(*) AS n FROM (SELECT event_type, {_ERRORS} AS e FROM events) GROUP BY ALL")
def error_bucket_hist(spark, d):
    rows = t(spark, d, "events").select("event_type", F.expr(_ERRORS).alias("e"))
    return rows.groupBy("event_type", X.error_bucket(F.col("e")).alias("bucket")).agg(F.count("*").alias("n"))


_NAME = "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN p_brand WHEN 2 THEN p_name || ' 1999' WHEN 3 THEN p_name || '|' || p_name ELSE p_name END"
_BRAND = "CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_brand END"


@query("issue_hist", f"""WITH r AS (SELECT {_NAME} AS n, trim({_BRAND}) AS b FROM part), i AS (SELECT unnest([CASE WHEN b = '' THEN 'brand_missing' END, CASE WHEN n = '' THEN 'name_missing' END, CASE WHEN n <> '' AND lower(n) = lower(b) THEN 'name_equals_brand' END,
  CASE WHEN contains(n, '|') THEN 'name_self_dup' END, CASE WHEN contains(n, ' 1999') THEN 'name_has_year' END]) AS tag FROM r) SELECT tag, count(*) AS n FROM i WHERE tag IS NOT NULL GROUP BY tag""")
def issue_hist(spark, d):
    rows = t(spark, d, "part").select(F.expr(_NAME).alias("n"), F.expr(_BRAND).alias("b"))
    return audit.histogram(rows.select(audit.tags(audit.identity_rules(F.col("n"), F.col("b"))).alias("issues")))


@query("dup_scoped", "WITH k AS (SELECT doc_id, lang, source, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents) SELECT doc_id, copies FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY lang, source, k) AS copies FROM k) WHERE copies > 1 AND k IS NOT NULL")
def dup_scoped(spark, d):
    return audit.duplicates(t(spark, d, "documents"), ["lang", "source"], "text", "doc_id")


@query("near_dup_reviews", r"SELECT lang, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, lang, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '\b(show all reviews|reply|like|dislike|report)\b', ' ', 'g'), ' +', ' ', 'g')) AS k FROM documents) WHERE length(k) >= 30 GROUP BY lang, k")
def near_dup_reviews(spark, d):
    return audit.review_copies(t(spark, d, "documents"), ["lang"], "text", "doc_id")


@query("snapshot_diff", "WITH a AS (SELECT DISTINCT o_orderpriority AS tag, o_custkey AS r FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT o_orderpriority AS tag, o_custkey AS r FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT coalesce(a.tag, b.tag) AS tag, count(*) FILTER (b.r IS NULL) AS resolved, count(*) FILTER (a.r IS NULL) AS added, count(*) FILTER (a.r IS NOT NULL AND b.r IS NOT NULL) AS persistent FROM a FULL JOIN b ON a.tag = b.tag AND a.r = b.r GROUP BY 1")
def snapshot_diff(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_orderpriority").alias("tag"), F.col("o_custkey").alias("row_id"), "o_orderdate")
    cut = F.expr("o_orderdate < timestamp_ntz '1998-01-01 00:00:00'")
    return audit.snapshot_diff(rows.where(cut).drop("o_orderdate"), rows.where(~cut).drop("o_orderdate"))


@query("trust_coalesce", "WITH a AS (SELECT c_nationkey AS k, max(c_acctbal) AS v, NULL AS w FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, max(s_acctbal) AS v, min(s_suppkey) AS w FROM supplier GROUP BY 1), u AS (SELECT k FROM a UNION SELECT k FROM b) SELECT k, coalesce(a.v, b.v) AS v, b.w FROM u LEFT JOIN a USING (k) LEFT JOIN b USING (k)")
def trust_coalesce(spark, d):
    a = t(spark, d, "customer").where("c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"), F.lit(None).cast("long").alias("w"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"), F.min("s_suppkey").alias("w"))
    return merge.trust_coalesce([a, b], "k", ["v", "w"])


_BATCH = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS prio, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS status FROM orders"


@query("upsert_merge", f"WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS prio, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 > 0), n AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, lower(prio) AS prio, status FROM ({_BATCH}) WHERE o_orderkey % 5 = 0) SELECT o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.prio, o.prio) AS prio, coalesce(n.status, o.status) AS status FROM o FULL JOIN n USING (o_orderkey)")
def upsert_merge(spark, d):
    rows = t(spark, d, "orders")
    old = rows.where("o_orderkey % 2 = 0 or o_orderkey % 5 > 0").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"))
    new = rows.where("o_orderkey % 5 = 0").selectExpr("o_orderkey", "o_custkey + 1 AS o_custkey", "lower(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END) AS prio", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS status")
    return merge.upsert(old, new, "o_orderkey")


@query("upsert_guarded", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN p_name ELSE upper(p_name) END AS p_name FROM part")
def upsert_guarded(spark, d):
    rows = t(spark, d, "part")
    old = rows.where("p_partkey % 2 = 0").selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'old' END AS url", "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name")
    new = rows.where("p_partkey % 3 > 0 or p_partkey % 2 = 1").selectExpr("p_partkey", "'new' AS url", "upper(p_name) AS p_name")
    return merge.upsert(old, new, "p_partkey", guard="url").drop("url")


@query("fill_only", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'filled' END AS segment FROM customer")
def fill_only(spark, d):
    rows = t(spark, d, "customer")
    old = rows.selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment")
    return merge.fill_only(old, rows.where("c_custkey % 3 = 0").selectExpr("c_custkey", "'filled' AS segment"), "c_custkey")


@query("merge_group", "SELECT c_nationkey, c_mktsegment, arg_min(c_name, c_custkey) FILTER (c_custkey % 2 = 0) AS name, min(c_custkey) AS first_c_custkey, max(c_acctbal) AS last_c_acctbal FROM customer GROUP BY 1, 2")
def merge_group(spark, d):
    rows = t(spark, d, "customer").withColumn("name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    return merge.merge_group(rows, ["c_nationkey", "c_mktsegment"], {"name": "c_custkey"}, ["c_custkey"], ["c_acctbal"])


@query("claim_once", "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id % 5 > 0 GROUP BY user_id")
def claim_once(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id")
    return merge.claim_once(rows, rows.where("user_id % 5 = 0").select("user_id").distinct(), "user_id", "event_id")


@query("anti_seed", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_seed(spark, d):
    done = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


@query("semi_retry", "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR o_orderpriority = '1-URGENT'")
def semi_retry(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    asked = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    urgent = rows.where("o_orderpriority = '1-URGENT'")
    return urgent.unionByName(rows.where("o_orderpriority <> '1-URGENT'").join(asked, "o_orderkey", "left_semi")).drop("o_orderpriority")


@query("job_state_left", "SELECT c_custkey, coalesce(max(o_orderstatus), 'none') AS status, count(o_orderkey) AS jobs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def job_state_left(spark, d):
    jobs = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("jobs"))
    return t(spark, d, "customer").select("c_custkey").join(jobs, "c_custkey", "left").select("c_custkey", F.coalesce("status", F.lit("none")).alias("status"), F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"))


_FACT_SQL = """SELECT p_partkey, list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'name' END, CASE WHEN p_partkey % 4 = 0 THEN 'gender' END, CASE WHEN p_size < 10 THEN 'size' END], lambda x: x IS NOT NULL) AS missing FROM part"""


def _missing(spark, d):
    k = F.col("p_partkey")
    known = {"name": X.is_fact(F.when(k % 3 > 0, F.col("p_name")).otherwise(F.lit(" Unknown "))), "gender": X.is_fact(F.when(k % 4 > 0, F.lit("women")).otherwise(F.lit("Universal")), ("universal",)), "size": F.col("p_size") >= 10}
    return t(spark, d, "part").select("p_partkey", facts.missing(known).alias("missing"))


@query("missing_facts", f"SELECT p_partkey, array_to_string(missing, ',') AS missing FROM ({_FACT_SQL})")
def missing_facts(spark, d):
    return _missing(spark, d).select("p_partkey", F.array_join("missing", ",").alias("missing"))


@query("missing_fact_counts", f"SELECT fact, count(*) AS n FROM (SELECT unnest(missing) AS fact FROM ({_FACT_SQL})) GROUP BY fact")
def missing_fact_counts(spark, d):
    return facts.missing_counts(_missing(spark, d))


@query("heal_decision", f"""SELECT d, count(*) AS n FROM (SELECT CASE WHEN len(missing) = 0 THEN 'skip_complete' WHEN p_partkey % 11 = 0 THEN 'skip_ignored' WHEN p_partkey % 11 IN (1, 2) THEN 'skip_live' WHEN p_partkey % 13 >= 10 THEN 'skip_exhausted'
  WHEN NOT list_has_any(missing, ['name', 'size']) THEN 'skip_unsuppliable' WHEN p_partkey % 2 = 0 AND p_partkey % 5 > 0 THEN 'skip_no_page' ELSE 'queue' END AS d FROM ({_FACT_SQL})) GROUP BY d""")
def heal_decision(spark, d):
    k = F.col("p_partkey")
    status = F.when(k % 11 == 0, "ignored").when(k % 11 == 1, "pending").when(k % 11 == 2, "processing").otherwise("completed")
    decision = facts.heal_decision(status=status, absent=F.col("missing"), can_heal=F.array(F.lit("name"), F.lit("size")), has_page=k % 2 == 1, stale=k % 5 == 0, attempts=k % 13)
    return _missing(spark, d).groupBy(decision.alias("d")).agg(F.count("*").alias("n"))


@query("families", "SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS families FROM (SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN [] WHEN a IS NULL THEN [b] WHEN b IS NULL OR a = b THEN [a] ELSE [a, b] END AS list_distinct_ordered FROM (SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'warm' WHEN 'blue' THEN 'cold' WHEN 'small' THEN 'size' END AS a, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'warm' WHEN 'gear' THEN 'machine' END AS b FROM part))")
def families(spark, d):
    known = {"red": "warm", "blue": "cold", "small": "size", "ring": "warm", "gear": "machine"}
    return t(spark, d, "part").select("p_partkey", F.array_join(facts.families(F.array(F.translate("p_name", " ", "/")), known), ",").alias("families"))


@query("json_path_filter", "SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) WHERE k >= 50 GROUP BY event_type")
def json_path_filter(spark, d):
    rows = t(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k")).where("k >= 50")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("year_consensus", r"""WITH y AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[0-9]{4}')) AS y FROM documents), e AS (SELECT lang, source, doc_id, y::INT AS y FROM y WHERE y LIKE '19%' OR y LIKE '20%')
  SELECT doc_id, min(y) AS year, CASE WHEN count(DISTINCT source) >= 2 THEN 98 ELSE 95 END AS confidence, count(*) AS evidence_count FROM e GROUP BY doc_id HAVING count(DISTINCT y) = 1""")
def year_consensus(spark, d):
    found = t(spark, d, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{4})"), 1)).alias("y")).where("y LIKE '19%' OR y LIKE '20%'")
    return consensus.unique_year(found.withColumn("y", F.col("y").cast("int")), "doc_id", "y", "source")


@query("ballot_vote", """WITH s AS (SELECT user_id, event_type AS c, sum(CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END) AS w FROM events GROUP BY 1, 2), r AS (SELECT *, w * 100.0::DOUBLE / sum(w) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, c) AS k FROM s)
  SELECT a.user_id, a.c AS winner, a.share, b.c AS runner_up, coalesce(b.share, 0) AS runner_share, (coalesce(b.share, 0) >= 25 AND a.share < 2 * coalesce(b.share, 0)) OR a.share < 35 AS ambiguous FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.k = 2 WHERE a.k = 1""")
def ballot_vote(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("c"))
    return consensus.ballots(rows, "user_id", "c", F.when(F.col("event_id") % 3 == 0, 4).otherwise(1))


@query("majority_label", "WITH s AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, arg_min(o_orderstatus, (-n, p)) AS o_orderstatus, max(n) AS n, sum(n) AS total FROM s GROUP BY 1) SELECT o_custkey, o_orderstatus, n FROM b WHERE n >= greatest(2, ceil(total / 2.0))")
def majority_label(spark, d):
    return consensus.majority(t(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


_JOB_EVENTS = {"view": "enqueue", "click": "claim", "signup": "complete", "error": "fail", "purchase": "requeue"}


@query("queue_fold")
def queue_fold(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("job_key"), _label("event_type", _JOB_EVENTS).alias("event"), "ts", F.col("event_id").alias("seq"))
    return state.queue_fold(rows)


@query("sliding_limiter")
def sliding_limiter(spark, d):
    return state.limited(t(spark, d, "events"), "user_id", "ts", "event_id", 2, 6 * 3600.0)


@query("range_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def range_count(spark, d):
    at = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3_600_000_000, 0)
    return t(spark, d, "events").select("event_id", F.count("*").over(at).alias("n"))


@query("daily_budget", "SELECT event_id, used FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS used FROM events) WHERE used <= 10")
def daily_budget(spark, d):
    return state.daily_budget(t(spark, d, "events"), "event_type", "ts", "event_id", 10).select("event_id", "used")


@query("lease_sweep", f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_type <> 'click' THEN event_type WHEN ts + INTERVAL 900 SECOND <= TIMESTAMP '2024-01-20 00:00:00' THEN 'pending' ELSE 'processing' END AS state FROM events) GROUP BY state")
def lease_sweep(spark, d):
    ended = F.expr(f"ts + interval {state.LEASE} seconds <= timestamp_ntz '2024-01-20 00:00:00'")
    now = F.when(F.col("event_type") != "click", F.col("event_type")).when(ended, "pending").otherwise("processing")
    return t(spark, d, "events").groupBy(now.alias("state")).agg(F.count("*").alias("n"))


@query("queue_order", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 100 OFFSET 20")
def queue_order(spark, d):
    rows = t(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderpriority"), "o_orderdate", "o_orderkey")
    return rows.offset(20).limit(100).select("o_orderkey", "o_orderpriority")


@query("trace_summary", "SELECT l_returnflag, count(*) AS calls, sum(l_quantity::BIGINT)::BIGINT AS total, count(DISTINCT l_linestatus) AS reasons FROM lineitem GROUP BY l_returnflag")
def trace_summary(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("long")).alias("total"), F.count_distinct("l_linestatus").alias("reasons"))


@query("cascade_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')")
def cascade_delete(spark, d):
    gone = t(spark, d, "part").where("p_name LIKE '%ring%'").select(F.col("p_partkey").alias("l_partkey"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(gone, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("cube_ext", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_ext(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


@query("session_ext", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k")
def session_ext(spark, d):
    rows = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = rows.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
