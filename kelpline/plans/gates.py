"""Queries of the gates on identities, labels and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predicates as P
from ..sources.tables import table as t

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _marks(column: str, values) -> str:
    return "(" + " OR ".join(f"contains({column}, '{v}')" for v in values) + ")"


#: Tokens of a text in DuckDB, as SF6 has them but with repeats.
_TOK = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("junk_accord_labels", f"""WITH l AS (SELECT event_id, event_type AS name, unnest([event_type, upper(event_type) || '!', json_extract_string(props, '$.k'), json_extract_string(props, '$.k') || ' K', event_type || ' for sale']) AS label, unnest(range(5)) AS pos FROM events),
  m AS (SELECT *, lower(trim(label)) AS low, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS own FROM l)
  SELECT event_id, pos::INTEGER AS pos, (coalesce(trim(label), '') = '' OR coalesce(regexp_matches(trim(label), '^\\d[\\d.,]*\\s*[kmbKMB]?$'), false) OR low IN {_list(P.RATING_WORDS + P.SEASONS_AND_TIMES + P.AD_LABELS)} OR {_marks('low', P.AD_MARKS)} OR own IN {_list(P.HEADINGS)} OR (own <> 'click' AND own = name)) AS junk FROM m""")
def junk_accord_labels(spark, d):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_type")
    labels = F.array(e, F.concat(F.upper(e), F.lit("!")), k, F.concat(k, F.lit(" K")), F.concat(e, F.lit(" for sale")))
    rows = t(spark, d, "events").select("event_id", e.alias("name"), F.posexplode(labels).alias("pos", "label"))
    return rows.select("event_id", "pos", P.junk_accord(F.col("label"), F.col("name"), known=("click",)).alias("junk"))


@query("identity_gates", f"""WITH p AS (SELECT p_partkey, lower(p_name) AS n, p_size::VARCHAR AS s, {_TOK.format('p_name')} AS tok FROM part)
  SELECT p_partkey, length(n) >= 2 AND NOT list_has_any(string_split(n, ' '), [{', '.join(repr(w) for w in P.NOT_IDENTITIES)}]) AS name_real, length(s) >= 2 AND NOT regexp_matches(s, '^\\d{{4,}}$') AS size_real, len(list_distinct(tok)) > 1 OR len(tok) = 1 AS echo, len(tok) > 0 AS same FROM p""")
def identity_gates(spark, d):
    name = F.col("p_name")
    return t(spark, d, "part").select(
        "p_partkey",
        P.looks_real(name).alias("name_real"),
        P.looks_real(F.col("p_size").cast("string")).alias("size_real"),
        P.house_echo(F.get(F.split(name, " "), F.lit(0)), name).alias("echo"),
        P.house_echo(name, F.upper(name)).alias("same"),
    )


@query("brand_only_queries", f"SELECT p_partkey, len(tok) > 0 AND len(list_distinct(tok)) <= len(list_distinct([tok[1], tok[-1]])) AS brand_only FROM (SELECT p_partkey, {_TOK.format('p_name')} AS tok FROM part)")
def brand_only_queries(spark, d):
    words = F.split("p_name", " ")
    forms = F.array(F.get(words, F.lit(0)), F.get(words, F.size(words) - 1))
    return t(spark, d, "part").select("p_partkey", P.brand_only(F.col("p_name"), forms).alias("brand_only"))


@query("non_perfume_flags", """SELECT page_id, pos, pos = 0 AND NOT contains(lower(url), 'fragrantica.com/perfume/') AS flag, CASE WHEN pos = 0 AND NOT contains(lower(url), 'fragrantica.com/perfume/') THEN 'non-perfume product token: ''shampoo''' ELSE '' END AS reason
  FROM (SELECT page_id, url, unnest([0, 1])::INTEGER AS pos FROM pages)""")
def non_perfume_flags(spark, d):
    none = F.lit(None).cast("string")
    named = t(spark, d, "pages").select("page_id", "url", F.posexplode(F.array(F.lit("Mild Shampoo"), F.lit("Night Garden"))).alias("pos", "name"))
    return named.select("page_id", "pos", P.non_perfume(F.col("name"), F.lit("House"), F.col("url"), none, none).alias("s")).select("page_id", "pos", "s.flag", "s.reason")


@query("unusable_results", f"""WITH r AS (SELECT p_type, list_filter({_TOK.format('p_type')}, lambda x: length(x) >= 4) AS a, lower(p_name) AS n FROM part)
  SELECT p_type, count(*) AS n, count(*) >= 3 AND max(len(a)) > 0 AND NOT bool_or(len(list_filter(a, lambda x: contains(n, x))) > 0) AS unusable FROM r GROUP BY p_type""")
def unusable_results(spark, d):
    return P.unusable(t(spark, d, "part"), "p_type", "p_name")


@query("leak_audit", """SELECT event_type, count(*) AS n_labels, count(DISTINCT user_id) AS n_records, (SELECT string_agg(props, '|' ORDER BY event_id) FROM (SELECT event_id, props FROM events i WHERE i.event_type = e.event_type ORDER BY event_id LIMIT 12)) AS examples FROM events e GROUP BY event_type""")
def leak_audit(spark, d):
    return P.leak_audit(t(spark, d, "events"), "event_type", "user_id", "props", "event_id")


@query("metric_groups_filled", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE coalesce(m, c_acctbal) END AS balance, c_acctbal > 0 OR coalesce(m > 200000, false) AS balance_covered FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def metric_groups_filled(spark, d):
    old = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("balance_covered"))
    new = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"))
    return P.fill_groups(old, new.withColumn("balance_covered", F.col("balance") > 200000), "c_custkey", ["balance"])
