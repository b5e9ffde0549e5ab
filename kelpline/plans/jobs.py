"""Queries of jobs, their clocks, keys and ladders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import asked, consensus, facts, gates, keys, ladder, notes, records
from ..sources.tables import spread
from ..sources.tables import table as t
from ..streaming import timers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def kept(made):
        QUERIES[name] = made
        if sql:
            ORACLES[name] = sql
        return made

    return kept


@query("timed_jobs")
def timed_jobs(spark, d):
    """Users as jobs, what they do as what happens to them."""
    kind = F.col("event_type")
    event = F.when(kind == "view", "enqueue").when(kind == "click", "claim").when(kind == "signup", "complete").when(kind == "purchase", "partial").otherwise("fail")
    rows = t(spark, d, "events").select(F.col("user_id").alias("job_key"), event.alias("event"), "ts", F.col("event_id").alias("seq"))
    return timers.timed_states(rows, "2024-01-31 00:00:00")


@query("forced_requeue", """WITH r AS (SELECT o_custkey, count(*) AS n, max(greatest(o_orderkey % 9 - 2, 0)) AS p, max_by(CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END, (o_orderdate, o_orderpriority)) FILTER (o_orderkey % 4 > 0) AS q FROM orders GROUP BY 1),
  j AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'ignored' END AS status, c_nationkey % 6 AS priority, 1 AS requests, c_nationkey % 4 AS failures, c_mktsegment AS query FROM customer WHERE c_custkey % 7 > 0)
  SELECT coalesce(c_custkey, o_custkey) AS job_key, CASE WHEN n IS NULL THEN status ELSE 'pending' END AS status, CASE WHEN n IS NULL THEN priority ELSE greatest(coalesce(priority, 0), p) END AS priority, coalesce(requests, 0) + coalesce(n, 0) AS requests, coalesce(failures, 0) AS failures, coalesce(q, query) AS query FROM j FULL JOIN r ON c_custkey = o_custkey""")
def forced_requeue(spark, d):
    nation = F.col("c_nationkey")
    status = F.when(nation % 3 == 0, "completed").when(nation % 3 == 1, "failed").otherwise("ignored")
    jobs = t(spark, d, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("job_key"), status.alias("status"), (nation % 6).cast("long").alias("priority"), F.lit(1).cast("long").alias("requests"), (nation % 4).alias("failures"), F.col("c_mktsegment").alias("query"))
    asked = t(spark, d, "orders").select(F.col("o_custkey").alias("job_key"), (F.col("o_orderkey") % 9 - 2).alias("priority"), "o_orderdate", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("query"))
    return ladder.requeued(jobs, asked, "job_key", "o_orderdate", ("query",))


@query("resolution_ladder", """WITH s AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part WHERE p_size <= 20 GROUP BY 1, 2), b AS (SELECT p_brand, min(p_partkey) AS k FROM part WHERE p_size <= 3 GROUP BY 1),
  a AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN p_partkey END AS pinned, CASE WHEN p_type = 'PROMO' THEN p_partkey + 1 END AS stated, s.k AS same, b.k AS house FROM part LEFT JOIN s USING (p_brand, p_name) LEFT JOIN b USING (p_brand))
  SELECT p_partkey, coalesce(pinned, stated, same, house) AS url, CASE WHEN pinned IS NOT NULL THEN 'pinned' WHEN stated IS NOT NULL THEN 'query' WHEN same IS NOT NULL THEN 'search' WHEN house IS NOT NULL THEN 'catalog' END AS tier FROM a""")
def resolution_ladder(spark, d):
    part = t(spark, d, "part")
    by = lambda most, *on: part.where(F.col("p_size") <= most).select(*on, F.col("p_partkey").alias("url"))
    tiers = {
        "pinned": lambda left: left.where("p_partkey % 9 = 0").select("p_partkey", F.col("p_partkey").alias("url")),
        "query": lambda left: left.where("p_type = 'PROMO'").select("p_partkey", (F.col("p_partkey") + 1).alias("url")),
        "search": lambda left: left.join(by(20, "p_brand", "p_name").groupBy("p_brand", "p_name").agg(F.min("url").alias("url")), ["p_brand", "p_name"]).select("p_partkey", "url"),
        "catalog": lambda left: left.join(by(3, "p_brand").groupBy("p_brand").agg(F.min("url").alias("url")), "p_brand").select("p_partkey", "url"),
    }
    return ladder.ladder(part.select("p_partkey", "p_brand", "p_name", "p_type"), "p_partkey", tiers, "url")[0]


_SPELT = "CASE p_partkey % 5 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN 'Pour Homme ' || p_name WHEN 2 THEN p_name || ' No ' || p_size WHEN 3 THEN upper(p_name) || '!' ELSE p_name END"
_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query("identity_keys", f"""WITH n AS (SELECT p_partkey, p_brand AS b, {_SPELT} AS n FROM part), w AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w, list_filter(string_split(trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1) AS k FROM n),
  a AS (SELECT *, list_filter(w, lambda x: NOT list_contains(k, x)) AS rest FROM w), c AS (SELECT *, CASE WHEN len(rest) > 0 AND len(rest) < len(w) THEN array_to_string(rest, ' ') ELSE '' END AS alias, regexp_replace(n, '(?i)\\bno\\s*(\\d+)\\b', 'no\\1') AS num FROM a)
  SELECT p_partkey, {_KEY.format("b || ' ' || n")} || CASE WHEN alias <> '' THEN '|' || {_KEY.format("b || ' ' || alias")} ELSE '' END AS keys FROM c""")
def identity_keys(spark, d):
    name = F.expr(_SPELT)
    return spread(t(spark, d, "part")).select("p_partkey", F.array_join(keys.identity_keys(F.col("p_brand"), name), "|").alias("keys"))


@query("inherited_entries", """WITH e AS (SELECT p_partkey AS entry, p_brand AS b, p_name AS n FROM part WHERE p_size > 15), f AS (SELECT b, n, min(entry) AS entry FROM e WHERE entry % 3 > 0 GROUP BY 1, 2), g AS (SELECT b, n, min(entry) AS entry FROM e WHERE entry % 3 = 0 GROUP BY 1, 2 HAVING min(entry) = max(entry)), r AS (SELECT p_partkey, p_brand AS b, p_name AS n FROM part WHERE p_size <= 15)
  SELECT p_partkey, coalesce(f.entry, g.entry) AS entry, CASE WHEN f.entry IS NULL THEN -1 ELSE 0 END AS by, CASE WHEN f.entry IS NULL THEN 'Women' END AS gender FROM r LEFT JOIN f USING (b, n) LEFT JOIN g USING (b, n) WHERE coalesce(f.entry, g.entry) IS NOT NULL""")
def inherited_entries(spark, d):
    p = t(spark, d, "part")
    labelled = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("For Her "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    index = p.where("p_size > 15").select(F.col("p_partkey").alias("entry"), F.col("p_brand").alias("b"), labelled.alias("n"))
    rows = p.where("p_size <= 15").select("p_partkey", F.col("p_brand").alias("b"), F.col("p_name").alias("n"))
    return keys.inherited(rows, index, "p_partkey", "entry", "b", "n")


@query("recovered_identities", """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, replace(p_brand, '#', ' ') AS b, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS title, p_name AS n FROM part)
  SELECT p_partkey, CASE k WHEN 3 THEN n ELSE title END AS name, b AS house FROM p""")
def recovered_identities(spark, d):
    k, b = F.col("p_partkey") % 5, F.replace("p_brand", F.lit("#"), F.lit(" "))
    slug = lambda c: F.replace(c, F.lit(" "), F.lit("-"))
    main = F.concat(F.lit("https://www.fragrantica.com/perfume/"), slug(b), F.lit("/"), slug(F.col("p_name")), F.lit("-"), "p_partkey", F.lit(".html"))
    second = F.concat(F.lit("https://basenotes.com/fragrances/"), F.lower(slug(F.col("p_name"))), F.lit("-by-"), F.lower(slug(b)), F.lit("."), "p_partkey")
    first = F.get(F.split("p_name", " "), F.lit(0))
    name = F.when(k == 0, "").when(k == 1, "342 votes").when(k == 2, first).when(k == 3, F.col("p_name"))
    house = F.when(k == 0, "Unknown").when(k == 1, b).when(k == 2, "Brand").when(k == 3, b)
    rows = spread(t(spark, d, "part")).select("p_partkey", name.alias("name"), house.alias("house"), F.when(k == 4, F.lit(None)).otherwise(main).alias("fg_url"), second.alias("bn_url"))
    return keys.recovered(rows, "name", "house", "fg_url", "bn_url").select("p_partkey", "name", "house")


@query("accepted_candidates")
def accepted_candidates(spark, d):
    """Every part as a job, every other part of its brand and first word as a candidate."""
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.get(F.split("p_name", " "), F.lit(0)).alias("w"), (F.col("p_size") % 3 + 2000).alias("y"))
    kinds = p.groupBy("p_brand", "p_name", "w").agg(F.min("y").alias("y"))
    other = kinds.select("p_brand", "w", F.concat_ws(" ", "p_name", F.when(F.col("y") == 2001, "eau").when(F.col("y") == 2002, "intense")).alias("other"), F.col("y").alias("z"))
    pairs = kinds.join(other, ["p_brand", "w"]).withColumn("house", F.col("p_brand"))
    return ladder.accepted(pairs, ("house", "p_name", "y"), ("p_brand", "other", "z")).where("accepted").select("p_brand", "p_name", "y", "other", "z")


_FACT_RULES = {"name": "k % 31 = 0", "house": "k % 29 = 0", "year": "k % 4 = 0", "gender": "k % 5 = 0 AND k % 3 > 0", "concentration": "k % 7 = 0", "family": "k % 6 <> 1", "main_accords": "k % 6 NOT IN (1, 2)", "wear_profile": "k % 4 < 2", "performance_score": "k % 2 = 0", "value_score": "k % 3 = 0", "community_interest_score": "k % 5 < 4", "notes": "k % 8 > 1", "reviews": "k % 9 > 2"}


@query("record_facts", "WITH p AS (SELECT p_partkey AS k FROM part) SELECT k AS p_partkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _FACT_RULES.items()) + "], lambda x: x IS NOT NULL), ',') AS absent FROM p")
def record_facts(spark, d):
    """Stored records made of every part, with the facts that its key leaves out."""
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    obj = lambda *fields: text("{", F.concat_ws(", ", *fields), "}")
    sex = F.when(k % 3 == 0, '{"gender": "Men"}').otherwise('{"gender": "Unisex / Unspecified"}')
    fg = obj(F.when(k % 7 > 0, text('"concentration": "', F.col("p_type"), '"')), text('"raw_identity": ', sex), F.when(k % 8 == 0, text('"notes": {"top": ["", "', F.col("p_name"), '"]}')), F.when(k % 9 == 1, '"reviews": [{"text": " "}, {"text": "good"}]'))
    bn = obj(F.when(k % 8 == 1, '"notes": {"flat": ["x"]}').otherwise('"notes": {"heart": [" ", null]}'), F.when(k % 9 == 2, '"reviews": [{"text": "fine"}]'), F.when(k % 9 == 0, '"reviews": [{"text": "also"}]'))
    accords = F.when(k % 6 == 1, '"top_accords": ["14.9K", "Woody"]').when(k % 6 == 2, '"scent_vector": [{"accord": "odd", "score": 9}]').when(k % 6 == 3, '"top_accords": ["14.9K", " "]').otherwise('"top_accords": []')
    wear = F.when(k % 4 == 2, '{"primary_seasons": ["Universal", "Winter"]}').when(k % 4 == 3, '{"primary_time": "Night"}').when(k % 4 == 1, '{"primary_seasons": ["universal"]}').otherwise("{}")
    flag = lambda name, c: text(f'"{name}": ', F.when(c, "true").otherwise("false"))
    covered = obj(flag("performance_score", k % 2 == 1), flag("value_score", k % 3 > 0), F.when(k % 5 == 4, '"community_interest_score": true'))
    metrics = obj(text('"main_accords": {', accords, "}"), text('"wear_profile": ', wear), text('"source_coverage": ', covered))
    rows = t(spark, d, "part").select(
        "p_partkey", F.when(k % 31 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(k % 29 == 0, "N/A").otherwise(F.col("p_brand")).alias("house"), F.when(k % 4 > 0, F.col("p_size").cast("string")).alias("year"),
        F.when(k % 5 > 0, "Women").otherwise("Unknown").alias("gender"), fg.alias("fg"), bn.alias("bn"), metrics.alias("m"),
    )
    made = facts.with_fact_status(rows, {"name": "name", "house": "house", "year": "year", "gender": "gender", "fg_raw": "fg", "bn_raw": "bn", "derived_metrics": "m"})
    return made.select("p_partkey", F.array_join("absent", ",").alias("absent"))


@query("fact_questions", """WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_brand || ' ' || p_name AS n FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'concentration' WHEN 2 THEN 'family' WHEN 3 THEN 'gender' END AS field, CASE k WHEN 0 THEN 'release year' WHEN 1 THEN 'strength' WHEN 2 THEN 'scent family' WHEN 3 THEN 'Gender' END AS label, CASE WHEN k < 4 THEN n END AS target FROM p""")
def fact_questions(spark, d):
    k, n = F.col("p_partkey") % 6, F.concat_ws(" ", "p_brand", "p_name")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    asks = F.when(k == 0, text("What is the release year of  the ", n, "?")).when(k == 1, text("whats the strength ", n)).when(k == 2, text(n, " scent family!")).when(k == 3, text("Gender for a ", n)).when(k == 4, text("Year of ", n)).otherwise(n)
    return asked.with_fact_question(t(spark, d, "part").select("p_partkey", asks.alias("query")), "query").select("p_partkey", "field", "label", "target")


@query("search_texts", """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, p_brand AS b, p_name AS n FROM part), q AS (SELECT *, list_filter(string_split(CASE k WHEN 0 THEN 'Lattafa Perfumes ' || n || ' ' || b WHEN 1 THEN b || ' ' || n WHEN 2 THEN 'Initio Parfums Privés ' || n ELSE n || ' ' || b END, ' '), lambda x: x <> '') AS w FROM p)
  SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(list_transform(w[1:i - 1], lambda x: lower(x)), lower(w[i]))), lambda i: w[i]), ' ') AS search_text FROM q""")
def search_texts(spark, d):
    k, n, b = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand")
    typed = F.when(k == 0, F.concat_ws(" ", F.lit("Lattafa  Perfumes"), n, F.lit("Eau de Parfum Intense"), b)).when(k == 1, F.concat_ws(" ", b, n, F.lit("EDT"), n)).when(k == 2, F.concat_ws(" ", F.lit("initio"), n)).otherwise(F.concat_ws(" ", n, b, F.upper(b)))
    return asked.with_search_text(t(spark, d, "part").select("p_partkey", typed.alias("query")), "query").select("p_partkey", "search_text")


@query("release_years", """WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, replace(p_brand, '#', ' ') AS b, p_name AS n, 1950 + p_size AS y FROM part)
  SELECT p_partkey, y::INT AS year, 'site' || (p_partkey % 3) || '.org' AS domain FROM p WHERE k IN (0, 1)""")
def release_years(spark, d):
    """Snippets that every part's key makes: two of six state its own release, others a flanker's, a prefix's, an update's and none."""
    k, b, n, y = F.col("p_partkey") % 6, F.replace("p_brand", F.lit("#"), F.lit(" ")), F.col("p_name"), (F.col("p_size") + 1950).cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    said = F.when(k == 0, text("News. ", b, " ", n, " was launched in ", y, ". More in 1999!")).when(k == 1, text(F.upper(n), " first introduced during ", y)).when(k == 2, text(n, " Elixir was released in ", y, "."))
    said = said.when(k == 3, text("Gold ", n, " was released in ", y)).when(k == 4, text(n, " was released in ", y, ", updated in 2020")).otherwise(text(n, " is of ", y))
    rows = t(spark, d, "part").select("p_partkey", b.alias("brand"), n.alias("name"), text("About ", b).alias("title"), said.alias("snippet"), text("https://www.site", (F.col("p_partkey") % 3).cast("string"), ".org/x").alias("url"))
    return consensus.release_years(rows, "p_partkey", "brand", "name", "title", "snippet", X.url_host(F.col("url")), 2024).select("p_partkey", "year", "domain")


@query("fact_records", """WITH r AS (SELECT p_brand, p_name, p_size, min('r' || lpad(p_partkey::VARCHAR, 6, '0')) AS record_key FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), u AS (SELECT p_size, min('r' || lpad(p_partkey::VARCHAR, 6, '0')) AS k FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 4 = 0 GROUP BY 1), n AS (SELECT p_brand, p_name, min(record_key) AS k FROM r GROUP BY 1, 2), i AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS s FROM part WHERE p_partkey % 2 = 1)
  SELECT p_partkey, coalesce(u.k, n.k) AS record_key, CASE WHEN u.k IS NOT NULL THEN 'bn_url' ELSE 'identity' END AS by FROM i LEFT JOIN u ON i.s = u.p_size LEFT JOIN n USING (p_brand, p_name) WHERE coalesce(u.k, n.k) IS NOT NULL""")
def fact_records(spark, d):
    p, size = t(spark, d, "part"), F.col("p_size").cast("string")
    page = F.concat(F.lit("https://b.org/"), size)
    records = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("r"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("record_key"), F.col("p_name").alias("name"), F.col("p_brand").alias("house"), F.lit("").alias("fg_url"), F.when(F.col("p_partkey") % 4 == 0, page).alias("bn_url"))
    items = p.where("p_partkey % 2 = 1").select("p_partkey", F.upper("p_name").alias("name"), F.col("p_brand").alias("house"), F.lit(None).cast("string").alias("fg_url"), F.when(F.col("p_partkey") % 5 == 0, page).alias("bn_url"))
    return gates.fact_records(items, records, "p_partkey")


@query("queueable_jobs", """WITH p AS (SELECT *, p_partkey % 5 AS k, lower(trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS ident FROM part)
  SELECT CASE k WHEN 0 THEN 'https://www.fragrantica.com/perfume/A/B-' || (p_partkey // 10) || '.html' WHEN 1 THEN 'https://basenotes.com/fragrances/x.' || p_partkey ELSE 'id:' || ident END AS job_key, min(p_name) AS name, arg_min(p_brand, (p_name, p_brand)) AS house, -10 AS priority FROM p WHERE k < 4 GROUP BY 1""")
def queueable_jobs(spark, d):
    k = F.col("p_partkey") % 5
    main = F.when(k == 0, F.concat(F.lit("fragrantica.com/perfume/A/B-"), F.floor(F.col("p_partkey") / 10), F.lit(".html?x")))
    second = F.when(k == 1, F.concat(F.lit("https://www.basenotes.com/fragrances/x."), "p_partkey", F.lit("/")))
    name = F.when(k == 4, F.concat("p_name", F.lit(" body lotion"))).otherwise(F.col("p_name"))
    rows = t(spark, d, "part").select(name.alias("name"), F.col("p_brand").alias("house"), main.alias("fg"), second.alias("bn"), F.lit(None).cast("int").alias("year"))
    return gates.queueable(rows, "name", "house", "fg", "bn", "year").select("job_key", "name", "house", "priority")


@query("results_with_catalogue", """WITH r AS (SELECT p_size AS q, p_name, 0 AS origin, max(p_retailprice) AS s FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2), c AS (SELECT p_size AS q, p_name, 1 AS origin, max(p_retailprice) AS s FROM part GROUP BY 1, 2), b AS (SELECT * FROM r UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.q = c.q AND r.p_name = c.p_name))
  SELECT q, p_name, origin, s, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY origin, s DESC, p_name) AS rank FROM b) WHERE rank <= 4""")
def results_with_catalogue(spark, d):
    rows = t(spark, d, "part").select(F.col("p_size").alias("q"), "p_name", F.col("p_retailprice").alias("s"), "p_partkey")
    return gates.with_catalogue(rows.where("p_partkey % 3 = 0"), rows, "q", ["p_name"], "s", 4).select("q", "p_name", "origin", "s", "rank")


@query("displayable_rows", """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, replace(p_brand, '#', ' ') AS b, p_name AS n, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS title FROM part)
  SELECT p_partkey, CASE WHEN k = 1 THEN title ELSE n END AS name, b AS house FROM p WHERE k < 2""")
def displayable_rows(spark, d):
    k, b = F.col("p_partkey") % 4, F.replace("p_brand", F.lit("#"), F.lit(" "))
    slug = lambda c: F.replace(c, F.lit(" "), F.lit("-"))
    url = F.when(k == 1, F.concat(F.lit("https://www.fragrantica.com/perfume/"), slug(b), F.lit("/"), slug(F.col("p_name")), F.lit("-"), "p_partkey", F.lit(".html")))
    name = F.when(k == 0, F.col("p_name")).when(k == 1, "votes").when(k == 2, b).otherwise("Unknown")
    rows = spread(t(spark, d, "part")).select("p_partkey", name.alias("name"), b.alias("house"), url.alias("fg"), F.lit(None).cast("string").alias("bn"))
    return gates.displayable(rows, "name", "house", "fg", "bn").select("p_partkey", "name", "house")


@query("stored_urls", r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN upper(url) WHEN 1 THEN url || '//' WHEN 2 THEN ' ' || url ELSE '' END AS u FROM pages), p AS (SELECT page_id, regexp_replace(trim(u), '/+$', '') AS u FROM u)
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(u, '^[^:]*://[^/]*')) || substr(u, length(regexp_extract(u, '^[^:]*://[^/]*')) + 1), '/+$', ''), '') AS url FROM p""")
def stored_urls(spark, d):
    k, url = F.col("page_id") % 4, F.col("url")
    typed = F.when(k == 0, F.upper(url)).when(k == 1, F.concat(url, F.lit("//"))).when(k == 2, F.concat(F.lit(" "), url)).otherwise("")
    return t(spark, d, "pages").select("page_id", X.stored_url(typed).alias("url"))


@query("record_scalars", """WITH p AS (SELECT *, p_partkey AS k FROM part)
  SELECT p_partkey, CASE WHEN k % 3 < 2 THEN p_type END AS concentration, CASE WHEN k % 4 > 0 THEN p_size::VARCHAR ELSE '1999' END AS year, CASE WHEN k % 5 = 0 THEN 'Women' WHEN k % 5 = 1 THEN 'Men' END AS gender, CASE k % 4 WHEN 0 THEN 'https://i.org/' || k WHEN 1 THEN 'http://r.org/' || k WHEN 2 THEN 'https://f.org/' || k END AS image_url FROM p""")
def record_scalars(spark, d):
    k = F.col("p_partkey")
    text = lambda name, c: F.concat(F.lit(f'"{name}": "'), c, F.lit('"'))
    own = F.concat(F.lit('"raw_identity": {'), F.concat_ws(", ", F.when(k % 3 == 1, text("concentration", F.col("p_type"))), F.lit('"year": 1999'), F.when(k % 5 == 1, text("gender", F.lit("Men"))), F.when(k % 4 == 1, text("imageUrl", F.concat(F.lit(" http://r.org/"), k)))), F.lit("}"))
    blob = F.concat(F.lit("{"), F.concat_ws(", ", F.when(k % 3 == 0, text("concentration", F.col("p_type"))).when(k % 3 == 1, text("concentration", F.lit("Unknown"))), own, F.when(k % 4 == 2, text("image_url", F.concat(F.lit("https://f.org/"), k))), F.when(k % 4 == 3, text("image_url", F.lit("/local.png")))), F.lit("}"))
    fields = {"year": F.when(k % 4 > 0, F.col("p_size")), "gender": F.when(k % 5 == 0, "Women").otherwise("Unisex / Unspecified"), "image_url": F.when(k % 4 == 0, F.concat(F.lit("https://i.org/"), k)).otherwise("n/a"), "fg_raw": blob}
    return t(spark, d, "part").select("p_partkey", facts.record_scalars(fields).alias("s")).select("p_partkey", "s.*")


@query("note_tokens", """WITH p AS (SELECT p_partkey, p_name AS n, string_split(p_name, ' ') AS w FROM part)
  SELECT p_partkey, 0 AS layer, 1 AS place, w[1] || ' one' AS note FROM p UNION ALL SELECT p_partkey, 0, 2, w[-1] || ' two' FROM p UNION ALL SELECT p_partkey, 1, 1, 'Oud' FROM p UNION ALL SELECT p_partkey, 1, 2, n FROM p""")
def note_tokens(spark, d):
    first, last = F.get(F.split("p_name", " "), F.lit(0)), F.element_at(F.split("p_name", " "), -1)
    notes_of = F.array(
        F.struct(F.lit(0).alias("layer"), F.lit(0).alias("pos"), F.concat(first, F.lit(" one or "), last, F.lit(" two™")).alias("note")), F.struct(F.lit(0).alias("layer"), F.lit(1).alias("pos"), F.concat(F.upper(last), F.lit(" Two.")).alias("note")),
        F.struct(F.lit(1).alias("layer"), F.lit(0).alias("pos"), F.lit("Agarwood (Oud)").alias("note")), F.struct(F.lit(1).alias("layer"), F.lit(1).alias("pos"), F.concat(F.lit("· "), "p_name", F.lit(",")).alias("note")), F.struct(F.lit(1).alias("layer"), F.lit(2).alias("pos"), F.lit("oud").alias("note")),
    )
    rows = spread(t(spark, d, "part")).select("p_partkey", F.explode(notes_of).alias("x")).select("p_partkey", "x.*")
    return notes.tokens_cleaned(rows, "p_partkey", "layer", "pos", "note", {"agarwood": "oud"})


@query("queue_diagnostics", """SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'ignored' ELSE 'retry_history' END AS "group", o_orderkey::VARCHAR AS id, o_orderpriority AS name, (o_orderkey % 3)::VARCHAR AS failure_count, CASE WHEN o_orderkey % 2 = 0 THEN 'fg_resolver_blocked' ELSE 'none' END AS error_bucket FROM orders WHERE o_orderstatus IN ('F', 'P') OR o_orderkey % 3 > 0""")
def queue_diagnostics(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "ignored").otherwise("pending")
    jobs = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 3).alias("failure_count"), F.when(F.col("o_orderkey") % 2 == 0, "Rate limited by x").alias("last_error"))
    return records.queue_diagnostics(jobs).select("group", "id", "name", "failure_count", "error_bucket")
