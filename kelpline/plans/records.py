"""Queries of identities, metrics, notes, facts, records and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, bundle, cascade, identity, notes, payloads, records
from ..sources.tables import spread
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


@query("keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 200")
def keyset_page(spark, d):
    return records.page_after(t(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey", "o_custkey")


@query("key_lookup", "SELECT page_id, url FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 7)")
def key_lookup(spark, d):
    pages = t(spark, d, "pages")
    return pages.join(F.broadcast(records.lookup(pages, "page_id", 7).select("url").limit(1)), "url", "left_semi").select("page_id", "url")


@query("wardrobe_blobs", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id END AS owner, CASE WHEN event_id % 3 = 0 THEN 'blob' ELSE event_type END AS name, 'b' || user_id AS brand, CASE WHEN event_id % 5 > 0 THEN (event_id % 7)::INTEGER END AS year FROM events""")
def wardrobe_blobs(spark, d):
    k = F.col("event_id")
    blob = F.when(k % 5 == 0, F.when(k % 3 == 0, F.lit('{"name": "blob", "year": "x"}')).otherwise("{broken")).otherwise(F.to_json(F.struct(F.when(k % 3 == 0, "blob").alias("name"), (k % 7).cast("int").alias("year"))))
    rows = t(spark, d, "events").select(k, "user_id", F.concat(F.lit("u"), "user_id").alias("owner"), F.col("event_type").alias("name"), F.concat(F.lit("b"), "user_id").alias("brand"), blob.alias("blob"))
    return records.blobs(rows.where("user_id % 2 = 0"), rows.where("user_id % 2 = 1"), "event_id", "blob", "name string, year int")


@query("wardrobe_filter", """SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'""")
def wardrobe_filter(spark, d):
    return t(spark, d, "events").where(records.json_equals(F.col("props"), "$.k", "7")).select("event_id")


@query("brand_entries", "SELECT p_brand, count(*) AS n, min(p_name) AS first_handle, max(p_name) AS last_handle, array_to_string(list_slice(list_sort(list_distinct(list(p_name))), 1, 5), '|') AS handles FROM part GROUP BY p_brand")
def brand_entries(spark, d):
    return records.brand_sizes(t(spark, d, "part"), "p_brand", "p_name").withColumn("handles", F.array_join("handles", "|"))


@query("stale_records", "SELECT event_id, event_id % 7 > 0 AND ts < TIMESTAMP '2024-01-24 00:00:00' AS stale FROM events")
def stale_records(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    captured = F.when(F.col("event_id") % 7 == 0, "soon").when(F.col("event_id") % 2 == 0, text).otherwise("")
    return t(spark, d, "events").select("event_id", records.stale(captured, text, F.lit(NOW).cast("timestamp")).alias("stale"))


@query("no_source_lines", "SELECT p_partkey, p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND starts_with(lower(p_name), 'red')) OR (p_partkey % 3 = 2 AND contains(lower(p_name), 'ring')) AS retired FROM part")
def no_source_lines(spark, d):
    rules = (("house 0", "any", ""), ("house 1", "prefix", "red"), ("house 2", "contains", "ring"))
    house = F.concat(F.lit("House-"), (F.col("p_partkey") % 3).cast("string"))
    return t(spark, d, "part").select("p_partkey", records.without_source(house, F.col("p_name"), rules).alias("retired"))


@query("record_key_search", """WITH r AS (SELECT 'k' || lpad(c_custkey::VARCHAR, 9, '0') AS record_key, 'f' || c_custkey AS fg, 'b' || (c_custkey % 50) AS bn FROM customer),
  a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || o_custkey END AS fg, CASE WHEN o_orderkey % 2 = 0 THEN 'b' || (o_orderkey % 60) END AS bn, 'k' || lpad(o_custkey::VARCHAR, 9, '0') AS fallback FROM orders),
  h AS (SELECT o_orderkey, 0 AS p, record_key FROM a JOIN r ON a.fg = r.fg UNION ALL SELECT o_orderkey, 1, record_key FROM a JOIN r ON a.bn = r.bn UNION ALL SELECT o_orderkey, 2, record_key FROM a JOIN r ON a.fallback = record_key),
  b AS (SELECT o_orderkey, arg_min(record_key, (p, record_key)) AS record_key, count(DISTINCT record_key) - 1 AS merged FROM h GROUP BY 1)
  SELECT a.o_orderkey, coalesce(b.record_key, a.fallback) AS record_key, coalesce(b.merged, 0) AS merged FROM a LEFT JOIN b USING (o_orderkey)""")
def record_key_search(spark, d):
    padded = lambda c: F.concat(F.lit("k"), F.lpad(F.col(c).cast("string"), 9, "0"))
    known = t(spark, d, "customer").select(padded("c_custkey").alias("record_key"), F.concat(F.lit("f"), "c_custkey").alias("fg_url"), F.concat(F.lit("b"), F.col("c_custkey") % 50).alias("bn_url"))
    k = F.col("o_orderkey")
    asked = t(spark, d, "orders").select(k, F.when(k % 3 == 0, F.concat(F.lit("f"), "o_custkey")).alias("fg_url"), F.when(k % 2 == 0, F.concat(F.lit("b"), k % 60)).alias("bn_url"), padded("o_custkey").alias("fallback"))
    return records.record_keys(asked, known, "o_orderkey")


@query("concentration_fill", """WITH f AS (SELECT p_brand AS h, p_name AS n, min(p_type) AS v FROM part WHERE p_partkey % 4 = 0 GROUP BY 1, 2)
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE coalesce(v, 'Unknown') END AS value, p_partkey % 3 > 0 AND v IS NOT NULL AS filled FROM part LEFT JOIN f ON h = p_brand AND n = p_name""")
def concentration_fill(spark, d):
    rows = t(spark, d, "part")
    found = rows.where("p_partkey % 4 = 0").select(F.col("p_brand").alias("house"), F.upper("p_name").alias("name"), F.col("p_type").alias("value"), F.lit("s").alias("source"))
    mine = rows.select("p_partkey", F.col("p_brand").alias("house"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("Unknown").alias("value"))
    return records.matched_fill(mine, found, "house", "name", "value").select("p_partkey", "value", "filled")


@query("heartbeat_age", "SELECT max(ts) AS last_beat, epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT AS age_seconds FROM events WHERE event_type = 'view'")
def heartbeat_age(spark, d):
    found = records.heartbeat_age(t(spark, d, "events").where("event_type = 'view'"), "ts", F.lit(NOW).cast("timestamp"))
    return found.select(F.col("last_beat").cast("timestamp_ntz").alias("last_beat"), "age_seconds")


@query("oldest_command", "SELECT event_id, event_type FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 1")
def oldest_command(spark, d):
    return records.oldest(t(spark, d, "events"), "event_type", "signup", "ts", "event_id").select("event_id", "event_type")


@query("newest_commands", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest_commands(spark, d):
    return records.newest(t(spark, d, "events"), "ts", "event_id", 500).select("event_id", "event_type")


@query("dashboard", "SELECT count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'processing') AS processing, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'processing' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 900 SECOND) AS stale_processing, count(*) AS total FROM (SELECT ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' ELSE 'done' END AS s FROM events)")
def dashboard(spark, d):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").otherwise("done")
    return records.dashboard(t(spark, d, "events").withColumn("status", status), "status", ("pending", "processing", "failed"), "ts", F.lit(NOW).cast("timestamp"))


@query("sweep_counts", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'present' WHEN o_orderpriority = '5-LOW' THEN 'no_raw' ELSE 'recomputed' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def sweep_counts(spark, d):
    return records.sweep_counts(t(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderpriority") != "5-LOW")


@query("launch_years", "SELECT p_partkey, CASE WHEN p_partkey % 40 + 1990 IN (2005, p_size + 1990) THEN '1888' ELSE (p_partkey % 40 + 1990)::VARCHAR END AS year FROM part")
def launch_years(spark, d):
    return t(spark, d, "part").select("p_partkey", X.launch_year(F.concat_ws(" ", F.lit("since 1888, launched"), (F.col("p_partkey") % 40 + 1990).cast("string"), "p_name"), F.lit("House 2005"), F.concat(F.lit("Lot "), (F.col("p_size") + 1990).cast("string"))).alias("year"))


@query("canonical_brands", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ysl' WHEN 1 THEN 'tom ford' WHEN 2 THEN 'dolce and gabbana' WHEN 3 THEN '' ELSE 'hermes' END AS brand FROM part")
def canonical_brands(spark, d):
    asked = F.get(F.array(*[F.lit(x) for x in ("Yves Saint-Laurent", "FORD", "D & G", "nobody", "Hermès")]), (F.col("p_partkey") % 5).cast("int"))
    return t(spark, d, "part").select("p_partkey", identity.canonical_brand(X.normalize_identity(asked)).alias("brand"))


@query("brand_compatible", "SELECT p_partkey, p_partkey % 4 <> 3 AS same FROM part")
def brand_compatible(spark, d):
    pick = lambda *xs: X.normalize_identity(F.get(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % 4).cast("int")))
    return t(spark, d, "part").select("p_partkey", identity.same_brand(pick("YSL", "Versace Parfums", "Mont Blanc", "Dior"), pick("Yves St Laurent", "Versace", "Montblanc", "Prada")).alias("same"))


@query("house_stripped", "SELECT p_partkey, p_name AS name FROM part")
def house_stripped(spark, d):
    named = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", F.lit("Hermès"), "p_name")).otherwise(F.concat_ws(" ", "p_name", F.lit("by Hermès")))
    rows = spread(t(spark, d, "part")).select("p_partkey", named.alias("full"), F.lit("Hermes").alias("house"))
    return identity.with_stripped_name(rows, "full", "house", "name").select("p_partkey", "name")


_QUERIES = ("red ring", "smal blue widget", "brand#11")


@query("relevance_scores")
def relevance_scores(spark, d):
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(_QUERIES)], "query_id int, query string")
    kinds = t(spark, d, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey"))
    scored = identity.with_relevance(kinds.crossJoin(F.broadcast(asked)), "query", "p_name", "p_brand")  # a stated set of three queries
    return scored.where("relevant").select("query_id", "p_partkey", F.round("score", 6).alias("score"))


@query("identity_scores")
def identity_scores(spark, d):
    rows = spread(t(spark, d, "part")).select("p_partkey", "p_brand", "p_name", (F.col("p_size") + 1990).cast("string").alias("y"))
    other = F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), F.get(F.split("p_name", " "), F.lit(0)))
    pairs = rows.withColumns({"other": other, "z": F.lit("2001")})
    return identity.with_identity_score(pairs, ("p_brand", "p_name", "y"), ("p_brand", "other", "z")).select("p_partkey", F.round("score", 6).alias("score"))


@query("candidate_sort", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 24")
def candidate_sort(spark, d):
    return identity.ranked_candidates(t(spark, d, "orders"), "o_custkey", [F.col("o_totalprice"), F.col("o_orderpriority")], "o_orderkey", 24).select("o_custkey", "o_orderkey", "rank")


@query("search_diagnostics", "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS linked, count(*) FILTER (o_orderstatus <> 'F') = 0 AS degraded, greatest(0, count(*) - 10) AS truncated FROM orders GROUP BY o_custkey")
def search_diagnostics(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("url"))
    return identity.diagnostics(rows, "o_custkey", "url", 10)


@query("needs_repair", "WITH s AS (SELECT o_custkey, o_totalprice / 500000.0::DOUBLE AS s, o_orderstatus = 'F' AS n FROM orders) SELECT o_custkey, max(s) FILTER (n) AS best_native, max(s) AS best, NOT (coalesce(max(s) FILTER (n), 0) >= 0.72::DOUBLE OR max(s) >= 0.78::DOUBLE) AND max(s) < 0.72::DOUBLE AS repair FROM s GROUP BY 1")
def needs_repair(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / F.lit(500000.0)).alias("score"), (F.col("o_orderstatus") == "F").alias("native"))
    return identity.needs_repair(rows, "o_custkey", "score", "native")


def _cards(spark, d):
    """Cards of each part: what its order lines say, as votes."""
    votes = t(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_linenumber", "l_returnflag", "l_linestatus")
    counted = lambda name, label, value=F.lit(None).cast("string"), rows=votes: rows.groupBy("l_partkey", label.alias("label"), value.alias("value")).agg(F.sum("q").alias("n")).where("label is not null").select("l_partkey", F.lit(name).alias("card"), "label", "value", "n")
    flag = F.when(F.col("l_returnflag") == "A", "Weak").when(F.col("l_returnflag") == "N", "Moderate").otherwise("Long lasting")
    every = counted("Rating Distribution", F.concat(F.col("l_linenumber").cast("string"), F.lit(" stars")), F.col("l_linenumber").cast("string"), votes.where("l_linenumber <= 5"))
    for more in (counted("Longevity", flag), counted("Sillage", F.when(F.col("l_linestatus") == "O", "Strong").otherwise("Intimate")), counted("When to Wear", F.when(F.col("l_returnflag") == "A", "winter").when(F.col("l_returnflag") == "N", "Spring").otherwise("Night"))):
        every = every.unionByName(more)
    row = F.struct("label", "value", F.col("n").cast("double").alias("pct"), F.format_number("n", 0).alias("count"))
    cards = every.groupBy("l_partkey", "card").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # a row a label
    return cards.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("card", "rows"))).alias("cards"))


@query("metric_bundle", """WITH l AS (SELECT l_partkey, l_quantity::BIGINT AS q, l_linenumber AS s, l_returnflag AS f, l_linestatus AS o FROM lineitem),
  a AS (SELECT l_partkey, sum(CASE WHEN s <= 5 THEN s * q END)::DOUBLE / sum(CASE WHEN s <= 5 THEN q END) / 5.0::DOUBLE * 100.0::DOUBLE AS rating,
    sum(CASE f WHEN 'A' THEN 40 WHEN 'N' THEN 70 ELSE 90 END * q)::DOUBLE / sum(q) AS lon, sum(CASE o WHEN 'O' THEN 85 ELSE 55 END * q)::DOUBLE / sum(q) AS sil,
    coalesce(sum(q) FILTER (f = 'A'), 0) AS winter, coalesce(sum(q) FILTER (f = 'N'), 0) AS spring, coalesce(sum(q) FILTER (f = 'R'), 0) AS night FROM l GROUP BY 1),
  p AS (SELECT *, (lon * 0.6::DOUBLE + sil * 0.4::DOUBLE) / (0.6::DOUBLE + 0.4::DOUBLE) AS perf FROM a)
  SELECT l_partkey, rating IS NOT NULL AS has_rating, round(rating, 6) AS rating, round(perf, 6) AS performance, CASE WHEN winter + spring > 0 THEN CASE WHEN winter >= spring AND winter > 0 AND NOT (spring = winter) THEN 'Winter' WHEN spring > winter THEN 'Spring' ELSE 'Spring' END END AS season, CASE WHEN night > 0 THEN 'Night' END AS time,
  CASE WHEN rating IS NULL THEN 1 ELSE 2 END AS n_components,
  round((coalesce(rating * 0.45::DOUBLE, 0) + perf * 0.15::DOUBLE) / (CASE WHEN rating IS NULL THEN 0 ELSE 0.45::DOUBLE END + 0.15::DOUBLE), 6) AS crowd FROM p""")
def metric_bundle(spark, d):
    none = F.lit(None).cast("struct<pos:bigint,neu:bigint,neg:bigint>")
    empty = F.lit(None).cast("struct<top:array<string>,heart:array<string>,base:array<string>,flat:array<string>>")
    rows = _cards(spark, d).withColumns({"consensus": none, "notes": empty, "name": F.lit("x"), "brand": F.lit("y")})
    b = bundle.with_bundle(rows, "cards", "consensus", "notes", "name", "brand", "b")
    return b.select("l_partkey", F.col("b.coverage.rating").alias("has_rating"), F.round("b.rating.score", 6).alias("rating"), F.round("b.performance.score", 6).alias("performance"), F.get("b.wear_profile.primary_seasons", F.lit(0)).alias("season"), F.col("b.wear_profile.primary_time").alias("time"), F.col("b.headline.n_components").alias("n_components"), F.round("b.headline.score_raw", 6).alias("crowd"))


@query("legacy_scorecard", """WITH l AS (SELECT l_partkey, sum(l_quantity::BIGINT * CASE l_returnflag WHEN 'A' THEN 92 WHEN 'N' THEN 92 ELSE 92 END)::DOUBLE / sum(l_quantity::BIGINT) AS lon, sum(l_quantity::BIGINT * CASE l_linestatus WHEN 'O' THEN 82 ELSE 35 END)::DOUBLE / sum(l_quantity::BIGINT) AS sil FROM lineitem GROUP BY 1)
  SELECT l_partkey, round((lon + sil) / 2, 6) AS performance, 1 AS n_parts FROM l""")
def legacy_scorecard(spark, d):
    rows = _cards(spark, d).withColumn("consensus", F.lit(None).cast("struct<pos:double,neu:double>"))
    s = bundle.with_scorecard(rows, "cards", "consensus", "s")
    return s.select("l_partkey", F.round("s.performance", 6).alias("performance"), F.col("s.n_parts").alias("n_parts"))


@query("card_ranks", "SELECT event_id, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 ELSE 20 END AS rank FROM events")
def card_ranks(spark, d):
    card = F.when(F.col("event_type") == "view", "Longevity").when(F.col("event_type") == "click", "Projection").when(F.col("event_type") == "signup", "Price Value").otherwise("Other")
    return t(spark, d, "events").select("event_id", bundle.card_rank(card).alias("rank"))


def _audited():
    k = F.col("p_partkey")
    return {
        "brand": F.when(k % 11 == 0, "").otherwise(F.col("p_brand")), "name": F.when(k % 13 == 0, F.concat_ws("|", "p_name", "p_name")).when(k % 17 == 0, F.concat_ws(" ", "p_name", F.lit("2019"))).otherwise(F.col("p_name")),
        "source_url": F.when(k % 5 == 0, "www.x.org/a").when(k % 5 == 1, "https://x.org/a"),
        "accords": F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 == 1, F.array(F.lit("woody"))).when(k % 7 == 2, F.array(F.lit("Woody"), F.lit("12%"))).when(k % 7 == 3, F.array(F.lit("Woody"), F.lit("Warm Spicy"))),
        "family": F.when(k % 6 == 0, "Unknown").when(k % 6 == 1, "Oriental").when(k % 6 == 2, "Chypere").when(k % 6 == 3, "floral woody").when(k % 6 == 4, "Plastic").otherwise("Floral"),
        "concentration": F.when(k % 3 == 0, "-").when(k % 3 == 1, "Soap").otherwise("Parfum"), "gender": F.when(k % 4 == 0, "").when(k % 4 == 1, "men").otherwise("Unisex"),
        "year": (F.col("p_size") + 1790).cast("string"), "year_is_text": k % 2 == 0,
    }


@query("row_audit", r"""WITH r AS (SELECT p_partkey AS k, p_size, p_name, p_brand FROM part)
  SELECT k AS p_partkey, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'brand_missing' END, CASE WHEN k % 5 = 0 THEN 'source_url_malformed' END, CASE WHEN k % 7 = 2 THEN 'accord_junk' END, CASE WHEN k % 7 = 1 THEN 'accord_case' END, CASE WHEN k % 7 = 0 THEN 'accords_empty' END,
    CASE WHEN k % 7 IN (1, 2) THEN 'single_accord' END, CASE WHEN k % 7 > 3 THEN 'accords_missing' END, CASE WHEN k % 6 = 0 THEN 'family_unknown' END, CASE WHEN k % 6 = 1 THEN 'family_deprecated' END, CASE WHEN k % 6 = 2 THEN 'family_typo' END,
    CASE WHEN k % 6 = 3 THEN 'family_case' END, CASE WHEN k % 6 IN (2, 4) THEN 'family_unexpected' END, CASE WHEN k % 3 = 0 THEN 'concentration_unknown' END, CASE WHEN k % 3 = 1 THEN 'concentration_unexpected' END, CASE WHEN k % 4 = 0 THEN 'gender_missing' END, CASE WHEN k % 4 = 1 THEN 'gender_unexpected' END,
    CASE WHEN k % 2 = 0 THEN 'year_string' END, CASE WHEN p_size + 1790 < 1800 THEN 'year_range' END, CASE WHEN k % 13 = 0 THEN 'name_self_dup' END, CASE WHEN k % 17 = 0 AND k % 13 > 0 THEN 'name_has_year' END], lambda x: x IS NOT NULL), ',') AS issues FROM r""")
def row_audit(spark, d):
    found = audit.tags(audit.row_rules(_audited(), F.lit("2024-01-31").cast("date")))
    return t(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("issues"))


@query("gender_year", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Feminine' WHEN p_partkey % 4 = 1 THEN 'Unisex' WHEN p_partkey % 4 = 2 THEN 'Masculine' END AS gender,
  CASE WHEN p_partkey % 3 = 0 THEN (1990 + p_size)::VARCHAR WHEN p_partkey % 3 = 1 THEN '2004' ELSE '1999' END AS year FROM part""")
def gender_year(spark, d):
    k = F.col("p_partkey")
    card = F.array(F.struct(F.lit("Gender").alias("card"), F.array(F.struct(F.lit("male").alias("label"), F.lit(None).cast("string").alias("value"), F.lit(1.0).alias("pct"), F.lit("3").alias("count")), F.struct(F.lit("more female").alias("label"), F.lit(None).cast("string").alias("value"), F.lit(1.0).alias("pct"), F.lit("1.2k").alias("count"))).alias("rows")))
    cards = F.when(k % 4 == 0, card).otherwise(F.array().cast(bundle.CARDS))
    said = F.when(k % 4 == 1, "A fragrance for women and men.").otherwise("Plain.")
    text = F.concat_ws(" ", said, F.when(k % 3 == 1, "It was launched in 2004, after 1980.").when(k % 3 == 2, "From 1999 to 2001."))
    name = F.when(k % 4 == 2, "Blue for him").otherwise("Blue")
    found = cascade.gender(F.lit("Unisex / Unspecified"), cards, said, name)
    year = cascade.year(F.lit("0"), F.when(k % 3 == 0, (F.col("p_size") + 1990).cast("string")), text, F.lit("1888 by House 1888"), F.lit("House 1888"), name)
    return t(spark, d, "part").select("p_partkey", found.alias("gender"), year.alias("year"))


@query("product_concentrations", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Eau de Parfum' WHEN 1 THEN 'Eau de Toilette' WHEN 2 THEN 'Extrait' WHEN 3 THEN 'Body Spray' WHEN 4 THEN 'Parfum' ELSE 'Unknown' END AS stored, CASE p_partkey % 6 WHEN 0 THEN 95 WHEN 1 THEN 95 WHEN 2 THEN 95 WHEN 3 THEN 95 WHEN 4 THEN 95 ELSE 70 END AS confidence FROM part""")
def product_concentrations(spark, d):
    kinds = ("Women's EDP spray", "Eau de Toilette", "Extrait de Parfum", "Hair-Mist", "PARFUM", "Candle")
    stored = cascade.product_concentration(F.get(F.array(*[F.lit(x) for x in kinds]), (F.col("p_partkey") % 6).cast("int")))
    none = F.lit(None).cast("string")
    best = cascade.concentration(stored, none, F.lit("Eau de Parfum"), none, none, F.lit(0))
    return t(spark, d, "part").select("p_partkey", stored.alias("stored"), best["confidence"].alias("confidence"))


@query("unknown_years", """WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'parfumo.net' WHEN 1 THEN 'm.fragrantica.com' ELSE 'shop.org' END AS dom, o_orderkey % 2 = 0 AS said FROM orders),
  h AS (SELECT o_custkey, dom, min(o_orderkey) AS k FROM r WHERE said AND dom <> 'shop.org' GROUP BY 1, 2) SELECT o_custkey, array_to_string(list_sort(list(dom)), ',') AS domains, count(*) AS evidence_count FROM h GROUP BY 1""")
def unknown_years(spark, d):
    k = F.col("o_orderkey")
    host = F.when(k % 3 == 0, "parfumo.net").when(k % 3 == 1, "m.fragrantica.com").otherwise("shop.org")
    rows = t(spark, d, "orders").select("o_custkey", k.alias("pos"), F.lit("Lattafa").alias("brand"), F.lit("Ramz Gold").alias("name"), F.lit("Ramz Lattafa Gold").alias("title"), F.when(k % 2 == 0, "The Release Year is unknown.").otherwise("Released in 2001.").alias("snippet"), F.concat(F.lit("https://www."), host, F.lit("/p/"), k).alias("url"))
    found = cascade.unknown_years(rows, "o_custkey", "brand", "name", "title", "snippet", "url", ("parfumo.net", "fragrantica.com"))
    return found.select("o_custkey", F.array_join("domains", ",").alias("domains"), "evidence_count")


@query("weighted_ballots", """WITH b AS (SELECT o_custkey, o_orderstatus AS choice, CASE o_orderpriority WHEN '1-URGENT' THEN 10.0::DOUBLE WHEN '2-HIGH' THEN 6.0::DOUBLE ELSE 2.0::DOUBLE END * CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM orders WHERE o_orderkey % 4 < 3),
  s AS (SELECT o_custkey, choice, sum(w) AS weight FROM b GROUP BY 1, 2) SELECT o_custkey, choice, weight, weight * 100.0::DOUBLE / sum(weight) OVER (PARTITION BY o_custkey) AS share, row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, choice) AS rank FROM s""")
def weighted_ballots(spark, d):
    k = F.col("o_orderkey")
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", "url").when(F.col("o_orderpriority") == "2-HIGH", "title").otherwise("snippet")
    weight = cascade.ballot_weight(tier, F.when(k % 4 < 3, "stated").otherwise("none"), (k % 3).cast("int"), {"url": 10.0, "title": 6.0, "snippet": 2.0}, {"stated": 1.0}, (1.0, 0.5, 0.25))
    return cascade.vote(t(spark, d, "orders").withColumn("choice", F.col("o_orderstatus")), "o_custkey", "choice", weight)


@query("notes_deduped", """SELECT p_partkey, layer, place, note FROM (SELECT p_partkey, unnest([0, 0, 1]) AS layer, unnest([1, 2, 1]) AS place, unnest(['Vanilla', 'Oud', 'Cedar']) AS note FROM part)""")
def notes_deduped(spark, d):
    asked = F.array(F.struct(F.lit(0).alias("layer"), F.array(F.lit("Madagascar Vanilla"), F.lit("Agarwood (Oud)")).alias("n")), F.struct(F.lit(1).alias("layer"), F.array(F.lit("Vanilla"), F.lit("Cedarwood or Cedar.")).alias("n")))
    rows = spread(t(spark, d, "part")).select("p_partkey", F.explode(asked).alias("l")).select("p_partkey", "l.layer", F.posexplode("l.n").alias("position", "note"))
    return notes.deduped(rows, "p_partkey", "layer", "position", "note")


@query("payload_urls", """SELECT page_id, 'https://fragrantica.com/perfume/House/N-' || page_id || '.html' AS url, 0 AS pos FROM pages""")
def payload_urls(spark, d):
    k = F.col("page_id").cast("string")
    rows = F.array(*[F.struct(F.concat(F.lit("https://www.Fragrantica.com/perfume/House/N-"), k, F.lit(tail)).alias("url"), F.lit("t").alias("title")) for tail in (".html?x=1", ".html#y")], F.struct(F.lit("https://shop.org/a").alias("url"), F.lit("t").alias("title")))
    payload = F.to_json(F.struct(F.array(F.struct(F.to_json(F.struct(F.struct(rows.alias("organic")).alias("results"))).alias("content"))).alias("results")))
    found = payloads.result_rows(t(spark, d, "pages").select("page_id", payload.alias("p")), "page_id", "p")
    return payloads.page_urls(found, "page_id")


@query("payload_images", """SELECT page_id, 1::BIGINT AS rank, 'https://i.org/' || page_id || '.jpg' AS image_url, 'shop.org' AS source FROM pages UNION ALL SELECT page_id, 2, 'https://i.org/t.png', 'cam' FROM pages""")
def payload_images(spark, d):
    k = F.col("page_id").cast("string")
    image = lambda high, thumb, link, source: F.struct(high.alias("high_res_image"), thumb.alias("thumbnail_url"), link.alias("link"), source.alias("source"))
    none = F.lit(None).cast("string")
    one = image(F.concat(F.lit("https://i.org/"), k, F.lit(".jpg")), F.lit("https://i.org/s.jpg"), F.lit("https://www.shop.org/p"), none)
    rows = F.array(one, one, image(F.lit("data:x"), F.lit("https://i.org/t.png"), none, F.lit("cam")))
    found = payloads.result_rows(t(spark, d, "pages").select("page_id", F.to_json(F.struct(F.struct(rows.alias("images")).alias("data"))).alias("p")), "page_id", "p")
    return payloads.images(found, "page_id").select("page_id", "rank", "image_url", "source")


@query("url_predicates", """SELECT page_id, page_id % 3 = 0 AS perfume, page_id % 3 = 1 AS designer, page_id % 3 = 2 AS blocked, CASE WHEN page_id % 3 < 2 THEN 'main' ELSE 'openweb' END AS tier FROM pages""")
def url_predicates(spark, d):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, "https://www.fragrantica.com/perfume/A/B-12.html").when(k % 3 == 1, "http://fragrantica.com/designers/A.html").otherwise("https://www.google.com/search?q=a")
    u = [payloads.is_perfume_url(url), payloads.is_designer_url(url), payloads.blocked_url(url, payloads.BLOCKED_PARTS, ("youtube.",)), payloads.source_tier(url, {"fragrantica": "main"})]
    return t(spark, d, "pages").select("page_id", *[c.alias(n) for c, n in zip(u, ("perfume", "designer", "blocked", "tier"))])


@query("ranked_urls", """SELECT page_id, url, rank FROM (SELECT page_id, unnest(['https://s.org/p/red-blue', 'https://s.org/p/red', 'https://s.org/p/x']) AS url, unnest([1, 2, 3]::BIGINT[]) AS rank FROM pages)""")
def ranked_urls(spark, d):
    urls = F.array(*[F.lit(f"https://s.org/p/{x}") for x in ("x", "red", "red-blue")])
    rows = t(spark, d, "pages").select("page_id", F.posexplode(urls).alias("pos", "url"))
    return payloads.ranked_urls(rows, "page_id", "url", "pos", F.lit("Red Blue")).select("page_id", "url", "rank")


@query("blob_audit", r"""WITH r AS (SELECT p_partkey AS k, p_size, p_name, p_brand, p_type FROM part)
  SELECT k AS p_partkey, CASE WHEN k % 9 = 0 THEN 'bad_blob' ELSE array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'brand_missing' END, CASE WHEN k % 5 = 0 THEN 'source_url_malformed' END, CASE WHEN k % 7 = 2 THEN 'accord_junk' END, CASE WHEN k % 7 = 1 THEN 'accord_case' END, CASE WHEN k % 7 = 0 THEN 'accords_empty' END,
    CASE WHEN k % 7 IN (1, 2) THEN 'single_accord' END, CASE WHEN k % 7 > 3 THEN 'accords_missing' END, 'family_unknown', CASE WHEN p_type NOT IN ('Parfum', 'Extrait') THEN 'concentration_unexpected' END, 'gender_missing',
    CASE WHEN k % 2 = 0 THEN 'year_string' END, CASE WHEN p_size + 1790 < 1800 THEN 'year_range' END], lambda x: x IS NOT NULL), ',') END AS issues FROM r""")
def blob_audit(spark, d):
    """Stored rows as JSON made of every part; one in nine is no object or broken."""
    k, text = F.col("p_partkey"), lambda name, c: F.concat(F.lit(f'"{name}": "'), c, F.lit('"'))
    accords = F.when(k % 7 == 0, "[]").when(k % 7 == 1, '["woody"]').when(k % 7 == 2, '["Woody", "12%"]').when(k % 7 == 3, '["Woody", "Warm Spicy"]')
    year = (F.col("p_size") + 1790).cast("string")
    fields = F.concat_ws(
        ", ", text("name", F.col("p_name")), F.when(k % 11 == 0, '"brand": " "').when(k % 2 == 0, text("house", F.col("p_brand"))).otherwise(text("brand", F.col("p_brand"))), F.when(k % 5 == 0, '"source_url": "www.x.org/a"'),
        F.concat(F.lit('"accords": '), accords), text("concentration", F.col("p_type")), F.concat(F.lit('"year": '), F.when(k % 2 == 0, F.concat(F.lit('"'), year, F.lit('"'))).otherwise(year)),
    )
    blob = F.when(k % 27 == 0, "[1]").when(k % 9 == 0, F.concat(F.lit("{"), fields)).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    found = audit.with_blob_tags(t(spark, d, "part").select("p_partkey", blob.alias("blob")), "blob", "issues", F.lit("2024-01-31").cast("date"))
    return found.select("p_partkey", F.array_join("issues", ",").alias("issues"))


@query("pyramids", """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
  SELECT p_partkey, 0 AS layer, 1 AS place, w[1] || ' wood' AS note FROM p UNION ALL SELECT p_partkey, 0, 2, 'Oud' FROM p UNION ALL SELECT p_partkey, 1, 1, w[-1] FROM p UNION ALL SELECT p_partkey, 2, 1, 'Tonka' FROM p UNION ALL SELECT p_partkey, 2, 2, 'Leather' FROM p""")
def pyramids(spark, d):
    """Pyramids of every part's words: qualified, plural, synonymous and repeated notes across layers."""
    first, last = F.get(F.split("p_name", " "), F.lit(0)), F.element_at(F.split("p_name", " "), -1)
    note = lambda layer, position, name: F.struct(F.lit(layer).alias("layer"), F.lit(position).alias("position"), name.alias("note"))
    made = F.array(
        note(0, 0, F.concat(first, F.lit(" wood"))), note(0, 1, F.lit("Agarwood (Oud)")), note(1, 0, F.concat(F.lit("Sicilian "), last)), note(1, 1, last), note(1, 2, F.concat(F.upper(last), F.lit(" Absolute™"))),
        note(2, 0, F.lit("Tonka or Oudh")), note(2, 1, F.lit("Leather accord")), note(2, 2, F.lit("Leather")), note(2, 3, F.concat(first, F.lit(" Wood oil"))),
    )
    rows = spread(t(spark, d, "part")).select("p_partkey", F.explode(made).alias("x")).select("p_partkey", "x.*")
    return notes.deduped(rows, "p_partkey", "layer", "position", "note")
