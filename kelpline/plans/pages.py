"""Queries on pages, and on pages made of the tables' rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detail, identity, labels, listing, payloads
from ..sources.tables import spread
from ..sources.tables import table as t

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def kept(made):
        QUERIES[name] = made
        if sql:
            ORACLES[name] = sql
        return made

    return kept


_PLAIN = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("page_links", f"""WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) AS i FROM pages),
  b AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, origin || regexp_replace({_PLAIN.format('href')}, '[?#].*$', '') AS url, trim({_PLAIN.format('title')}) AS title FROM a WHERE trim(href, '/') <> '')
  SELECT page_id, min(pos) AS pos, url, min_by(title, pos) AS title, min_by(title, pos) AS context FROM b GROUP BY page_id, url""")
def page_links(spark, d):
    return listing.directory_links(t(spark, d, "pages"), "page_id", "url", "html", part="/", named=False).select("page_id", "pos", "url", "title", "context")


@query("page_facts", f"""SELECT page_id, trim(regexp_replace({_PLAIN.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) AS title, trim(regexp_replace({_PLAIN.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '\\s+', ' ', 'g')) AS heading,
  '' AS description, '' AS image, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def page_facts(spark, d):
    return detail.page_facts(t(spark, d, "pages"), "page_id", "html")


def _gathered(rows, page: str, piece, before: str, after: str):
    """One page of the pieces of its rows, by p_partkey: at most as many as a page's keys."""
    parts = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("p_partkey", piece.alias("piece")))).alias("p"))
    return parts.select(page, F.concat(F.lit(before), F.array_join(F.transform("p", lambda x: x["piece"]), "\n"), F.lit(after)).alias("html"))


@query("result_cards", """WITH p AS (SELECT p_partkey, p_partkey // 20 AS page, p_partkey % 3 AS k, replace(p_brand, '#', ' ') AS brand, p_name AS name, (p_size + 1960)::VARCHAR AS year, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS title FROM part)
  SELECT page, row_number() OVER (PARTITION BY page ORDER BY p_partkey) AS rank, CASE WHEN k = 2 THEN title ELSE name END AS name, brand, CASE WHEN k = 2 THEN '' ELSE year END AS year, 'https://www.fragrantica.com/perfume/' || replace(brand, ' ', '-') || '/' || replace(name, ' ', '-') || '-' || p_partkey || '.html' AS url FROM p""")
def result_cards(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 20).alias("page"), (F.col("p_partkey") % 3).alias("k"), F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("brand"), F.col("p_name").alias("name"), (F.col("p_size") + 1960).cast("string").alias("year"))
    url = F.concat(F.lit("/perfume/"), F.replace("brand", F.lit(" "), F.lit("-")), F.lit("/"), F.replace("name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey", F.lit(".html?q=1"))
    shown = F.concat(F.lit("<h3>"), "name", F.lit("</h3><p>"), "brand", F.lit("</p><b><span>4.2</span><span class='font-medium'>"), "year", F.lit("</span>"))
    alt = F.concat(F.lit("<img alt='perfume "), "name", F.lit("'><br>"))
    broken = F.lit("<h3>342 votes</h3><p>1999</p></i>")
    title = F.when(F.col("k") == 1, F.concat(F.lit("Link to "), "brand", F.lit(" "), "name", F.lit(" "), "year")).otherwise("")
    card = F.concat(F.lit("<a class='x prefumeHbox' href='"), url, F.lit("' title='"), title, F.lit("'>"), F.when(F.col("k") == 0, shown).when(F.col("k") == 1, alt).otherwise(broken), F.lit("</a>"))
    pages = _gathered(p, "page", card, "<html><div class='ais-Hits'><ul>", "</div><a class='prefumeHbox' href='/perfume/No/No-1.html'><h3>No</h3></a>")
    return listing.result_cards(pages, "page", "html")


@query("third_source_facts", """WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
  SELECT p_partkey, 'https://www.parfumo.com/Perfumes/' || replace(p_brand, '#', '_') || '/' || p_partkey AS url, p_brand AS house, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'Unisex' WHEN 1 THEN 'Feminine' ELSE 'Masculine' END AS gender,
    CASE WHEN p_size % 2 = 0 THEN 'in_production' ELSE 'discontinued' END AS status, (1960 + p_size)::VARCHAR AS year, lower(w[1]) AS accord, p_retailprice::VARCHAR AS rating, p_size::VARCHAR AS rating_count,
    CASE WHEN p_size % 4 > 0 THEN w[1] ELSE '' END AS top, CASE WHEN p_size % 4 > 0 THEN w[-1] ELSE '' END AS base, CASE WHEN p_size % 4 > 0 THEN '' WHEN w[1] = w[-1] THEN w[1] ELSE w[1] || '|' || w[-1] END AS flat FROM p WHERE p_partkey % 10 > 0""")
def third_source_facts(spark, d):
    p = spread(t(spark, d, "part")).withColumn("w", F.split("p_name", " "))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name, brand, size, first, last = F.col("p_name"), F.col("p_brand"), F.col("p_size"), F.get("w", F.lit(0)), F.element_at("w", -1)
    who = F.when(size % 3 == 0, "for women and men").when(size % 3 == 1, "for women").otherwise("for men")
    made = F.when(size % 2 == 0, "It is still in production.").otherwise("It was discontinued.")
    kind = F.when(F.col("p_partkey") % 10 == 0, "Users").otherwise("Perfumes")
    head = text("<html><head><meta property='og:url' content='http://parfumo.com/", kind, "/", F.replace(brand, F.lit("#"), F.lit("_")), "/", F.col("p_partkey").cast("string"), "?x=1'><meta property='og:description' content='", name, " is a perfume ", who, " and was released in ", (size + 1960).cast("string"), ". The scent is ", F.lower(first), ". ", made, "'>")
    crumbs = text('<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"name":"a"},{"name":"b"},{"name":"', brand, '"},{"name":"', name, '"}]}</script><script>if (a<b) {</script>')
    note = lambda x: text("<span class='clickable_note_img'>", x, "</span>")
    notes = text("<div class='notes_list'>", F.when(size % 4 > 0, "<b>Top Notes</b>").otherwise("<b>"), note(first), F.when(size % 4 > 0, "<p>Base Notes</p>").otherwise("<br>"), F.when((size % 4 > 0) | (first != last), note(last)).otherwise(""), "</div>")
    page = text(head, crumbs, "</head><i itemprop=ratingValue> ", F.col("p_retailprice").cast("string"), "</i><meta itemprop='ratingCount' content='", size.cast("string"), "'>", notes)
    return detail.third_source(p.select("p_partkey", page.alias("html")), "p_partkey", "html").select("p_partkey", "url", "house", "name", "gender", "status", "year", "accord", "rating", "rating_count", *[F.array_join(k, "|").alias(k) for k in ("top", "base", "flat")])


@query("second_source_facts", """SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Unisex' WHEN 1 THEN 'Masculine' ELSE 'Feminine' END AS gender, c_name || chr(10) || c_mktsegment AS description, c_custkey % 97 AS pos, c_nationkey AS pos_pct, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 89 END AS neg,
  CASE WHEN c_nationkey % 4 < 3 THEN lower(c_mktsegment) || '|Musk' ELSE '' END AS top, CASE WHEN c_nationkey % 4 < 3 THEN c_name ELSE '' END AS base, CASE WHEN c_nationkey % 4 = 3 THEN c_name || '|' || lower(c_mktsegment) ELSE '' END AS flat FROM customer""")
def second_source_facts(spark, d):
    c = spread(t(spark, d, "customer"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name, segment, nation, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey")
    mark = F.when(nation % 3 == 0, "<i style='color: Dodger Blue'></i><i style='color:hotpink'>").when(nation % 3 == 1, "<i style='color:DodgerBlue'>").otherwise("<i style='color:HotPink'>")
    votes = text("<div class='fragReviews'><a>1 Positive (1%)</a><a>", (key % 97).cast("string"), " Positive (", nation.cast("string"), "%)</a>", F.when(nation % 2 == 0, text("<a>", (key % 89).cast("string"), " Negative (3%)</a>")).otherwise(""), "</div>")
    listed = text("<ul class='fragrancenotes'><li><h3>Head</h3><ul><li>", F.lower(segment), "<li>Musk</ul></li><li><h3>Base notes</h3><ul><li>", name, "</ul></li></ul>")
    stated = text("<div class='fragrancenotes'>Top notes: ", F.lower(segment), ", Musk<br>Base notes: ", name, "</div>")
    headed = text("<section><h3>Notes</h3><p>Top notes: ", F.lower(segment), "; Musk</p><p>Base notes ", name, "</p><p>Latest reviews</p><p>x</p></section>")
    flat = text("<div class='fragrancenotes'>", name, " | ", F.lower(segment), "</div>")
    notes = F.when(nation % 4 == 0, listed).when(nation % 4 == 1, stated).when(nation % 4 == 2, headed).otherwise(flat)
    page = text("<div class='FragHead-inner'><span class='h1_gender'>", mark, "</span></div><div itemprop=description>", name, "<br>", segment, "</div>", votes, notes)
    s = detail.second_source(c.select("c_custkey", page.alias("html")), "c_custkey", "html")
    return s.select("c_custkey", "gender", "description", F.col("votes.pos.n").alias("pos"), F.col("votes.pos.pct").alias("pos_pct"), F.col("votes.neg.n").alias("neg"), *[F.array_join(k, "|").alias(k) for k in ("top", "base", "flat")])


@query("metric_cards", """WITH l AS (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'Weak' WHEN 'N' THEN 'Moderate' ELSE 'Long Lasting' END AS label, sum(l_quantity::BIGINT)::BIGINT AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT l_partkey, sum(n) AS total FROM l GROUP BY 1)
  SELECT l_partkey, 'longevity' AS card, label, round(100.0::DOUBLE * n / total, 2) AS pct, n::VARCHAR AS count, CASE WHEN l_partkey % 2 = 0 THEN 'bars' ELSE 'data' END AS source FROM l JOIN s USING (l_partkey)
  UNION ALL SELECT l_partkey, 'when to wear', CASE l_linestatus WHEN 'O' THEN 'Fall' ELSE 'Day' END, count(*)::DOUBLE % 100, '', 'data' FROM lineitem GROUP BY l_partkey, l_linestatus""")
def metric_cards(spark, d):
    lines = t(spark, d, "lineitem")
    said = F.when(F.col("l_returnflag") == "A", "soft").when(F.col("l_returnflag") == "N", "MODERATE").otherwise("long-lasting")
    votes = lines.groupBy("l_partkey", said.alias("label")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    rows = votes.groupBy("l_partkey").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("v"))  # at most three labels
    pct = lambda x: F.round(F.lit(100.0) * x["n"] / F.col("total"), 2).cast("string")
    bar = lambda x: F.concat(F.lit("<div><span>"), x["label"], F.lit("</span><i>"), x["n"].cast("string"), F.lit("</i><div style='width: "), pct(x), F.lit("%'></div></div>"))
    item = lambda x: F.concat(F.lit('{"label": "'), x["label"], F.lit('", "percent": "'), pct(x), F.lit('%", "votes": '), x["n"].cast("string"), F.lit("}"))
    bars = F.concat(F.lit("<div id='performance'><h4>Longevity</h4>"), F.array_join(F.transform("v", bar), ""), F.lit("</div>"))
    data = F.concat(F.lit('<script>window.__data = {"x": {"longevity": ['), F.array_join(F.transform("v", item), ", "), F.lit("]}};</script>"))
    worn = lines.groupBy("l_partkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") != "O").alias("f"))
    some = lambda c, label: F.when(F.col(c) > 0, F.concat(F.lit(f'"{label}": '), (F.col(c) % 100).cast("string")))
    json = F.concat(F.lit('<script id="__NEXT_DATA__">{"a": [{"season": {'), F.concat_ws(", ", some("o", "autumn"), some("f", "day")), F.lit("}}]}</script>"))
    pages = rows.join(worn, "l_partkey").select("l_partkey", F.concat(json, F.when(F.col("l_partkey") % 2 == 0, bars).otherwise(data)).alias("html"))
    return detail.metric_cards(pages, "l_partkey", "html").select("l_partkey", "card", "label", F.round("pct", 2).alias("pct"), "count", "source")


@query("canonical_labels", """WITH n AS (SELECT *, lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM part), a AS (SELECT DISTINCT p_brand, norm AS alias, upper(p_name) AS label FROM n UNION SELECT DISTINCT p_brand, string_split(norm, ' ')[-1], 'last ' || string_split(norm, ' ')[-1] FROM n),
  t AS (SELECT p_partkey, p_brand, ' ' || lower(trim(regexp_replace(p_type || ', ' || p_name, '[^A-Za-z0-9]+', ' ', 'g'))) || ' x ' AS text FROM part)
  SELECT p_partkey, coalesce(max_by(label, (length(alias), label)), '') AS label FROM t LEFT JOIN a ON a.p_brand = t.p_brand AND contains(text, ' ' || alias || ' ') GROUP BY p_partkey""")
def canonical_labels(spark, d):
    p = spread(t(spark, d, "part"))
    last = F.element_at(F.split(F.lower(F.trim(F.regexp_replace("p_name", "[^A-Za-z0-9]+", " "))), " "), -1)
    names = p.select(F.col("p_brand").alias("card"), F.col("p_name").alias("alias"), F.upper("p_name").alias("label")).unionByName(p.select(F.col("p_brand").alias("card"), last.alias("alias"), F.concat(F.lit("last "), last).alias("label")))
    texts = p.select("p_partkey", "p_brand", F.concat("p_type", F.lit(", "), "p_name", F.lit(" x")).alias("text"))
    return labels.canonical_labels(texts, "p_brand", "text", names, "label").select("p_partkey", "label")


_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www[.]', '')"


@query("page_rules", f"""SELECT page_id, 'https://' || {_HOST} || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS canonical, contains(lower(url), 'casino') OR contains(lower(url), 'ref=') OR contains({_HOST}, 'bets.example') AS blocked,
  CASE WHEN contains({_HOST}, 'example.net') THEN 'primary' WHEN contains({_HOST}, 'blog.') THEN 'editorial' ELSE 'openweb' END AS tier FROM pages""")
def page_rules(spark, d):
    url = F.col("url")
    return t(spark, d, "pages").select("page_id", X.canonical_url(url).alias("canonical"), payloads.blocked_url(url, ("casino", "ref="), ("bets.example",)).alias("blocked"), payloads.source_tier(url, {"example.net": "primary", "blog.": "editorial"}).alias("tier"))


@query("compatible_names", "SELECT c_custkey, c_custkey % 3 > 0 AND c_custkey % 4 < 3 AS same FROM customer")
def compatible_names(spark, d):
    """Every customer's name as a house with a generic or another word at its end, against its own or another's name."""
    k, name = F.col("c_custkey"), F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", " ")
    other = F.when(k % 3 > 0, name).otherwise(F.concat(F.lit("no "), name))
    full = F.concat(name, F.when(k % 4 == 0, "").when(k % 4 == 1, " parfums").when(k % 4 == 2, " beauty paris").otherwise(" rouge"))
    rows, mine = identity.with_brand(spread(t(spark, d, "customer")).select("c_custkey", full.alias("a"), other.alias("b")), "a", "mine")
    rows, theirs = identity.with_brand(rows, "b", "theirs")
    return rows.select("c_custkey", identity.same_brand(mine, theirs).alias("same"))


@query("stripped_names", "SELECT p_partkey, p_name AS name FROM part")
def stripped_names(spark, d):
    """Every part's name with its brand before it, after "by", or not at all."""
    k, brand = F.col("p_partkey") % 3, F.replace("p_brand", F.lit("#"), F.lit(" "))
    full = F.when(k == 0, F.concat_ws(" ", brand, "p_name")).when(k == 1, F.concat_ws(" ", "p_name", F.lit("by"), brand)).otherwise(F.col("p_name"))
    return identity.with_stripped_name(spread(t(spark, d, "part")).select("p_partkey", full.alias("full"), F.col("p_brand").alias("house")), "full", "house", "name").select("p_partkey", "name")
