"""Repair of misspelt queries: words near a vocabulary's, evidence of suggestions, and what a suggestion is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions.steps import computed

#: Words that name no fragrance.
GENERIC = (
    "fragrance", "fragrances", "perfume", "perfumes", "cologne", "colognes", "scent", "scents", "review", "reviews", "rating", "ratings", "price",
    "prices", "buy", "sale", "sample", "samples", "spray", "official", "site", "page", "result", "results", "men", "women", "unisex", "male", "female",
    "for", "and", "or", "the", "a", "an", "by", "of", "to", "with", "eau", "de", "du", "la", "le", "el", "parfum", "parfums",
    "toilette", "pour", "homme", "femme", "intense", "edt", "edp", "extrait", "absolu", "absolute", "tester", "new", "old",
)
#: Suggestions that are parts of a page, and words that no suggestion has.
NO_SUGGESTIONS = (
    "click here", "here", "learn more", "read more", "show more", "see more", "view more", "load more", "more results", "search", "search results",
    "all results", "results", "images", "image results", "videos", "video results", "news", "maps", "shopping", "web results", "sign in", "login",
    "log in", "cached", "cache", "translate this page", "translated page", "all", "more", "next", "previous", "back", "home", "menu", "official site",
    "website", "page", "result", "description", "reviews", "rating", "ratings", "notes", "accords", "ingredients", "longevity", "sillage", "projection",
    "price", "prices",
)
NO_WORDS = (
    "search", "searched", "searches", "result", "results", "image", "images", "video", "videos", "news", "map", "maps", "shopping", "shop", "shops",
    "web", "website", "page", "pages", "login", "signin", "sign", "cached", "cache", "translate", "translation", "translated", "preview", "snippet",
    "redirect", "url", "link", "links", "wikipedia", "youtube", "reddit", "tiktok", "facebook", "instagram", "pinterest", "twitter", "x", "threads",
    "quora", "medium", "amazon", "walmart", "ebay", "etsy", "sephora", "ulta", "macys", "macy", "nordstrom", "fragrancenet", "fragrancex",
    "microperfumes", "scentbird", "scentbox", "luckyscent", "jomashop", "buy", "sale", "sell", "sold", "discount", "discounts", "coupon", "coupons",
    "deal", "deals", "offer", "offers", "price", "prices", "pricing", "cheap", "cheapest", "shipping", "delivery", "cart", "description",
    "descriptions", "overview", "summary", "details", "information", "info", "profile", "profiles", "article", "articles", "blog", "blogs", "guide",
    "guides", "review", "reviews", "rating", "ratings", "rated", "rank", "ranking", "rankings", "score", "scores", "vote", "votes", "notes", "accords",
    "ingredients", "pyramid", "longevity", "sillage", "projection", "season", "seasons", "weather", "occasion", "occasions", "dupe", "dupes", "clone",
    "clones", "alternative", "alternatives", "similar", "comparison", "compare", "versus", "vs", "all", "more", "next", "previous", "back", "home", "menu",
)
QUESTION = r"(?i)\b(?:does|do|did|is|are|was|were|can|should|would|could|what|which|why|how|where|when)\b|\bsmell(?:s|ing)?\s+(?:good|bad|like)\b"
#: Words of a query that are no part of its identity, and signs that part it.
KINDS, SIGNS = r"(?i)\b(?:fragrances?|perfumes?|colognes?|scents?)\b", "[?!.:;|•·]+"
#: What a word's match is worth by its kind, the least ratio and share of letters, and least scores of a match, a weak one, a kept word, a repair and one by titles alone.
SWAPPED, BEGINS, BEGINS_MORE, HOLDS, EDITED, FOLLOWS = 0.86, 0.88, 0.10, 0.82, 0.74, 0.76
LEAST_RATIO, LEAST_SHARE, DIRECT, WEAK, KEPT, CONFIDENT, BY_TITLE = 0.55, 0.75, 0.74, 0.62, 0.90, 0.86, 0.96
#: Most words of a suggestion, of one that an address proves, and hosts of such addresses.
WORDS, PROVEN_WORDS, HOSTS = 8, 12, ("fragrantica.", "basenotes.", "parfumo.")
#: Letters of a word that are compared, and rows of one candidate that are folded together.
LETTERS, SLICE = 64, 4096


def normalized_query(cleaned: Column) -> Column:
    """A cleaned query without words for its kind and signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(cleaned, KINDS, " "), SIGNS, " "), r"(?U)\s+", " "))


def meaningful(identity: Column) -> Column:
    """The words of a normalized query that name something, in order."""
    return F.filter(F.split(identity, " "), lambda w: (w != "") & ~w.isin(*GENERIC))


def subsequence_ratio(short: Column, long: Column) -> Column:
    """SF18: share of a text's letters that are met in another in one walk from left to right; letters that are not met are passed over."""

    def step(s: Column, ch: Column) -> Column:
        at = F.call_function("locate", ch, long, s["at"])
        return F.when(at > 0, F.struct((at + 1).alias("at"), (s["hit"] + 1).alias("hit"))).otherwise(s)

    walked = F.aggregate(F.split(short, ""), F.struct(F.lit(1).alias("at"), F.lit(0).alias("hit")), step)
    return F.when((short == "") | (long == ""), 0.0).otherwise(walked["hit"] / F.greatest(F.length(short), F.lit(1)))


def token_score(a: Column, b: Column) -> Column:
    """SF19: 0 to 1, how well a word of a suggestion answers one of a query: equal, neighbours swapped, one begins or holds the other, few edits, or its letters in order."""
    n, m = F.length(a), F.length(b)
    small, large = F.when(n <= m, a).otherwise(b), F.when(n <= m, b).otherwise(a)
    least, most = F.least(n, m), F.greatest(n, m)
    limit = F.when((least >= 4) & (most >= 7), 3).when(least >= 5, 2).otherwise(1)
    dist = S.edit_distance(a, b, 3)
    ratio = 1.0 - dist / most
    score = F.when((n == 0) | (m == 0), 0.0).when(a == b, 1.0).when(least < 3, 0.0).when(S.one_swap(a, b), SWAPPED)
    score = score.when(F.startswith(large, small), BEGINS + BEGINS_MORE * (least / most)).when(F.contains(large, small) & (least >= 4), HOLDS)
    score = score.when((dist <= limit) & (ratio >= LEAST_RATIO), F.greatest(F.lit(EDITED), ratio))
    follows = (least >= 4) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (subsequence_ratio(small, large) >= LEAST_SHARE)
    return score.when(follows, FOLLOWS).otherwise(0.0)


def _shortened(word: Column) -> Column:
    """A word with each of its letters left out in turn."""
    n = F.length(word)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))).otherwise(F.array().cast("array<string>"))


def deletions(word: Column, distance: int) -> Column:
    """A word's distinct forms with up to `distance` letters left out, itself first."""
    forms = last = F.array(word)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, _shortened)))
        forms = F.array_distinct(F.concat(forms, last))
    return forms


def near_words(asked: DataFrame, vocabulary: DataFrame, word: str, known: str, distance: int = 2) -> DataFrame:
    """SF19: (word, known, distance): all pairs of distinct words, one of each side, within a Levenshtein distance.

    An index of deletions: two words within a distance share a form from which each has lost at most that many letters.
    Forms are keyed by their hash and length, met in a join, and met pairs are measured; so the work grows with the words and the
    pairs that are near, for any number of queries. Words are compared by their first 64 letters. Nulls take no part.
    """
    cut = lambda c: F.substring(c, 1, LETTERS)

    def indexed(rows: DataFrame, name: str, out: str) -> DataFrame:
        words = rows.where(F.col(name).isNotNull()).select(cut(F.col(name)).alias(out)).distinct()
        return words.select(out, F.explode(deletions(F.col(out), distance)).alias("__form")).select(out, F.xxhash64("__form").alias("__key"), F.length("__form").alias("__n"))

    met = indexed(asked, word, "__a").join(indexed(vocabulary, known, "__b"), ["__key", "__n"]).where(F.abs(F.length("__a") - F.length("__b")) <= distance)
    measured = met.select("__a", "__b").distinct().withColumn("distance", F.levenshtein("__a", "__b", distance)).where("distance between 0 and " + str(distance))
    full = lambda rows, name, out: rows.where(F.col(name).isNotNull()).select(F.col(name).alias(name), cut(F.col(name)).alias(out)).distinct()
    return measured.join(full(asked, word, "__a"), "__a").join(full(vocabulary, known, "__b"), "__b").select(word, known, "distance")


def repaired_words(asked: DataFrame, vocabulary: DataFrame, word: str, known: str, often: str, distance: int = 2) -> DataFrame:
    """SF22: (word, known, score) for each word that the vocabulary lacks: the known word of best token_score() of at least 0.74, of equal ones the more frequent, then the smaller.

    vocabulary has a row a known word (the most frequent counts where it has several); partial maxima before the shuffle.
    """
    counts = vocabulary.groupBy(known).agg(F.max(often).alias("__often"))
    strange = asked.select(word).where(F.col(word).isNotNull()).distinct().join(counts.select(F.col(known).alias(word)), word, "left_anti")
    pairs = near_words(strange, counts, word, known, distance).withColumn("__score", token_score(F.col(word), F.col(known))).where(F.col("__score") >= DIRECT)
    return pairs.join(counts, known).groupBy(word).agg(F.min_by(F.struct(F.col(known).alias("k"), F.col("__score").alias("s")), F.struct(-F.col("__score"), -F.col("__often"), F.col(known))).alias("b")).select(word, F.col("b.k").alias(known), F.col("b.s").alias("score"))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def _preferred(now: Column, new: Column, proven: Column) -> Column:
    """The text that a record goes on with: one that an address proves and is as full, one with capitals, or a shorter one of two words or more."""
    count = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    full = proven & (count(new) <= PROVEN_WORDS) & (_letters(new) >= _letters(now)) & (F.length(new) <= F.greatest(F.length(now) + 12, F.length(now) * 2))
    cased = (now == F.lower(now)) & (new != F.lower(new))
    shorter = (count(new) >= 2) & (count(new) <= count(now)) & (F.length(new) <= F.length(now))
    return F.when((now == "") | full | cased | shorter, new).otherwise(now)


def evidence(rows: DataFrame, query: str, candidate: str, pos: str, source: str, proven: str, title: str, direct: str, bonus: str) -> DataFrame:
    """AG29: one record for each query and candidate: query, key, text, occurrences, proven, title, direct, bonus, domains.

    Candidates are keyed by what they normalize to; blank ones, parts of pages, questions and those of too many words are no
    evidence. Counts, sums and distinct domains are summed in parts before they meet. The text is chosen among a key's
    spellings in the order of pos, one by one: slices of at most 4096 rows say which spelling each spelling would become, and
    the slices of a key follow each other, so a key of any number of rows is no task's alone; its spellings are few.
    Domains of addresses count, "www." apart, from known hosts or of direct suggestions. pos has one value a row of a query.
    """
    own = rows.select(query, F.col(pos).cast("long").alias("__pos"), F.col(candidate).cast("string").alias("__raw"), F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), r"^www\.", "").alias("__host"), *[F.coalesce(c, F.lit(False)).alias(f"__{k}") for k, c in (("proven", proven), ("title", title), ("direct", direct))], F.coalesce(F.col(bonus).cast("double"), F.lit(0.0)).alias("__bonus"))
    own = X.with_clean(own, {"__c": F.col("__raw")})
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("__c", KINDS, " "), SIGNS, " "), r"\s+[-–—/]\s*$", ""), r"(?U)\s+", " "))
    own = computed(own, {"__text": F.regexp_replace(text, r"^[ \-–—/]+|[ \-–—/]+$", "")})
    own = X.with_clean(own.drop("__c", "__c_n"), {"__t": F.col("__text")})
    parts = F.split("__t_n", " ")
    own = computed(own, {"key": F.col("__t_n"), "__words": parts})
    bad = F.col("key").isin("", *NO_SUGGESTIONS) | F.exists("__words", lambda w: w.isin(*NO_WORDS)) | F.col("__text").rlike(QUESTION) | ((F.size("__words") == 1) & F.col("key").isin(*GENERIC))
    own = own.where(~bad & (F.size("__words") <= F.when(F.col("__proven"), PROVEN_WORDS).otherwise(WORDS)))
    counted = (F.col("__host") != "") & ((F.col("__proven") & F.col("__host").rlike("|".join(h.replace(".", r"\.") for h in HOSTS))) | F.col("__direct"))
    sums = own.groupBy(query, "key").agg(F.count("*").alias("occurrences"), *[F.count_if(F.col(f"__{k}")).alias(k) for k in ("proven", "title", "direct")], F.sum("__bonus").alias("bonus"), F.collect_set(F.when(counted, F.col("__host"))).alias("domains"), F.collect_set("__text").alias("__spelt"))
    # each slice turns any spelling that came before it into the one that goes on
    spelt = sums.select(query, "key", "__spelt")
    slices = own.groupBy(query, "key", F.floor(F.col("__pos") / SLICE).alias("__slice")).agg(F.array_sort(F.collect_list(F.struct("__pos", "__text", "__proven"))).alias("__rows"))  # SLICE rows at most
    turned = slices.join(spelt, [query, "key"]).select(query, "key", "__slice", F.map_from_arrays(F.concat(F.array(F.lit("")), "__spelt"), F.transform(F.concat(F.array(F.lit("")), "__spelt"), lambda t: F.aggregate("__rows", t, lambda now, r: _preferred(now, r["__text"], r["__proven"])))).alias("__to"))
    texts = turned.groupBy(query, "key").agg(F.array_sort(F.collect_list(F.struct("__slice", F.map_entries("__to").alias("to")))).alias("__all"))
    texts = texts.select(query, "key", F.aggregate("__all", F.lit(""), lambda now, s: F.get(F.filter(s["to"], lambda kv: kv["key"] == now), F.lit(0))["value"]).alias("text"))
    return sums.drop("__spelt").join(texts, [query, "key"]).select(query, "key", "text", "occurrences", "proven", "title", "direct", "bonus", "domains")


def with_record_score(records: DataFrame, query: str, out: str = "score") -> DataFrame:
    """SF20: rows of evidence() plus what each is worth as the repair of its query; 0 where it may not be.

    A record that no address proves may not only reorder a query's words, must answer each of them and repair or add one, and
    keeps the first and a short last word. Its worth is the mean of its words' token_score() and what its evidence adds.
    """
    own = X.with_clean(records.withColumn("__n", F.size("domains")), {"__q": F.col(query), "__t": F.col("text")})
    own = own.withColumns({"__qq": normalized_query(F.col("__q")), "__tt": normalized_query(F.col("__t"))}).drop("__q", "__t", "__q_n", "__t_n")
    own = X.with_clean(own, {"__q": F.col("__qq"), "__t": F.col("__tt")})
    own = computed(own, {"__a": meaningful(F.col("__q_n")), "__b": meaningful(F.col("__t_n")), "__words": F.split("__t_n", " ")})
    own = computed(own, {"__m": F.transform("__a", lambda a: F.transform("__b", lambda b: token_score(a, b)))})
    own = computed(own, {"__best": F.transform("__m", lambda row: F.coalesce(F.array_max(row), F.lit(0.0)))})
    own = computed(own, {"__taken": F.transform("__m", lambda row: F.when(F.array_max(row) > 0, F.get("__b", F.array_position(row, F.array_max(row)).cast("int") - 1)).otherwise(""))})
    na, nb, proven = F.size("__a"), F.size("__b"), F.col("proven") > 0
    some = (na > 0) & (nb > 0)
    reordered = some & (F.array_sort("__a") == F.array_sort("__b")) & (F.col("__q_n") != F.col("__t_n"))
    above = lambda row, least: F.coalesce(F.exists(F.get("__m", row), lambda s: s >= least), F.lit(False))
    replaced = F.exists(F.sequence(F.lit(0), F.greatest(na - 1, F.lit(0))), lambda i: F.exists(F.sequence(F.lit(0), F.greatest(nb - 1, F.lit(0))), lambda j: (F.get("__a", i) != F.get("__b", j)) & (F.get(F.get("__m", i), j) >= DIRECT)))
    adds = some & ~reordered & F.forall("__best", lambda s: s >= DIRECT) & ((F.size(F.array_except("__b", "__a")) > 0) | replaced)
    last = F.get("__a", na - 1)
    short_last = (na >= 3) & (nb > 0) & ((F.length(last) <= 2) | ((na >= 4) & (F.length(last) <= 3)))
    allowed = proven | (~reordered & adds & ((na < 3) | above(F.lit(0), KEPT)) & (~short_last | above(na - 1, KEPT)))
    fits = (F.col("__q_n") != "") & (F.col("__t_n") != "") & (F.col("__q_n") != F.col("__t_n")) & ~F.col("__t_n").isin(*NO_SUGGESTIONS) & (F.length("__t_n") >= 3) & (F.size("__words") <= F.when(proven, PROVEN_WORDS).otherwise(WORDS)) & ~F.exists("__words", lambda w: w.isin(*NO_WORDS)) & some
    first, second = F.get("__a", F.lit(0)), F.get("__a", F.lit(1))
    others = lambda fits: F.exists(F.sequence(F.lit(0), F.greatest(nb - 1, F.lit(0))), lambda j: (F.get("__b", j) != first) & fits(F.get("__b", j), F.get(F.get("__m", F.lit(1)), j)))
    bare = lambda c: F.regexp_replace(c, "[aeiouy]+", "")
    sounds = lambda b, _: (F.length(second) >= 4) & (F.length(b) >= 5) & (((bare(second) != "") & F.startswith(bare(b), F.substring(bare(second), 1, 3))) | ((subsequence_ratio(second, b) >= 0.70) & (F.substring(second, 1, 1) == F.substring(b, 1, 1))))
    rescued = (na == 2) & (nb >= 2) & above(F.lit(0), 0.90) & (others(lambda _, s: s >= 0.70) | others(sounds))
    own = computed(own, {"__may": allowed & fits, "__rescued": F.coalesce(rescued, F.lit(False)), "__mean": F.try_divide(F.aggregate("__best", F.lit(0.0), lambda s, x: s + x), na), "__strong": F.size(F.filter("__best", lambda s: s >= DIRECT)), "__weak": F.size(F.filter("__best", lambda s: s < WEAK))})
    one = F.when((F.get("__best", F.lit(0)) < DIRECT) | ((F.get("__taken", F.lit(0)) == first) & (nb > 1)), 0.0).otherwise(F.get("__best", F.lit(0)))
    base = F.when(~F.col("__may"), 0.0).when(na == 1, one).when(F.col("__rescued"), F.greatest(F.lit(0.78), F.col("__mean"))).when(F.col("__strong") < 2, 0.0)
    base = base.when(proven & (na >= 3) & (F.col("__weak") <= 1), F.greatest(F.lit(0.76), F.col("__mean"))).when(F.col("__weak") > 0, 0.0).otherwise(F.col("__mean"))
    equal = F.aggregate(F.zip_with("__a", "__taken", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    fuzzy = F.aggregate(F.zip_with(F.zip_with("__a", "__taken", lambda a, b: a != b), "__best", lambda d, s: (d & (s >= DIRECT)).cast("int")), F.lit(0), lambda s, x: s + x)
    own = computed(own, {"__base": base, "__equal": equal, "__fuzzy": fuzzy})
    up_to = lambda most, c: F.least(F.lit(most), c)
    adding = [
        F.col("bonus"), F.when(proven, up_to(0.30, 0.20 + 0.04 * F.least(F.col("proven") - 1, F.lit(3)))), F.when(F.col("__n") >= 2, 0.18).when((F.col("__n") == 1) & proven, 0.07),
        F.when(F.col("occurrences") >= 2, up_to(0.12, 0.04 * (F.col("occurrences") - 1))), F.when(F.col("direct") > 0, up_to(0.12, 0.08 + 0.02 * F.least(F.col("direct") - 1, F.lit(2)))),
        F.when((F.col("title") > 0) & ~proven, up_to(0.04, 0.02 * F.col("title"))), F.when(F.col("__equal") > 0, up_to(0.08, 0.03 * F.col("__equal"))), F.when(F.col("__fuzzy") > 0, up_to(0.08, 0.03 * F.col("__fuzzy"))),
    ]
    total = F.col("__base")
    for more in adding:
        total = total + F.coalesce(more, F.lit(0.0))
    return computed(own, {out: F.when(F.col("__base") > 0, total).otherwise(0.0)}).select(*records.columns, out)


def suggestions(records: DataFrame, query: str, least: float = CONFIDENT) -> DataFrame:
    """SF20, SF22, HX8: (query, suggestion, score): each query's record of best score of at least `least` (0.96 by titles alone), ties by its key."""
    scored = with_record_score(records, query, "__score")
    needed = F.when((F.col("title") > 0) & (F.col("proven") == 0) & (F.col("direct") == 0), F.greatest(F.lit(least), F.lit(BY_TITLE))).otherwise(F.lit(least))
    best = scored.where((F.col("__score") > 0) & (F.col("__score") >= needed)).groupBy(query).agg(F.min_by(F.struct("text", "__score"), F.struct(-F.col("__score"), F.col("key"))).alias("b"))
    return best.select(query, normalized_query(F.col("b.text")).alias("suggestion"), F.col("b.__score").alias("score"))


def anchor_query(identity: Column) -> Column:
    """The part of a normalized query of three words or more that is asked instead: its last two where the last is short, all but the
    first where both ends are short, else the run of three or two longer words that ranks first; empty without one."""
    words = meaningful(identity)
    n = F.size(words)
    at = lambda i: F.get(words, i)
    join = lambda i, k: F.array_join(F.slice(words, i + 1, k), " ")

    def runs(k: int) -> Column:
        places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), F.slice(words, i + 1, k).alias("w"))), lambda x: F.forall(x["w"], lambda t: F.length(t) >= 3))

    def ranked(x: Column, k: int) -> Column:
        longer = lambda least: F.size(F.filter(x["w"], lambda t: F.length(t) >= least))
        total = F.aggregate(x["w"], F.lit(0), lambda s, t: s + F.length(t))
        return F.struct((x["i"] == 0).cast("int").alias("first"), (-(x["i"] + k == n).cast("int")).alias("tail"), F.lit(k).alias("width"), longer(5).alias("strong"), longer(4).alias("medium"), total.alias("total"), (-x["i"]).alias("o"), F.array_join(x["w"], " ").alias("text"))

    several = F.concat(F.when(n >= 4, F.transform(runs(3), lambda x: ranked(x, 3))).otherwise(F.transform(F.slice(runs(3), 1, 0), lambda x: ranked(x, 3))), F.transform(runs(2), lambda x: ranked(x, 2)))
    best = F.array_max(F.filter(several, lambda x: x["text"] != identity))["text"]
    tail, inner = join(n - 2, F.lit(2)), join(F.lit(1), F.greatest(n - 1, F.lit(0)))
    made = F.when(n < 3, "").when((F.length(at(n - 1)) <= 2) & (F.length(at(n - 2)) >= 3) & (tail != identity), tail)
    return made.when((n >= 4) & (F.length(at(F.lit(0))) <= 3) & (F.length(at(n - 1)) <= 3) & (inner != identity), inner).otherwise(F.coalesce(best, F.lit("")))
