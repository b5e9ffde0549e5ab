"""Quality rules and robust multivariate outliers, in DataFrame functions alone.

Every text gives exact counts (Python-free). Their transformed vectors are judged, per language and source, by a
minimum covariance determinant estimate: from several starts, concentration steps keep the three quarters of a
group that lie nearest by Mahalanobis distance and estimate mean and covariance from them again; of the starts
the one of least determinant is concentrated further. The estimate is scaled to what a normal law has at its
core's radius, and shrunk towards its language's by a weight of some documents, so that a group of any size
has one. A document is rejected where its distance is beyond what a normal law would give once in a thousand;
every statistic also has the noise of a count in a text of its size, so one repeated line among five weighs
less than ten among fifty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, join_small, settled, table

#: Share of a group that the estimate rests on, concentration steps of every start, and further ones of the best.
CORE, FIRST_STEPS, LAST_STEPS = 0.75, 2, 3
#: Quantiles of the chi-squared law with 5 degrees of freedom (fixed values): at CORE, and at 0.999.
CHI2_CORE, CHI2_CUT = 6.6257, 20.5150
#: Documents that a language's estimate counts for beside a group's own.
SHARED = 20
#: Spread between documents that each transformed statistic is granted at least: a tenth of the length, a
#: twentieth of the word length, a quarter percent (0.05 squared) for shares. A document's noise comes on top.
FLOOR = (0.10, 0.05, 0.05, 0.05, 0.05)
#: Words that one chance repeat of two windows covers.
REPEAT = 6
#: Steps of a distance's logarithm in the histogram that finds the core; its last step counts by the share that the core still needs.
STEPS = 32
DIMS = len(FLOOR)
SPACES = "\t\n\x0b\f\r"
KEYS = ["g_lang", "g_source"]
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = F.transform(F.array(placed), lambda a: F.filter(a, lambda x, k: (F.get(a, k - 1)["h"] == x["h"]) | (F.get(a, k + 1)["h"] == x["h"])))[0]
        ordered = F.sort_array(F.transform(starts, lambda x: x["i"]))
        steps = F.transform(F.array(ordered), lambda a: F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))))[0]
        return F.aggregate(steps, F.lit(0), lambda t, x: t + x)

    # most texts repeat no window: a hash set tells, and only the others are sorted
    return F.transform(F.array(windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))[0]


def _stats(rows: DataFrame, text: Column) -> DataFrame:
    """rows plus the exact counts of a text (null: no words)."""
    rows = rows.withColumn("__t", F.coalesce(text.cast("string"), F.lit("")))
    rows = rows.withColumn("__w", F.array_remove(F.split(F.translate("__t", SPACES, " " * len(SPACES)), " "), ""))
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: F.translate(x, SPACES + " ", "") != "")
    rows = rows.withColumn("__l", lines)
    return rows.select(
        *[c for c in rows.columns if c not in ("__t", "__w", "__l")],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES + " ", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__w")).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("__n_lines"),
    )


def _vector(rows: DataFrame) -> DataFrame:
    """rows plus x0 ... x4: logarithms of length and word length, roots of the shares; their noise e0 ... e4; base_failed.

    The root of a count has a deviation of a half whatever the count; words have lengths that deviate by half their mean.
    """
    size = lambda whole: F.greatest(F.col(whole), F.lit(1)).cast("double")
    words, chars, lines = size("n_words"), size("word_chars"), size("__n_lines")
    xs = (F.log1p(F.col("n_words").cast("double")), F.log1p(F.col("word_chars") / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words))
    es = (1 / F.sqrt(words), 0.5 / F.sqrt(words), 0.5 / F.sqrt(chars), 0.5 / F.sqrt(lines), 0.5 * F.sqrt(REPEAT / words))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumns({**{f"x{i}": x for i, x in enumerate(xs)}, **{f"e{i}": e for i, e in enumerate(es)}, "base_failed": failed})


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _factors(est: DataFrame) -> DataFrame:
    """est (m0 ..., v_ij) plus the Cholesky factor l_ij, each pivot at least its floor, and the logarithm of its determinant."""
    for i, j in _pairs():
        value = F.col(f"v{i}{j}") - _sum([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)])
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOOR[i] ** 2))) if i == j else value / F.col(f"l{j}{j}"))
    return est.withColumn("log_det", _sum([2 * F.log(f"l{i}{i}") for i in range(DIMS)]))


def _moments(weight: Column, name: str) -> list[Column]:
    """Weighted sums that give a mean and a covariance."""
    products = [F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"{name}s{i}{j}") for i, j in _pairs()]
    return [F.sum(weight).alias(f"{name}w"), *[F.sum(weight * F.col(f"x{i}")).alias(f"{name}t{i}") for i in range(DIMS)], *products]


def _estimated(name: str = "") -> list[Column]:
    """m and v from _moments(); those of nothing are null."""
    mean = [F.try_divide(f"{name}t{i}", f"{name}w") for i in range(DIMS)]
    return [*[m.alias(f"m{i}") for i, m in enumerate(mean)], *[(F.try_divide(f"{name}s{i}{j}", f"{name}w") - mean[i] * mean[j]).alias(f"v{i}{j}") for i, j in _pairs()]]


def _distances(rows: DataFrame, factors: DataFrame, noise: bool = False) -> DataFrame:
    """rows, once for each of their group's estimates, plus their squared Mahalanobis distance d2; noise widens each pivot by the document's."""
    rows = join_small(rows, factors.drop("log_det", *[f"v{i}{j}" for i, j in _pairs()]), KEYS)
    for i in range(DIMS):
        rest = _sum([F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)])
        pivot = F.sqrt(F.col(f"l{i}{i}") * F.col(f"l{i}{i}") + F.col(f"e{i}") * F.col(f"e{i}")) if noise else F.col(f"l{i}{i}")
        rows = rows.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - rest) / pivot)
    rows = rows.withColumn("d2", _sum([F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)]))
    return rows.drop(*[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in _pairs()], *[f"y{i}" for i in range(DIMS)])


def _step_of(d2: Column) -> Column:
    return F.floor(STEPS * F.log(d2 + 1e-6)).cast("int")


def _cores(far: DataFrame) -> DataFrame:
    """For each estimate the histogram step `edge` that closes its core and the share of it that is in: only counts of steps are moved."""
    counts = far.groupBy(*KEYS, "start", _step_of(F.col("d2")).alias("b")).agg(F.count("*").alias("n"))
    steps = counts.groupBy(*KEYS, "start").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("b", "n"))).alias("h"))  # some hundred steps at most
    core = F.ceil(CORE * F.col("n"))
    state = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("int").alias("b"), F.lit(0.0).alias("share")), lambda a, x: F.when(a["s"] < core, F.struct((a["s"] + x["n"]).alias("s"), x["b"].alias("b"), F.least(F.lit(1.0), (core - a["s"]) / x["n"]).alias("share"))).otherwise(a))
    return steps.select(*KEYS, "start", "n", state.alias("z")).select(*KEYS, "start", "n", F.col("z.b").alias("edge"), F.col("z.share").alias("share"))


def _concentrated(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """The estimates from the cores of others: one concentration step, settled."""
    far = _distances(rows, factors)
    near = join_small(far, held(_cores(far)), [*KEYS, "start"], "inner")
    b = _step_of(F.col("d2"))
    weight = F.when(b < F.col("edge"), 1.0).when(b == F.col("edge"), F.col("share")).otherwise(0.0)
    sums = near.withColumn("weight", weight).where("weight > 0").groupBy(*KEYS, "start").agg(*_moments(F.col("weight"), ""))
    return settled(_factors(sums.select(*KEYS, "start", *_estimated())))


def _grouped(rows: DataFrame) -> DataFrame:
    """rows plus g_lang and g_source; nulls are not the empty name."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return rows.withColumns({"g_lang": named("lang"), "g_source": named("source")})


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates of every group: medians with quartiles, all rows, and those between the outer tenths of every statistic."""
    marks = [0.1, 0.25, 0.5, 0.75, 0.9]
    quantiles = held(rows.groupBy(*KEYS).agg(*[F.percentile_approx(f"x{i}", marks, 1000).alias(f"q{i}") for i in range(DIMS)]))
    inner = reduce(lambda a, b: a & b, [F.col(f"x{i}").between(F.col(f"q{i}")[0], F.col(f"q{i}")[4]) for i in range(DIMS)])
    sums = held(join_small(rows, quantiles, KEYS).groupBy(*KEYS).agg(*_moments(F.lit(1.0), "a"), *_moments(inner.cast("double"), "b")))
    # a normal law has its quartiles 1.349 standard deviations apart
    spread = [F.pow((F.col(f"q{i}")[3] - F.col(f"q{i}")[1]) / 1.349, 2).alias(f"v{i}{j}") if i == j else F.lit(0.0).alias(f"v{i}{j}") for i, j in _pairs()]
    found = quantiles.select(*KEYS, F.lit(0).alias("start"), *[F.col(f"q{i}")[2].alias(f"m{i}") for i in range(DIMS)], *spread)
    for k, name in enumerate("ab", 1):
        found = found.unionByName(sums.where(F.col(f"{name}w") > 0).select(*KEYS, F.lit(k).alias("start"), *_estimated(name)))
    return settled(_factors(found))


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """Every group's estimate (m, v, l, log_det) of least determinant, its size n and its width: what its core's radius is of a normal law's.

    rows (g_lang, g_source, x0 ...) are read twice a step, so they should be settled.
    """
    factors = _starts(rows)
    for _ in range(FIRST_STEPS):
        factors = _concentrated(rows, factors)
    best = factors.groupBy(*KEYS).agg(F.min(F.struct("log_det", "start")).alias("best")).select(*KEYS, F.col("best.start").alias("start"))
    factors = settled(factors.join(F.broadcast(best), [*KEYS, "start"], "left_semi"))  # one row a group, as factors has
    for _ in range(LAST_STEPS):
        factors = _concentrated(rows, factors)
    cores = _cores(_distances(rows, factors)).select(*KEYS, "n", F.greatest(F.lit(1.0), F.exp((F.col("edge") + 1.0) / STEPS) / CHI2_CORE).alias("wide"))
    return settled(factors.join(cores, KEYS))


def estimate(rows: DataFrame) -> DataFrame:
    """Every group's centre and Cholesky factor: its minimum covariance determinant, shrunk towards that of its language.

    A language's covariance is the mean of its groups' and of what their centres differ by.
    """
    own = minimum_determinant(rows)
    scaled = own.select(*KEYS, "n", *[f"m{i}" for i in range(DIMS)], *[(F.col(f"v{i}{j}") * F.col("wide")).alias(f"v{i}{j}") for i, j in _pairs()])
    mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    second = [mean(F.col(f"v{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"z{i}{j}") for i, j in _pairs()]
    whole = scaled.groupBy("g_lang").agg(*[mean(F.col(f"m{i}")).alias(f"c{i}") for i in range(DIMS)], *second)
    joined = join_small(scaled, held(whole), ["g_lang"])
    mixed = lambda a, b: (F.col("n") * a + SHARED * b) / (F.col("n") + SHARED)
    centre = [mixed(F.col(f"m{i}"), F.col(f"c{i}")).alias(f"m{i}") for i in range(DIMS)]
    return settled(_factors(joined.select(*KEYS, *centre, *[mixed(F.col(f"v{i}{j}"), F.col(f"z{i}{j}") - F.col(f"c{i}") * F.col(f"c{j}")).alias(f"v{i}{j}") for i, j in _pairs()])))


def _judged(rows: DataFrame, factors: DataFrame) -> DataFrame:
    rows = _distances(_grouped(rows), factors, noise=True).withColumn("distance", F.sqrt("d2"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CHI2_CUT))


def _placed(stats: DataFrame) -> DataFrame:
    """What the estimate reads."""
    return _grouped(stats).select(*KEYS, *[f"x{i}" for i in range(DIMS)])


def _measured(docs: DataFrame, *kept: Column) -> DataFrame:
    rows = docs.select(*kept, F.col("lang"), F.col("source"), F.col("text").alias("__text"))
    return _vector(_stats(rows, F.col("__text")).drop("__text")).drop("__n_lines")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the exact counts, base_failed, kept and distance for every document.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept is false then,
    else whether the robust distance is within the cut. Null or empty texts have no words and fail; null
    languages and sources are groups of their own; a group of few documents is judged mostly by its language;
    repeated rows count each; an empty table gives no rows; columns other than doc_id, text, lang and source
    are ignored. Groups meet in partial sums only.
    """
    stats = settled(_measured(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return _judged(stats, estimate(_placed(stats))).select("doc_id", *STATS, "base_failed", "kept", "distance")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with their own columns.

    They are written once beside their counts, so nothing is counted twice and the estimate reads counts alone.
    """
    rows = settled(_measured(docs, F.struct(*[docs[c] for c in docs.columns]).alias("__row")))
    return _judged(rows, estimate(_placed(rows))).where("kept").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
