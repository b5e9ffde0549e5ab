"""Jobs that go through tiers until one has an answer, and what an answer must be to be taken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import computed
from ..sources.tables import forget, settled
from . import identity, resolve


def ladder(jobs: DataFrame, key: str, tiers: dict[str, Callable[[DataFrame], DataFrame]], value: str, order: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """EX7: (key, value, tier) of every job by the first tier that answers it (tier and value null for the others), and how many each tier answered.

    A tier is given only the jobs that are still open, and gives rows (key, value and, if named, order): of several
    for one job that of least order, then value, counts. What is open is written before the next tier reads it; when
    nothing is, no further tier runs. Rows of a tier for jobs that aren't open are ignored; key is one row's.
    """
    left, found, counts = settled(jobs), [], {}
    for name, tier in tiers.items():
        if left.isEmpty():
            counts[name] = 0
            continue
        answers = tier(left).where(F.col(key).isNotNull() & F.col(value).isNotNull())
        best = answers.groupBy(key).agg(F.min(F.struct(*([order] if order else []), value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))
        own = settled(best.join(left.select(key), key, "left_semi").withColumn("tier", F.lit(name)))
        counts[name] = own.count()
        found.append(own)
        if counts[name]:
            rest = settled(left.join(own.select(key), key, "left_anti"))
            forget(left)
            left = rest
    out = left.select(key, F.lit(None).cast("string").alias("tier"))
    for own in found:
        out = out.unionByName(own, allowMissingColumns=True)
    # without an answer of any tier the value has no type of its own
    return (out if found else out.withColumn(value, F.lit(None).cast("string"))).select(key, value, "tier"), counts


def accepted(pairs: DataFrame, job: tuple[str, str, str], candidate: tuple[str, str, str], least: float = resolve.CATALOG) -> DataFrame:
    """Pairs plus accepted: whether a candidate (brand, name, year) is what a job asks for.

    What the job leaves out is the candidate's own; a job without brand and name takes anything. Accepted is an identity
    score of 0.76, or identities that differ in stop words alone, or in words the job has more under an equal year.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    own = computed(pairs, {f"__{s}_{k}": blank(c) for s, columns in (("j", job), ("c", candidate)) for k, c in zip(("brand", "name", "year"), columns, strict=True)})
    own = computed(own, {f"__p_{k}": F.when(F.col(f"__j_{k}") == "", F.col(f"__c_{k}")).otherwise(F.col(f"__j_{k}")) for k in ("brand", "name")})
    own = identity.with_identity_score(own, ("__p_brand", "__p_name", "__j_year"), ("__c_brand", "__c_name", "__c_year"), "__score")
    own = X.with_clean(own, {f"__{s}{k}": F.col(f"__{s}_{k}") for s in "pc" for k in ("brand", "name")})
    sides = [(F.col(f"__{s}brand_n"), F.col(f"__{s}name_n"), F.col(f"__{y}_year")) for s, y in (("p", "j"), ("c", "c"))]
    anything = (F.col("__j_brand") == "") & (F.col("__j_name") == "")
    return own.withColumn("accepted", anything | (F.col("__score") >= least) | identity.subset_identity(*sides)).select(*pairs.columns, "accepted")


def requeued(jobs: DataFrame, requests: DataFrame, key: str, ts: str, facts: tuple[str, ...]) -> DataFrame:
    """MG7: the queue after forced requests: every requested job is pending, new ones are made.

    jobs: key, status, priority, requests, failures, facts. requests: key, priority, ts, facts. The priority is the greatest, the
    requests add up, failures stay as they were; facts are the latest that a request states, else the job's. A request is
    summed in parts before it meets its job, so one job may be asked for any number of times. Priorities are 0 at least.
    """
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(ts, c))).alias(f"__{c}")
    asked = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), F.max(F.greatest(F.coalesce("priority", F.lit(0)), F.lit(0))).alias("__p"), *[last(c) for c in facts])
    met = jobs.join(asked, key, "full")
    new, old = F.col("__n").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.select(
        key, F.when(new, "pending").otherwise(F.col("status")).alias("status"), F.when(new, F.greatest(old("priority"), F.col("__p"))).otherwise(F.col("priority")).alias("priority"),
        (old("requests") + F.coalesce("__n", F.lit(0))).alias("requests"), old("failures").alias("failures"), *[F.coalesce(f"__{c}", c).alias(c) for c in facts],
    )
