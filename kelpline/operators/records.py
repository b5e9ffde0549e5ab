"""Reading, keying and repairing stored records as filters, joins and aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.steps import unused
from . import identity as I

#: Hours after which a record is stale, most rows of a page and of a list of commands, and a lease in seconds.
TTL_HOURS, PAGE, COMMANDS, LEASE = 168, 500, 100, 900
#: Lines of a house that no source has, and how their names are told.
NO_SOURCE = (
    ("bath and body works", "any", ""),
    ("bath body works", "any", ""),
    ("victorias secret", "prefix", "pink"),
    ("calvin klein", "contains", "body mist"),
)


def page_after(rows: DataFrame, key: str, after, size: int = 200) -> DataFrame:
    """SRC2: the next rows by key after one that was seen, 1 to 500 of them: a filter that reaches the scan and a top-k, never an offset."""
    left = rows if after is None else rows.where(F.col(key) > after)
    return left.orderBy(key).limit(max(1, min(size, PAGE)))


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """SRC4: rows of one key; the filter is pushed to the scan."""
    return rows.where(F.col(key) == value)


def blobs(owned: DataFrame, shared: DataFrame, row_id: str, blob: str, schema: str) -> DataFrame:
    """SRC6: rows of two tables with their JSON text parsed; name and brand come from the columns where the text lacks them.

    Broken texts give null fields, never an error.
    """
    rows = owned.select(row_id, "owner", "name", "brand", blob).unionByName(shared.select(row_id, F.lit(None).cast("string").alias("owner"), "name", "brand", blob))
    read = rows.withColumn("__b", F.from_json(blob, schema))
    own = [f for f in read.schema["__b"].dataType.names if f not in ("name", "brand")]
    named = [F.coalesce(F.nullif(F.trim(F.get_json_object(blob, f"$.{c}")), F.lit("")), F.col(c)).alias(c) for c in ("name", "brand")]
    return read.select(row_id, "owner", *named, *[F.col(f"__b.{f}").alias(f) for f in own])


def json_equals(blob: Column, path: str, value: str) -> Column:
    """PF22: whether the text at a JSON path is this one, whatever its case."""
    return F.coalesce(F.lower(F.get_json_object(blob, path)) == value.lower(), F.lit(False))


def brand_sizes(entries: DataFrame, brand: str, handle: str, shown: int = 5) -> DataFrame:
    """SRC14: for each brand how many entries it has, the least and the greatest handle, and its first `shown` different handles.

    Entries of a hot brand meet as partial counts, its handles as the first ones of each task. A null handle is none.
    """
    counts = entries.groupBy(brand).agg(F.count("*").alias("n"), F.min(handle).alias("first_handle"), F.max(handle).alias("last_handle"))
    order = W.partitionBy(brand).orderBy(handle)
    first = entries.where(F.col(handle).isNotNull()).select(brand, handle).distinct().withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= shown)
    named = first.groupBy(brand).agg(F.array_sort(F.collect_list(handle)).alias("handles"))  # `shown` handles
    met = counts.withColumnRenamed(brand, "__brand").join(named, F.col("__brand").eqNullSafe(named[brand]), "left")
    return met.select(F.col("__brand").alias(brand), "n", "first_handle", "last_handle", F.coalesce("handles", F.array().cast("array<string>")).alias("handles"))


def stale(captured: Column, updated: Column, now: Column, hours: int = TTL_HOURS) -> Column:
    """PF5: whether a record was captured (else updated) more than `hours` ago; never where it has no readable time or hours isn't positive.

    A time without a zone is one of UTC, whatever the session's zone.
    """
    if hours <= 0:
        return F.lit(False)
    text = F.coalesce(F.nullif(captured, F.lit("")), F.nullif(updated, F.lit("")))
    timed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    at = F.try_to_timestamp(F.when(timed.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), timed).otherwise(F.concat(timed, F.lit("Z"))))
    return F.coalesce(at < now - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))


def has_detail(*parts: Column) -> Column:
    """PF25: whether one of a record's raw parts (texts, arrays or maps) holds anything."""
    out = F.lit(False)
    for part in parts:
        out = out | F.coalesce(F.length(F.to_json(F.struct(part.alias("x")))) > F.length(F.lit('{"x":""}')), F.lit(False))
    return out


def without_source(house: Column, name: Column, rules: tuple[tuple[str, str, str], ...] = NO_SOURCE) -> Column:
    """PF29: whether a house's line is one that no source has: the whole house, names that begin so, or hold this."""
    h, n = X.audit_key(F.replace(F.lower(F.coalesce(house, F.lit(""))), F.lit("'"), F.lit(""))), X.audit_key(F.coalesce(name, F.lit("")))
    out = F.lit(False)
    for own, mode, mark in rules:
        fits = {"any": F.lit(True), "prefix": F.startswith(n, F.lit(mark)), "contains": F.contains(n, F.lit(mark))}[mode]
        out = out | ((h == own) & fits)
    return out


def record_keys(asked: DataFrame, records: DataFrame, row: str) -> DataFrame:
    """MG2: for each asked row the record it belongs to, and how many others its keys lead to that are to be merged into it.

    asked: row, fg_url, bn_url, fallback; records: record_key, fg_url, bn_url. A record by the first address comes before
    one by the second and one by the fallback key (ties by record key); a row that none knows keeps its fallback. record_key is
    one row's. Records are reduced to one row a key before any join, so a key that many records share costs no more than
    another; how many records two addresses lead to is counted by pairs of them.
    """
    def least(out: str, *keys: str) -> DataFrame:
        keyed = records.where(F.col(keys[0]).isNotNull() & F.col(keys[-1]).isNotNull())
        return keyed.groupBy(*[F.col(k).alias(f"{out}_{i}") for i, k in enumerate(keys)]).agg(F.min("record_key").alias(out), F.count("*").alias(f"{out}_n"))

    first, second, pair = least("__f", "fg_url"), least("__b", "bn_url"), least("__p", "fg_url", "bn_url").drop("__p")
    own = records.select(F.col("record_key").alias("__o"), F.col("fg_url").alias("__of"), F.col("bn_url").alias("__ob"))
    met = asked.select(row, F.col("fg_url").alias("__f_0"), F.col("bn_url").alias("__b_0"), "fallback")
    met = met.join(first, "__f_0", "left").join(second, "__b_0", "left")
    met = met.join(pair.withColumnsRenamed({"__p_0": "__f_0", "__p_1": "__b_0"}), ["__f_0", "__b_0"], "left").join(own, met["fallback"] == own["__o"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    apart = F.col("__o").isNotNull() & ~F.coalesce(F.col("__of") == F.col("__f_0"), F.lit(False)) & ~F.coalesce(F.col("__ob") == F.col("__b_0"), F.lit(False))
    total = count("__f_n") + count("__b_n") - count("__p_n") + apart.cast("long")
    return met.select(row, F.coalesce("__f", "__b", "fallback").alias("record_key"), F.greatest(total - 1, F.lit(0)).cast("long").alias("merged"))


def house_repairs(records: DataFrame, key: str, name: str, house: str, query: str) -> DataFrame:
    """MG19, J12: records whose name repeats its house, with the new name, query and key; skipped where another record has the new key.

    Two repairs that lead to one new key are both skipped.
    """
    rows = I.with_stripped_name(records.select(key, name, house, query), name, house, "new_name").where(F.col("new_name") != X.clean(name))
    full = lambda n: F.trim(F.concat_ws(" ", F.col(house), F.col(n)))
    asked = F.when((F.trim(query) == full(name)) | (F.lower(F.trim(query)) == F.lower(name)), full("new_name")).otherwise(F.trim(query))
    rows = rows.withColumns({"new_query": asked, "new_key": F.concat_ws("|", X.audit_key(F.col(house)), X.audit_key(F.col("new_name")))})
    held = records.select(F.concat_ws("|", X.audit_key(F.col(house)), X.audit_key(F.col(name))).alias("new_key")).distinct().withColumn("__held", F.lit(True))
    twice = rows.groupBy("new_key").agg(F.count("*").alias("__n"))
    found = rows.join(held, "new_key", "left").join(twice, "new_key")
    return found.select(key, "new_name", "new_query", "new_key", (F.col("__held").isNotNull() | (F.col("__n") > 1)).alias("skipped"))


def matched_fill(rows: DataFrame, found: DataFrame, house: str, name: str, value: str) -> DataFrame:
    """MG18: rows plus a found value (house, name, value, source) where theirs is blank, by house and name whatever their case; filled says where.

    A found value that is null only marks the row as ambiguous. Columns filled and ambiguous of rows are refused.
    """
    unused(rows, "filled", "ambiguous")
    own = lambda c: F.lower(F.trim(F.col(c)))
    known = found.select(own(house).alias("__h"), own(name).alias("__n"), F.col(value).alias("__v"), F.col("source").alias("__s")).groupBy("__h", "__n").agg(F.min(F.struct("__v", "__s")).alias("__f"), F.lit(True).alias("__there"))
    joined = rows.withColumns({"__h": own(house), "__n": own(name)}).join(known, ["__h", "__n"], "left")
    blank = ~X.is_fact(F.col(value))
    fills = blank & F.col("__f.__v").isNotNull()
    out = {value: F.when(fills, F.col("__f.__v")).otherwise(F.col(value)), "filled": F.coalesce(fills, F.lit(False)), "ambiguous": F.coalesce(blank & F.col("__there") & F.col("__f.__v").isNull(), F.lit(False))}
    return joined.withColumns(out).drop("__h", "__n", "__f", "__there")


def heartbeat_age(beats: DataFrame, ts: str, now: Column) -> DataFrame:
    """MG20, ST8: one row with the latest beat and its age in seconds; null without beats."""
    last = beats.agg(F.max(F.col(ts).cast("timestamp")).alias("last_beat"))
    return last.select("last_beat", (F.unix_timestamp(now) - F.unix_timestamp("last_beat")).alias("age_seconds"))


def oldest(commands: DataFrame, status: str, queued: str, created: str, key: str) -> DataFrame:
    """TK3: the command that waits longest; ties by key."""
    return commands.where(F.col(status) == queued).orderBy(created, key).limit(1)


def newest(commands: DataFrame, created: str, key: str, limit: int = 25) -> DataFrame:
    """TK4: the newest commands, 1 to 100 of them."""
    return commands.orderBy(F.desc(created), key).limit(max(1, min(limit, COMMANDS)))


def dashboard(jobs: DataFrame, status: str, domain: tuple[str, ...], claimed: str, now: Column, lease: int = LEASE) -> DataFrame:
    """AG35: one row: jobs of each status (0 where there are none) and those whose lease has run out."""
    late = F.unix_timestamp(now) - F.unix_timestamp(F.col(claimed).cast("timestamp")) > lease
    return jobs.agg(*[F.count_if(F.col(status) == d).alias(d) for d in domain], F.count_if((F.col(status) == "processing") & F.coalesce(late, F.lit(True))).alias("stale_processing"), F.count("*").alias("total"))


def sweep_counts(records: DataFrame, has_metrics: Column, has_raw: Column, forced: bool = False) -> DataFrame:
    """AG36: what a sweep over all records would do: leave those that have metrics, recompute those with raw data, skip the rest."""
    kind = F.when(has_metrics & F.lit(not forced), "present").when(~has_raw, "no_raw").when(has_metrics, "repaired").otherwise("recomputed")
    return records.select(kind.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def export_row(issues: Column, fields: dict[str, Column], accords: Column) -> list[Column]:
    """PF32: the columns of an export row: plain fields, accords as one text, and the issues with their number."""
    named = F.filter(F.coalesce(accords, F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit(""))) != "")
    return [*[c.alias(k) for k, c in fields.items()], F.size(named).alias("n_accords"), F.array_join(named, ", ").alias("accords"), F.size(issues).alias("n_issues"), F.array_join(issues, "; ").alias("issues")]


#: Fields of a row of queue diagnostics.
DIAGNOSED = ("group", "id", "status", "house", "name", "query", "failure_count", "error_bucket", "last_error", "fg_url", "bn_url", "priority", "last_requested_at")


def queue_diagnostics(jobs: DataFrame) -> DataFrame:
    """SRC19: the queue's failed jobs, those that failed before and are in it again, and ignored ones, as rows of 13 texts with the bucket of their error.

    jobs has id, status, failure_count, last_error and what else of the fields it has; others are empty.
    """
    group = F.when(F.col("status") == "failed", "failed").when(F.col("status") == "ignored", "ignored").when(F.col("status").isin("pending", "processing") & (F.coalesce("failure_count", F.lit(0)) > 0), "retry_history")
    made = jobs.withColumns({"group": group, "error_bucket": X.error_bucket(F.col("last_error"))}).where("group is not null")
    return made.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in made.columns else F.lit("")).alias(c) for c in DIAGNOSED])
