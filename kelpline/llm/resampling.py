"""Importance resampling towards a target corpus by hashed n-grams, with long texts cut into overlapping chunks.

Texts of more than a chunk are cut at word boundaries into chunks that are dealt anew, so that one long text is many tasks'
work. A chunk owns the n-grams that start in its own words and carries the n - 1 words after them, so that every n-gram is
counted once, by one chunk. Counts of buckets are summed in each task before they meet; a document's weights are the sums of
its chunks'.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, ranked, settled, table

#: Words of an n-gram at most, buckets, and bytes of a chunk's own words (about; a word is never cut).
GRAMS, BUCKETS, CHUNK = 2, 10_000, 1 << 16
#: Words that a document has at least to be drawn, and documents drawn of a hundred of those.
LEAST_WORDS, SHARE, SEED = 20, 25, 7
#: Bytes that stand for a space: all ASCII but digits and small letters.
SPACE = bytes(32 if b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8: letters, digits and everything beyond ASCII; A-Z are made small."""
    return text.lower().translate(SPACE).split()


def chunks(text: str | None, size: int = CHUNK, carry: int = GRAMS - 1) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a text, in order: its own words, and the `carry` words after them. A null text is one chunk without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(SPACE)
    start = 0
    while True:
        cut = data.find(b" ", start + size)
        if cut < 0:
            yield data[start:], b""
            return
        after, at = [], cut
        while len(after) < carry and at < len(data):
            end = data.find(b" ", at + 1)
            end = len(data) if end < 0 else end
            if end > at + 1:
                after.append(data[at + 1 : end])
            at = end
        yield data[start:cut], b" ".join(after)
        start = cut


def buckets_of(own: list[bytes], carry: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the runs of 1 to `grams` words that start in own; they may end in carry."""
    words = own + carry
    crc = list(map(zlib.crc32, own))
    out = [np.fromiter(crc, np.int64, len(crc))]
    spaced = [b" " + w for w in words[1:]]
    for n in range(1, grams):
        crc = list(map(zlib.crc32, spaced[n - 1 :], crc))  # a longer run's checksum goes on from the shorter one's
        out.append(np.fromiter(crc, np.int64, len(crc)))
    return np.concatenate(out) % buckets


def chunked(docs: DataFrame, size: int = CHUNK, carry: int = GRAMS - 1) -> DataFrame:
    """row, doc_id, own, carry: the chunks of all texts; row numbers the rows of docs, whatever their ids.

    Texts of up to a chunk stay where they are; chunks of longer ones are dealt evenly over all tasks.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > size, F.lit(False))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                made = []
                for k, (own, after) in enumerate(chunks(text, size, carry)):
                    made.append((row, doc_id, k, own, after))
                    if len(made) == 64:
                        yield pd.DataFrame(made, columns=["row", "doc_id", "chunk", "own", "carry"])
                        made = []
                if made:
                    yield pd.DataFrame(made, columns=["row", "doc_id", "chunk", "own", "carry"])

    parts = by_batches(rows.where(long), cut, "row long, doc_id long, chunk long, own binary, carry binary", ids=("doc_id", "row"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(tasks, F.xxhash64("row", "chunk")).drop("chunk")
    short = rows.where(~long).select("row", "doc_id", F.col("text").cast("binary").alias("own"), F.lit(None).cast("binary").alias("carry"))
    return short.unionByName(dealt)


def _each(batch: pd.DataFrame, grams: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Own words and buckets of each chunk of a batch."""
    for own, carry in zip(batch["own"], batch["carry"], strict=True):
        words = words_of(bytes(own or b""))
        yield len(words), buckets_of(words, words_of(bytes(carry or b"")), grams, buckets)


def bucket_counts(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """bucket, n: how many n-grams of all texts fall into each bucket that has any; one row a bucket and task is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, several = np.zeros(buckets, np.int64), [np.zeros(0, np.int64)]
        for batch in batches:
            for _, found in _each(batch, grams, buckets):
                several.append(found)
                if sum(map(len, several)) >= buckets:
                    total += np.bincount(np.concatenate(several), minlength=buckets)
                    several = []
        total += np.bincount(np.concatenate([*several, np.zeros(0, np.int64)]), minlength=buckets)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": met, "n": total[met]})

    parts = chunked(docs, size, grams - 1).select("own", "carry").mapInPandas(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """bucket, gain: a thousand times the log of how much likelier a bucket is in target than in docs, each bucket counted once more; floored."""
    spark = docs.sparkSession
    counts = [bucket_counts(x, grams, buckets, size).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t"))]
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    for c in counts:
        every = every.join(c, "bucket", "left")
    every = every.fillna(0, ["s", "t"]).withColumn("k", F.lit(1))
    sums = every.groupBy("k").agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    one = lambda c: F.col(c).cast("double") + 1
    ratio = one("t") * (F.col("all_s") + buckets) / (one("s") * (F.col("all_t") + buckets))
    return every.join(F.broadcast(sums), "k").select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of docs: the floored mean gain of its n-grams (none: 0).

    gain has `buckets` rows, which reach every task.
    """
    table_of = np.zeros(buckets, np.int64)
    for r in gain.collect():  # one row a bucket
        table_of[r["bucket"]] = r["gain"]
    shared = docs.sparkSession.sparkContext.broadcast(table_of)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = [(words, len(found), int(shared.value[found].sum())) for words, found in _each(batch, grams, buckets)]
            out = pd.DataFrame(sums, columns=["n_words", "n_features", "gained"])
            yield out.assign(row=batch["row"].to_numpy(), doc_id=batch["doc_id"].to_numpy())

    parts = by_batches(chunked(docs, size, grams - 1), weigh, "row long, doc_id long, n_words long, n_features long, gained long", ids=("doc_id", "row"))
    sums = parts.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gained")])
    mean = F.expr("(gained - pmod(gained, n_features)) div n_features")  # in longs: the floor, without rounding
    return sums.select("row", "doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(0).cast("long").alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED, grams: int = GRAMS, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank numbers the drawn ones from 1 by falling score, then doc_id.

    Of the rows with `least` words or more, share of a hundred are drawn without replacement: the highest of weight plus a
    Gumbel number of the id's hash. Null texts have no words; null ids draw by an empty id, before others of a score;
    repeated rows are rows of their own, equal ones in any order. Without a target text every gain is by the
    documents' own counts. An empty table gives no rows. Other columns are ignored.
    """
    weights = weighed(docs, gains(docs, target, grams, buckets, size), grams, buckets, size)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = settled(weights.withColumn("score", F.col("weight") + noise))
    enough = F.col("n_words") >= least
    drawn = scored.where(enough).count() * share // 100
    placed = ranked(scored.where(enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc()], "rank")
    out = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))
