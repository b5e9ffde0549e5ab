"""Best-fit packing by minimum bin slack.

Documents become token pieces; only the histogram of piece lengths (a number for each length up to the
sequence's) decides the packing, so what the driver sees is bounded whatever the corpus. For each bin the
largest length left and a bitset subset-sum over the others find the fullest combination, which is taken
away as often as its lengths last: a pattern. Pieces then find their place by their rank among pieces of
their length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import REMEMBERED, _L, _N
from .common import by_batches, give_back, settled, table

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0
#: New words that the library is asked for at once.
ASKED = 2048
#: Characters that are the same before and after NFC and whose lower case is one character everywhere.
_PLAIN = re.compile("[\t\n\r -~\xa0-įı-ɏ]*")
#: How the vocabulary with word ends splits such texts (fixed value).
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


class WordIds:
    """Texts to ids as the library gives them; words of plain texts are asked for once and remembered."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already; threads of its own cost memory
        from tokenizers import Tokenizer

        self.library, self.known = Tokenizer.from_file(vocabulary), {}

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        words = [_WORDS.findall(t.lower()) if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({w for found in words if found for w in found} - self.known.keys())
        for i in range(0, len(new), ASKED):
            part = new[i : i + ASKED]
            for word, got in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = np.asarray(got.ids, "<u4").tobytes()
        for text, found in zip(texts, words, strict=True):
            if found is None:
                yield np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(self.known.__getitem__, found))


@lru_cache(1)
def _word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters that are encoded together.
BLOCK = 1_000_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of `capacity` tokens only where that is longer."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        ids_of, end = _word_ids(vocabulary), np.asarray([END_ID], "<u4").tobytes()
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            block = (batch["text"].str.len().cumsum() // BLOCK).to_numpy()
            for b in np.unique(block):
                part, out = batch[block == b], []
                for doc_id, ids in zip(part["doc_id"], ids_of.encoded(part["text"].tolist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pd.DataFrame(out, columns=names)

    return by_batches(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rows, PIECES)


class Pattern(NamedTuple):
    """`times` bins that each hold these lengths."""

    times: int
    lengths: tuple[int, ...]


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """The lengths, each used no more often than counted, whose sum is the largest up to room.

    Bit s of the set says that s can be reached; larger lengths come first, and the search ends as soon as
    the room can be filled exactly.
    """
    full, bits, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        for _ in range(min(counts[n], room // n)):
            more = (bits | bits << n) & full
            if more == bits:
                break
            steps.append((n, bits))
            bits = more
        if bits >> room & 1:
            break
    total, used = bits.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> total & 1:
            used.append(n)
            total -= n
    return used


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Minimum bin slack over a histogram of lengths; each pattern is repeated while its lengths last."""
    counts = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    out = []
    while counts:
        first = next(iter(counts))
        counts[first] -= 1
        used = [first, *fullest(counts, [n for n in counts if counts[n] and n <= capacity - first], capacity - first)]
        counts[first] += 1
        often = {n: used.count(n) for n in used}
        times = min(counts[n] // k for n, k in often.items())
        out.append(Pattern(times, tuple(used)))
        for n, k in often.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


def _slots(found: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length and pattern the first rank it takes, and for each of its slots the offset in the bin."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern in found:
        at: dict[int, list[int]] = {}
        offset = 0
        for n in pattern.lengths:
            at.setdefault(n, []).append(offset)
            offset += n
        for n, offsets in at.items():
            start = rank.get(n, 0)
            for j, o in enumerate(offsets):
                rows.append((n << 40 | start + j * pattern.times, base, o))
            rank[n] = start + len(offsets) * pattern.times
        base += pattern.times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("key", "base", "offset"))}


PLACES = PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of every document with its sequence and place there; places have no gaps.

    A null or empty text is the end id alone; null ids and repeated rows are documents of their own; an
    empty table gives no rows; columns other than doc_id and text are ignored. Ranks are counted per length
    and slice, so a length that a third of all pieces have is spread over as many tasks as any other.
    """
    spark = docs.sparkSession
    slices = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = settled(pieces(docs, vocabulary, capacity)).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    counts = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    slots = spark.sparkContext.broadcast(_slots(patterns(histogram, capacity)))
    ranked = cut.withColumn("own", F.row_number().over(W.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before.select("length", "slice", "before"), ["length", "slice"]).withColumn("rank", F.col("before") + F.col("own"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, base, offset = (slots.value[k] for k in ("key", "base", "offset"))
        for batch in batches:
            want = batch["length"].to_numpy() << 40 | batch["rank"].to_numpy()
            at = np.searchsorted(key, want, "right") - 1
            batch["sequence_id"], batch["offset"] = base[at] + want - key[at], offset[at]
            yield batch.drop(columns="rank")

    return by_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), rows, PLACES)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
