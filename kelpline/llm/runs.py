"""Periodic runs of words, found by Karp-Miller-Rosenberg naming, and texts without their repeats.

A text's words are numbered; the name of a window of 2^k words is the number of the pair of names of its halves, so two
windows of a length have one name exactly when they are equal. Names are given by sorting pairs, not by hashes. From the
names the longest common extension of two places follows by descending levels. A run of period q has a stretch of
at least max(24, 3q) - q places that equal the place q further on, so it meets a grid of that step; every place of the
grids whose word returns q words later is extended both ways, and what is long enough is a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, table

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that are named together (a longer text is on its own), and grid places that are looked at together.
WORDS, PLACES = 1_000_000, 1 << 20
#: Bytes of a text that are split at once.
BLOCK = 1 << 20
SPACES = b" \t\n\v\f\r"


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of about BLOCK bytes, cut at white space."""
    start = 0
    while start < len(text):
        end = min(start + BLOCK, len(text))
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[start:end]
        start = end


def words_of(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of a text's words in the order of their first places, and the distinct words (null: none)."""
    known: dict[bytes, int] = {}
    own = [np.fromiter([known.setdefault(w, len(known)) for w in piece.split()], np.int32) for piece in _pieces((text or "").encode("utf-8", "surrogatepass"))]
    return np.concatenate(own) if own else np.zeros(0, np.int32), list(known)


def _named(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Names of pairs of names below n: -1 where the pair occurs once."""
    keys = first.astype(np.int64) * n + second
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    several = ~(new & np.concatenate([new[1:], [True]]))
    names = np.full(len(keys), -1, np.int32)
    rank = np.cumsum(new & several) - 1
    names[order[several]] = rank[several]
    return names, int(rank[-1]) + 1


class Names:
    """Names of all windows of 1, 2, 4 ... words; a window that occurs once, or leaves its text, is named -1.

    Each level is one longer than the words, so that a place behind the last one can be asked for. The levels end with
    the last at which any window occurs twice.
    """

    def __init__(self, words: np.ndarray):
        """words: numbers from 0 that differ between texts; -1 between two texts."""
        counts = np.bincount(words[words >= 0], minlength=1)
        several = np.flatnonzero(counts > 1)
        again = np.full(len(counts), -1, np.int32)
        again[several] = np.arange(len(several), dtype=np.int32)
        level = np.where(words >= 0, again[words], -1).astype(np.int32)
        self.levels, n, half = [np.append(level, np.int32(-1))], len(several), 1
        while n:
            last = self.levels[-1]
            at = np.flatnonzero((last[:-half] >= 0) & (last[half:] >= 0))
            if not len(at):
                break
            made = np.full(len(last), -1, np.int32)
            made[at], n = _named(last[at], last[at + half], n)
            if n:
                self.levels.append(made)
            half *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from places i and j on."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = self.levels[k][i], self.levels[k][j]
            step = ((a == b) & (a >= 0)).astype(np.int64) << k
            i, j, length = i + step, j + step, length + step
        return length

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common that end before places i and j, where i < j."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            inside = i >= 1 << k
            a, b = self.levels[k][np.where(inside, i - (1 << k), -1)], self.levels[k][np.maximum(j - (1 << k), 0)]
            step = (inside & (a == b) & (a >= 0)).astype(np.int64) << k
            i, j, length = i - step, j - step, length + step
        return length


def _grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods: for each period that a text of `longest` words can have, every max(24, 3q) - q th place."""
    q = np.arange(1, longest // LEAST_PERIODS + 1, dtype=np.int64)
    step = np.maximum(LEAST_WORDS, LEAST_PERIODS * q) - q
    count = np.maximum(-(-(n - q) // step), 0)
    ends = np.cumsum(count)
    start = 0
    while start < len(q):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + PLACES, "right")))
        own = np.repeat(np.arange(start, end), count[start:end])
        yield (np.arange(done, ends[end - 1]) - (ends - count)[own]) * step[own], q[own]
        start = end


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One run a stretch: a stretch that has a multiple of its smallest period as well was met by both."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def found(words: np.ndarray, longest: int) -> np.ndarray:
    """Runs (start, length, period) of texts of at most `longest` words, by start, then period; words as Names has them."""
    names, runs = Names(words), np.zeros((0, 3), np.int64)
    first = names.levels[0]
    for place, period in _grid(len(words), longest):
        same = np.flatnonzero((first[place] == first[place + period]) & (first[place] >= 0))
        i, q = place[same], period[same]
        back = names.left(i, i + q)
        length = back + names.right(i, i + q) + q
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        if long.any():
            runs = _smallest(np.concatenate([runs, np.stack([i - back, length, q], 1)[long]]))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stand in the first period of every run that has them."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


#: Fields of collapsed(); no blank inside a type, as by_batches() cuts there.
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _collapsed(texts: list[tuple]) -> Iterator[tuple]:
    """doc_id, n_words, runs and the collapsed text of texts that are named together."""
    parts, starts, at, names = [], [], 0, 0
    for _, own, known in texts:
        parts += [own + np.int64(names), np.array([-1])]
        starts.append(at)
        at, names = at + len(own) + 1, names + len(known)
    runs = found(np.concatenate(parts), max(len(own) for _, own, _ in texts))
    cuts = np.searchsorted(runs[:, 0], [*starts, at])
    for k, (doc_id, own, known) in enumerate(texts):
        mine = runs[cuts[k] : cuts[k + 1]] - np.array([starts[k], 0, 0])
        left = own[kept(len(own), mine)] if len(mine) else own
        text = b" ".join([known[w] for w in left.tolist()]).decode("utf-8", "surrogatepass")
        yield doc_id, len(own), [{"start": s, "length": n, "period": q} for s, n, q in mine.tolist()], text


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "n_words", "runs", "collapsed"]

    def flushed(texts: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(list(_collapsed(texts)), columns=columns)

    for batch in batches:
        texts, total = [], 0
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            own, known = words_of(text)
            if texts and total + len(own) > WORDS:
                yield flushed(texts)
                texts, total = [], 0
            texts.append((doc_id, own, known))
            total += len(own)
        if texts:
            yield flushed(texts)


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text with every run cut to its first period, words joined by one space.

    A run is a stretch of words with smallest period q and at least 24 words and 3 periods that no neighbouring word
    extends. A null or empty text has no words, no runs and an empty collapsed text; null ids and repeated rows stay,
    other columns are ignored; an empty table gives no rows. No shuffle: a text is one task's, in memory of a few
    numbers a word and level.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batches(rows, _batches, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period of an array by start, then period; the first of equal ones, null of none."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a text in ten (by crc32 of its id) goes on with repeats of some of its words; a null id has none."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("g", F.floor(h / 10))
    words = F.array_remove(F.split(F.translate("text", "\t\n\x0b\f\r", " " * 5), " "), "")
    chosen = F.when(h % 10 == 0, words)
    rows = rows.withColumn("words", chosen).withColumn("n", F.size("words").cast("long"))
    some = F.col("n") > 0
    rows = rows.withColumn("a", F.when(some, F.col("g") % F.col("n"))).withColumn("p", F.when(some, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    after = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), after), " ")
    return rows.select("doc_id", F.when(some, made).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = collapsed(docs).withColumn("best", strongest(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(planted(table(spark, sf_dir, "documents")))
