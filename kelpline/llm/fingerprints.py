"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0 ... c_{n-1} give, for two bases, the modular prefix arrays H[i] = sum over j < i of
c_j * B^j mod 2^31 - 1. Two spans are equal when their differences of prefixes, brought to the same power,
are (up to a chance of about n^2 / 2^62). On top of that: longest common extensions by binary search,
fingerprints that are compared without their texts, and the edited neighbours of a corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, table

#: The Mersenne prime 2^31 - 1, whose remainders need a shift and an addition only.
PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003_579 % (2**31 - 1), 777_767_777)
#: Code points of the spans that a fingerprint samples: the first, and each shorter one down to an eighth of the text.
SPANS = (24, 12, 6, 3, 2, 1)
#: Bins of a fingerprint's sketch: the least sample of each bin is kept, 16 bits of it.
BINS = 64
EMPTY = 0xFFFF

_S31, _S33, _S29 = np.uint64(31), np.uint64(33), np.uint64(29)
#: Powers of both bases, then of their inverses, so that a span's hash doesn't depend on where it starts.
_FACTORS = (*BASES, *(pow(b, 2**31 - 3, 2**31 - 1) for b in BASES))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64) for _ in _FACTORS]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for x < 2^63 (2^31 - 1 itself may stand for 0; _exact() ends that)."""
    x = (x & PRIME) + (x >> _S31)
    return (x & PRIME) + (x >> _S31)


def _exact(x: np.ndarray) -> np.ndarray:
    x = _reduced(x)
    x[x == PRIME] = 0
    return x


def powers(k: int, n: int) -> np.ndarray:
    """Powers 0 ... n-1 of factor k, grown by doubling and kept."""
    p = _POWERS[k]
    while len(p) < n:
        top = _exact(p[-1:] * np.uint64(_FACTORS[k]))
        p = np.concatenate([p, _exact(p * top)])
    _POWERS[k] = p
    return p[:n]


def codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class Prefixes:
    """Prefix arrays of one text (null: empty): any span's hash in O(1), extensions in O(log n)."""

    def __init__(self, n: int, h: list[np.ndarray]):
        self.n, self.h = n, h

    @classmethod
    def of(cls, text: str | None) -> Prefixes:
        chars = codes(text)
        return cls(0, [np.zeros(1, np.uint64)] * len(BASES)).spliced(0, chars)

    def spliced(self, cut: int, chars: np.ndarray) -> Prefixes:
        """The arrays of the first cut code points followed by others; the kept part isn't hashed again."""
        out = []
        for k, h in enumerate(self.h):
            terms = _reduced(chars * powers(k, cut + len(chars))[cut:])
            out.append(np.concatenate([h[: cut + 1], _exact(h[cut] + np.cumsum(terms))]))
        return Prefixes(cut + len(chars), out)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of [start, end): equal for equal spans, wherever they stand."""
        p, two = int(PRIME), len(BASES)
        return (end - start, *((int(h[end]) - int(h[start])) % p * int(powers(k + two, start + 1)[start]) % p for k, h in enumerate(self.h)))

    def equal(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """The longest common extension to the right of two positions."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, other_start, mid) else (low, mid - 1)
        return low

    def spans(self, length: int) -> np.ndarray:
        """62-bit hashes of all spans of the length (of the whole text if that is shorter)."""
        length = min(length, self.n)
        if not length:
            return np.zeros(0, np.uint64)
        m, out = self.n - length + 1, np.uint64(0)
        for k, h in enumerate(self.h):
            diff = _reduced(h[length:] + PRIME - h[:m])
            out = (out << _S31) | _exact(diff * powers(k + len(BASES), m))
        return out

    def whole(self) -> int:
        return (int(self.h[0][-1]) << 31) | int(self.h[1][-1])


def sketches(text: Prefixes) -> list[np.ndarray]:
    """A sketch for each length of SPANS down to the first that is at most an eighth of the text (or a single code point)."""
    levels = next((i for i, length in enumerate(SPANS) if 8 * length <= text.n), len(SPANS) - 1) + 1
    return [sketch(text, length) for length in SPANS[:levels]]


def sketch(text: Prefixes, length: int) -> np.ndarray:
    """The 16 bits kept of the least sample in each bin; EMPTY where a bin has none."""
    x = text.spans(length)
    x = (x ^ (x >> _S33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _S29)) * np.uint64(0xC4CEB9FE1A85EC53)
    least = np.full(BINS, np.uint64(2**64 - 1))
    np.minimum.at(least, (x >> np.uint64(58)).astype(np.int64), x & np.uint64(2**58 - 1))
    kept = (least % np.uint64(EMPTY)).astype(np.uint16)
    kept[least == np.uint64(2**64 - 1)] = EMPTY
    return kept


def written(text: Prefixes, bins: list[np.ndarray]) -> str:
    """n_chars, the whole text's hash and the sketches by falling length of SPANS, in hexadecimal: the fingerprint as a string."""
    return ".".join([f"{text.n:x}", f"{text.whole():016x}", *(x.astype(">u2").tobytes().hex() for x in bins)])


def fingerprint(text: str | None) -> str:
    own = Prefixes.of(text)
    return written(own, sketches(own))


def likeness(a: str, b: str) -> float:
    """Share of spans in common, 0 to 1, from two fingerprints alone: 1 for equal texts, 0 against an empty one.

    The sketches of the shortest spans that both have estimate the Jaccard index J of the two span sets;
    2J / (1 + J) is the shared part of an average text.
    """
    own, other = a.split("."), b.split(".")
    if own[:2] == other[:2]:
        return 1.0
    return _shared(*([np.frombuffer(bytes.fromhex(x), ">u2") for x in f[2:]] for f in (own, other)))


def _shared(own: list[np.ndarray], other: list[np.ndarray]) -> float:
    *_, (x, y) = zip(own, other)  # the longer list's last lengths are of no use
    used = int(((x != EMPTY) | (y != EMPTY)).sum())
    j = int(((x == y) & (x != EMPTY)).sum()) / used if used else 0.0
    return 2 * j / (1 + j)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long"


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order; each but guests is compared with the row after it in its bucket."""
    last = None
    for batch in batches:
        out = []
        for row in zip(batch["bucket"], batch["guest"], batch["doc_id"], batch["text"], strict=True):
            bucket, guest, doc_id, text = row
            if last is not None and last[0] == bucket:
                own, text = Prefixes.of(text), text or ""
                bins = sketches(own)
                out.append(_edited(*last[1:], own, bins, text))
                last = None if guest else (bucket, doc_id, own, bins, text)
            elif not guest:
                own = Prefixes.of(text)
                last = (bucket, doc_id, own, sketches(own), text or "")
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")])


def _edited(doc_id, own: Prefixes, bins: list[np.ndarray], text: str, following: Prefixes, next_bins: list[np.ndarray], next_text: str) -> tuple:
    kept = own.n - own.n // 4
    tail = next_text[: own.n // 4]
    edited = own.spliced(kept, codes(tail))
    edited_bins = sketches(edited)
    near = [1.0 if (x.n, x.whole()) == (own.n, own.whole()) else _shared(bins, b) for x, b in ((edited, edited_bins), (following, next_bins))]
    sha = hashlib.sha256((text[:kept] + tail).encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, own.n, sha, written(own, bins), written(edited, edited_bins), *near, own.extension(0, edited, 0), own.extension(0, following, 0))


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose last quarter the start of the next document replaces.

    near_ is their likeness to the edited and to the next text, prefix_ the longest common prefix with either.

    Documents follow each other by doc_id (nulls first; rows of one id by a hash of their texts), the first
    follows the last. A null text is empty; repeated rows stay; an empty table gives no rows; other columns
    are ignored. One shuffle of the texts: ids are cut into ranges at approximate quantiles, and the first
    row of each range goes to the end of the range before it as well.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(2**63)).cast("long")
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), low).alias("k"))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(ids.agg(F.percentile_approx("k", cuts, 20 * ranges)).first()[0] or [])) if cuts else []
    firsts = sorted((r["b"], r["k"]) for r in ids.groupBy(_range_of(F.col("k"), bounds).alias("b")).agg(F.min("k").alias("k")).collect())  # a row a range
    into = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(into, "k long, into int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), low).alias("k"), F.col("text").cast("string").alias("text"))
    own = F.struct(_range_of(F.col("k"), bounds).alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("into").alias("bucket"), F.lit(True).alias("guest"))
    placed = rows.join(guests, "k", "left").withColumn("at", F.explode(F.when(F.col("into").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    placed = placed.select("at.bucket", "at.guest", "k", "doc_id", "text")
    ordered = placed.repartitionById(ranges, "bucket").sortWithinPartitions("bucket", "guest", "k", F.xxhash64("text"))
    return by_batches(ordered.select("bucket", "guest", "doc_id", "text"), _followed, EDITED)


def _range_of(key, bounds: list[int]):
    """How many bounds are at most key: found in strides, then within one stride."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    as_array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    strides = F.size(F.filter(as_array(bounds[step - 1 :: step]), lambda b: b <= key)) if len(bounds) >= step else F.lit(0)
    rest = F.slice(as_array(bounds), strides * step + 1, F.lit(step))
    return (strides * step + F.size(F.filter(rest, lambda b: b <= key))).cast("int")


def query(spark, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))
