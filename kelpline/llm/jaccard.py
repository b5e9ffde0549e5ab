"""Exact Jaccard join of shingle sets in metric space.

Sets are points under the symmetric difference |x - y| + |y - x|; a link of similarity t is a distance of at most
(1 - t) / (1 + t) * (|x| + |y|), never more than reach(x) = (1 - t) / t * |x|. Equal sets are one class before all
that, so copies cost nothing. Four steps, none of which drops a link:

1. A first cut that is a prefix filter, not yet a Voronoi diagram: random texts all lie about as far from each
   other, so nearest pivots alone would copy every set to every region. A set goes to the regions of its
   n - ceil(t n) + 1 rarest shingles, where linked sets must meet. Most of these are nobody else's: they are
   found by 38 bits of each, sorted part by part, and left out before any set is shuffled.
2. Pivots. In every region the set of highest rank (its rare shingles are those of many others: it is the likely
   original) becomes the pivot. As the ranks are of the whole corpus, a set meets few different pivots though it
   is in many regions. Sets within twice their reach of a pivot form its Voronoi region; those it links are one
   component and aren't compared among each other.
3. Recursion in a pivot's region. x and y are as far apart as their differences from the pivot, which are small
   sets: they are joined by a prefix filter of their own, on the rarest differences first. Two sets that share
   none cannot be linked unless the pivot links both, so copies that were edited apart meet no more.
4. Sets beyond a pivot's region are compared by more pivots from among them. By the triangle inequality those that
   the pivot holds closely can't reach them; only those at its boundary are copied there.

Before sets are fetched for a comparison, a coarser metric bounds it: sets cut into equal slices of the shingle
space are vectors of counts, and what their counts differ by in sum is at most the sets' distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, held, hot_keys, join_hot, join_small, salted_group_min, settled, small_batches, table
from .components import components

#: Words of a shingle and least similarity in percent: the query's, then those of near-duplicate stages.
WIDTH, PERCENT = 3, 90
STAGE_WIDTH, STAGE_PERCENT = 5, 80
#: Bits of the histogram that ranks shingles (8 MB whatever the corpus), and parts that it is summed in.
BITS, PARTS = 20, 64
#: Bits of the slots that regions of several sets are marked in: at least 3 slots for each region, 32 MB of bits at most.
LEAST_SLOTS, MOST_SLOTS = 16, 28
#: Regions that a part of them holds, about, and a task packs at once.
PACKED = 1 << 20
#: Pairs of whole sets that a Python worker holds at once.
PAIRS = 512
#: Pivots of a region in the first round of a recursion, and times as many each round after it.
MORE = 32
#: Bits of a class id below its rank.
PLACE = 53
#: Bytes of texts that are hashed together.
BLOCK = 1 << 20

_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(32)
#: Bytes that part words: white space of ASCII.
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


#: A random number for each byte, A-Z as a-z, and for each place in a word (further ones are computed).
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))
_BYTES[65:91] = _BYTES[97:123]
_PLACES = _mixed(np.arange(1 << 20, (1 << 20) + 4096, dtype=np.uint64))


def _words(raw: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some bytes and where they start: sums of byte times place, mixed. A word ends where a text begins (firsts)."""
    inside = _INSIDE[raw]
    # one place more, so that each word's end is a place as well
    begins, ends = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    begins[:-1], ends[1:] = inside, inside
    cut = np.zeros(len(raw) + 1, bool)
    cut[firsts] = True
    starts, stops = (np.flatnonzero(x) for x in (begins & (~ends | cut), ends & (~begins | cut)))
    sizes = stops - starts
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, sizes)
    keys = _PLACES[place] if sizes.max() <= len(_PLACES) else _mixed(place.astype(np.uint64) + np.uint64(1 << 20))
    sums = np.add.reduceat(_BYTES[raw[at]] * keys, np.cumsum(sizes) - sizes)
    return _mixed(sums + sizes.astype(np.uint64) * _M2), starts


def _joined(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    h = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        h = (h ^ (h >> _S)) * _M1 + words[k : len(words) - size + 1 + k]
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def _runs(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text, raw[offsets[i] : offsets[i + 1]], the 64-bit hashes of its runs of words."""
    words, starts = _words(raw, offsets)
    at = np.searchsorted(starts, offsets).tolist()
    whole = _joined(words, width) if len(words) >= width else words[:0]
    out = []
    for a, b in zip(at, at[1:]):
        n = b - a
        out.append(whole[a : b - width + 1] if n >= width else _joined(words[a:b], n) if n else words[:0])
    return out


def runs(text: str | None, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` words, in order; of all words if they are fewer; none without words.

    Words are what white space of ASCII divides, A-Z in lower case.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return _runs(raw, np.array([0, len(raw)]), width)[0]


def blocks(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(place of the first, runs of each) of texts that are hashed together: about BLOCK bytes, one text at least.

    The texts' own UTF-8 is read where it lies; a null is empty.
    """
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, _runs(raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], width)
        first = end


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of runs()."""
    return np.unique(runs(text, width))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """How many runs of words of the corpus fall into each of 2^BITS buckets: summed per task, then in PARTS parts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for _, found in blocks(batch.column("text"), width):
                np.add.at(total, (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in np.split(total, PARTS)])], ["part", "counts"])

    def summed(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << BITS) // PARTS, np.int64)
        for batch in batches:
            for counts in batch["counts"]:
                total += np.frombuffer(counts, np.uint32 if len(counts) == 4 * len(total) else np.int64)
        yield pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})

    parts = _texts(docs).select("text").mapInArrow(counted, "part int, counts binary")
    found = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in parts.groupBy("part").applyInPandas(summed, "part int, counts binary").collect()}  # PARTS rows
    return np.concatenate([found.get(p, np.zeros((1 << BITS) // PARTS, np.int64)) for p in range(PARTS)])


def _digest(sets: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest() if len(sets) else None


def _prefix(sets: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The set's rarest shingles, of which linked sets share one, and its rank: how common these are, 0 to 1023.

    Shingles that the corpus has once are left out after that, and all of a set too small to be linked with another.
    """
    n = len(sets)
    if 100 * n < percent * (n + 1):
        return sets[:0], 0
    reach = n - -(-percent * n // 100) + 1
    common = counts[(sets >> np.uint64(64 - BITS)).astype(np.int64)]
    first = np.argsort(common, kind="stable")[:reach]
    rank = min(1023, int(25 * np.log2(1 + common[first].astype(float)).mean()))
    return sets[first[common[first] > 1]], rank


def _counts(sets: np.ndarray, percent: int) -> bytes:
    """How many shingles each slice holds (255: as many or more); a power of two of slices, more of them where links are longer."""
    bits = max(4, (len(sets) // (8 if percent >= 90 else 2)).bit_length())
    return np.minimum(np.bincount((sets >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of the distance of two sets from their counts; the finer one is folded to the other's slices."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    # sums of capped counts would not bound anything, so capped slices of the finer one count for nothing
    n = min(len(x), len(y))
    capped = np.zeros(n, bool)
    for v in (x, y):
        capped |= (v.reshape(n, -1) == 255).any(1)
    diff = np.abs(x.reshape(n, -1).sum(1) - y.reshape(n, -1).sum(1))
    return int(diff[~capped].sum())


def _measured(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, digest (null if empty), the set's regions, rank and counts, settled."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs, width))  # counts of a fixed number of buckets

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in blocks(batch.column("text"), width):
                sets = [np.unique(x) for x in found]
                regions, ranks = zip(*(_prefix(x, shared.value, percent) for x in sets))
                columns = [
                    batch.column("doc_id").slice(first, len(sets)),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_digest(x) for x in sets], pa.binary()),
                    pa.array(ranks, pa.int64()),
                    pa.array([x.view(np.int64) for x in regions], pa.list_(pa.int64())),
                    pa.array([_counts(x, percent) for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "rank", "regions", "v"])

    own = settled(_texts(docs).mapInArrow(rows, "doc_id long, n long, digest binary, rank long, regions array<long>, v binary"))
    shared.destroy()
    return own


def _flat(regions: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All regions of a batch, and where those of each set begin and end."""
    ends = regions.offsets.to_numpy()
    return regions.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64), ends - ends[0]


def _marked(own: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each of 2^bits slots of regions, by their first bits, and bits: set where rows of own share a region.

    Of a region a row sends 32 bits to one of the parts, which rise in number with the regions; a part sorts its own. Regions that agree in all
    of these bits, or in their slot, may be marked without being shared, never the other way.
    """
    total = own.agg(F.sum(F.size("regions"))).first()[0] or 0
    bits = min(MOST_SLOTS, max(LEAST_SLOTS, (3 * total).bit_length()))
    of_part = min(12, max(6, (total // PACKED).bit_length()))  # bits of a part's number
    low = np.uint64(64 - of_part - 32)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def sent() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(waiting) >> low)
            cuts = np.searchsorted(keys, np.arange(1, 1 << of_part, dtype=np.uint64) << np.uint64(32))
            parts = [p.astype(np.uint32).tobytes() for p in np.split(keys, cuts)]
            return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "keys"])

        for batch in batches:
            waiting.append(_flat(batch.column("regions"))[0])
            size += len(waiting[-1])
            if size >= PACKED:
                yield sent()
                waiting, size = [], 0
        if size:
            yield sent()

    def shared(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for batch in batches for x in batch["keys"]]))
        # slots of a part follow each other
        slots = np.zeros(1 << (bits - of_part), bool)
        slots[keys[1:][keys[1:] == keys[:-1]] >> np.uint32(32 - bits + of_part)] = True
        yield pd.DataFrame({"part": [key[0]], "slots": [np.packbits(slots).tobytes()]})

    parts = own.select("regions").mapInArrow(packed, "part int, keys binary").groupBy("part").applyInPandas(shared, "part int, slots binary")
    marked = np.zeros((1 << of_part, 1 << (bits - of_part - 3)), np.uint8)
    for r in parts.collect():  # bits of a bounded number of slots
        marked[r["part"]] = np.frombuffer(r["slots"], np.uint8)
    return marked.reshape(-1), bits


def _shared_only(own: DataFrame) -> DataFrame:
    """own without the regions that no two rows of it share; some of these may stay."""
    marked, bits = _marked(own)
    sent = own.sparkSession.sparkContext.broadcast(marked)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("regions")
            flat, ends = _flat(batch.column(at))
            slots = flat >> np.uint64(64 - bits)
            kept = (sent.value[slots >> np.uint64(3)] << (slots & np.uint64(7)).astype(np.uint8) & 128).astype(bool)
            before = np.concatenate([[0], np.cumsum(kept)])
            regions = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), pa.array(flat[kept].view(np.int64)))
            yield pa.RecordBatch.from_arrays([regions if k == at else x for k, x in enumerate(batch.columns)], batch.schema.names)

    return own.mapInArrow(rows, own.schema)


def _classes(own: DataFrame) -> DataFrame:
    """c, digest, n, rep (an id of a document that has it), regions that it may share and v of every distinct set; ids rise with the rank."""
    found = _shared_only(own).where("digest is not null").groupBy("digest").agg(F.min(_key("doc_id")).alias("rep"), *[F.first(x).alias(x) for x in ("n", "rank", "regions", "v")])
    place = F.monotonically_increasing_id()
    return settled(found.select((F.shiftleft("rank", PLACE) + place).alias("c"), "digest", "n", "rep", "regions", "v"))


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(-(2**63)).cast("long"))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Sizes whose sets may still be linked."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _first_cut(classes: DataFrame) -> DataFrame:
    """s, c and p, the pivot, of every set in a region of several, with their sizes n and np."""
    placed = classes.select("c", "n", F.explode("regions").alias("s"))
    tops = held(placed.groupBy("s").agg(F.count("*").alias("k"), F.max("c").alias("p"), F.max_by("n", "c").alias("np")).where("k > 1"))
    met = settled(join_hot(placed, tops, "s", hot=hot_keys(tops, "s")[0].get(None, [])).select("s", "c", "n", "p", "np"))
    forget(tops)
    return met


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, x): the whole sets of the wanted classes, from the text of one document of each."""
    # no more documents and digests than classes: one count bounds all three
    small = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda x: x
    own = held(classes.join(small(wanted), "c", "left_semi").select("c", "digest", "rep"))
    reps = own.select(F.col("rep").alias("k")).distinct()
    texts = _texts(docs).withColumn("k", _key("doc_id")).join(small(reps), "k", "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in blocks(batch.column("text"), width):
                sets = [x for x in map(np.unique, found) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "x"])

    # rows that repeat an id may have other texts, which are not wanted
    found = settled(texts.select("text").mapInArrow(rows, "digest binary, x binary").join(small(own.select("c", "digest")), "digest").select("c", "x").dropDuplicates(["c"]))
    forget(own)
    return found


def _hot_sides(pairs: DataFrame) -> dict[str, list]:
    """The hot ids of a and of b among pairs, counted together."""
    sides = pairs.select(F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("c")) for x in "ab"])).alias("x")).groupBy("x.side", "x.c").agg(F.count("*").alias("k"))
    found, _ = hot_keys(sides, "c", "side")
    return {x: found.get(x, []) for x in "ab"}


def _reached(percent: int, times: int) -> Column:
    """Whether the sizes na and nb alone leave two sets within `times` reaches of b."""
    return percent * F.abs(F.col("na") - F.col("nb")) <= times * (100 - percent) * F.col("nb")


def _within(pairs: DataFrame, classes: DataFrame, percent: int, times: int) -> DataFrame:
    """pairs (a, b, na, nb) whose sizes and counts don't put them more than `times` reaches of b apart, settled."""

    @F.pandas_udf("long")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_apart(a, b) for a, b in zip(x, y, strict=True)], dtype="int64")

    counts = classes.select("c", "v")
    # sizes alone differ by no more than a distance; counts are fetched for the pairs that pass
    sized = held(pairs.where(_reached(percent, times)).select("a", "b", "na", "nb").distinct())
    hot = _hot_sides(sized)
    joined = join_hot(join_hot(sized, counts.toDF("a", "va"), "a", hot=hot["a"]), counts.toDF("b", "vb"), "b", hot=hot["b"])
    found = settled(joined.where(percent * apart("va", "vb") <= times * (100 - percent) * F.col("nb")).select("a", "b", "na", "nb"))
    forget(sized)
    return found


def _compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, times: int) -> DataFrame:
    """a, b, their sizes and their distance d of the pairs that the sets leave within `times` reaches of b; e: the differences."""
    close = _within(pairs, classes, percent, times)
    wanted = held(close.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    sets = _sets(docs, classes, wanted, width)
    forget(wanted)

    @F.pandas_udf("array<long>")
    def differences(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([np.setxor1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), assume_unique=True) for a, b in zip(x, y, strict=True)], dtype=object)

    hot = _hot_sides(close)
    joined = join_hot(join_hot(close, sets.toDF("a", "xa"), "a", hot=hot["a"]), sets.toDF("b", "xb"), "b", hot=hot["b"]).select("a", "b", "na", "nb", differences("xa", "xb").alias("e"))
    with small_batches(docs.sparkSession, PAIRS):
        found = settled(joined.withColumn("d", F.size("e").cast("long")).where(percent * F.col("d") <= times * (100 - percent) * F.col("nb")))
    forget(close)
    forget(sets)
    return found


def _linked(percent: int) -> Column:
    """Whether sets of sizes na and nb at distance d have a similarity of percent / 100 or more."""
    both = (F.col("na") + F.col("nb") - F.col("d")) / 2
    return 100 * both >= percent * (F.col("na") + F.col("nb") - both)


def _joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Roots (c, root) after more links (a, b): only what the links touch is looked at again."""
    if links.isEmpty():
        return roots
    if roots is None:
        return components(links).select(F.col("node").alias("c"), "root")
    for side in "ab":
        known = roots.select(F.col("c").alias(side), F.col("root").alias("__r"))
        links = links.join(known, side, "left").select(F.coalesce("__r", side).alias(side), "b" if side == "a" else "a")
    moved = components(links)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("__r")), "root", "left").select("c", F.coalesce("__r", "root").alias("root"))
    return settled(old.unionByName(moved.select(F.col("node").alias("c"), "root")).dropDuplicates(["c"]))


def _with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("c"))
    return join_small(rows, roots, ["c"]).withColumn("root", F.coalesce("root", "c"))


def _alive(rows: DataFrame) -> tuple[DataFrame | None, list]:
    """The rows of regions r where a set that must be compared (must) may still meet one of another component, settled, and the hot regions; None without any."""
    rows = held(rows)
    regions = held(rows.groupBy("r").agg(F.count("*").alias("k"), F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.col("must").cast("int")).alias("any")).where("low < high and any = 1").select("r", "k"))
    hot, total = hot_keys(regions, "r")
    left = settled(join_hot(rows, regions, "r", hot=hot.get(None, [])).drop("k")) if total.get(None) else None
    forget(rows)
    forget(regions)
    return left, hot.get(None, [])


def _rounds(rows: DataFrame, roots: DataFrame | None, percent: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Roots after every must row of a region r has met all others there, by pivots chosen among the must rows.

    rows: f (the frame), r, c, n, must. compare takes distinct pairs (f, a, b, and their sizes na, nb) and gives the links (a, b) among them. A region
    that becomes one component is done. Pivots are the greatest ids of hashed slots, so no region is ever gathered or sorted.
    """
    slots, spent = MORE, []
    while True:
        rows, hot = _alive(_with_roots(rows, roots))
        for used in spent:
            forget(used)
        if rows is None:
            return roots
        slot = F.pmod(F.xxhash64("c"), F.lit(slots)).alias("slot")
        chosen = held(rows.where("must").groupBy("f", "r", slot).agg(F.max(F.struct("c", "root", "n")).alias("p")).select("r", F.col("p.c").alias("p"), F.col("p.root").alias("rp"), F.col("p.n").alias("np")))
        met = join_hot(rows, chosen, "r", hot=hot).where((F.col("c") != F.col("p")) & (F.col("root") != F.col("rp")) & _fits(F.col("n"), F.col("np"), percent))
        first = F.col("c") > F.col("p")
        sizes = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(k) for k, x, y in (("na", "n", "np"), ("nb", "np", "n"))]
        pairs = held(met.select("f", F.greatest("c", "p").alias("a"), F.least("c", "p").alias("b"), *sizes).distinct())
        links = compare(pairs)
        roots = _joined_roots(roots, links)
        forget(pairs)
        spent = [chosen, links]
        done = chosen.select("r", F.col("p").alias("c"), F.lit(True).alias("__done"))
        rows = rows.join(done, ["r", "c"], "left").withColumn("must", F.col("must") & F.col("__done").isNull()).drop("__done", "root")
        slots *= MORE


def _differences_joined(near: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame | None:
    """Roots after the sets of every pivot's region are joined by their differences from it (near: p, c, np, n, d, e, linked).

    A set that the pivot doesn't link and any other set y that is linked with it share a difference: without one,
    d(x) + d(y) <= k (|x| + |y|) and d(x) > k (|x| + |p|), k = (1 - t) / (1 + t) < 1, would give d(y) < k (|y| - |p|) <= k d(y).
    By the same sums it shares d(x) - reach(x) of them at least, and y more than (d(y) - k max(0, |y| - |p|)) / 2 of its own.
    """
    far = held(near.where(~F.col("linked")).select("p").distinct())
    near = settled(near.join(_small(far), "p", "left_semi"))
    k = (100 - percent) / (100 + percent)
    rest = F.col("d") - F.floor((F.col("d") - k * F.greatest(F.lit(0), F.col("n") - F.col("np"))) / 2 - 1e-9)
    wide = F.least(F.col("d"), F.floor(F.col("n") * (100 - percent) / percent + 1e-9) + 1)
    placed = settled(near.select("p", "c", "n", F.when(F.col("linked"), rest).otherwise(wide).alias("prefix"), (~F.col("linked")).alias("must"), F.explode("e").alias("s")))
    often = held(placed.groupBy("p", "s").agg(F.count("*").alias("k"), F.max("must").alias("any")).withColumn("r", F.xxhash64("p", "s")))
    ranked = join_hot(placed.withColumn("r", F.xxhash64("p", "s")), often.select("p", "s", "k", "any", "r"), "r", extra=("p", "s"), hot=hot_keys(often, "r")[0].get(None, []))
    ranked = ranked.withColumn("at", F.row_number().over(W.partitionBy("p", "c").orderBy("k", "s"))).where("at <= prefix and k > 1 and any")
    rows = ranked.select(F.col("p").alias("f"), "r", "c", "n", "must")

    @F.pandas_udf("long")
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype="int64")

    def compare(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            own = near.select(F.col("p").alias("f"), F.col("c").alias(side), F.col("e").alias(f"e{side}"))
            pairs = pairs.join(own, ["f", side])
        found = pairs.withColumn("d", F.size("ea") + F.size("eb") - 2 * shared("ea", "eb"))
        return held(found.where(_linked(percent)).select("a", "b"))

    return _rounds(rows, roots, percent, compare)


def _roots(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(c, root) of all linked classes."""
    met = _first_cut(classes)
    pairs = met.where("c <> p").select(F.col("p").alias("a"), F.col("c").alias("b"), F.col("np").alias("na"), F.col("n").alias("nb"))
    near = _compared(docs, classes, pairs, width, percent, 2).withColumn("linked", _linked(percent))
    near = near.select(F.col("a").alias("p"), F.col("b").alias("c"), F.col("na").alias("np"), F.col("nb").alias("n"), "d", "e", "linked")
    roots = _joined_roots(None, near.where("linked").select(F.col("p").alias("a"), F.col("c").alias("b")))
    roots = _differences_joined(near, roots, percent)
    # beyond a pivot's region; within it, whom it holds by less than t reaches is out of reach of those beyond
    inner = near.select("p", "c", (100 * F.col("d") <= (100 - percent) * F.col("n")).alias("held"))
    rest = met.where("c <> p").join(inner, ["p", "c"], "left").where("held is null or not held")
    rest = rest.select(F.lit(0).cast("long").alias("f"), F.col("s").alias("r"), "c", "n", F.col("held").isNull().alias("must"))

    def compare(far: DataFrame) -> DataFrame:
        return held(_compared(docs, classes, far, width, percent, 1).where(_linked(percent)).select("a", "b"))

    roots = _rounds(rest, roots, percent, compare)
    forget(met)
    return docs.sparkSession.createDataFrame([], "c long, root long") if roots is None else roots


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest doc_id that links lead to.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets. Null or empty
    texts and those without words have no shingles and are linked with nothing; rows that repeat an id are each
    judged by their own text, so components that hold one id may have one name; a null id is never anyone's component, and alone it has itself (null);
    an empty table gives no rows; other columns are ignored. Texts are never shuffled while the sets that
    meet others are few enough to be asked for by broadcast; copies are counted in slices of their class.
    """
    own = _measured(docs, width, percent)
    found = _classes(own)
    ids = settled(own.select("doc_id", F.col("n").alias("n_shingles"), "digest"))
    forget(own)
    roots = _roots(docs, found, width, percent)
    named = settled(roots.join(found.select("c", "digest"), "c").select("digest", "root"))
    lone = ids.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # a component of one class has the class for its root
    full = join_small(ids.where("digest is not null"), named, ["digest"]).withColumn("root", F.coalesce(F.col("root").cast("string"), F.hex("digest")))
    full = salted_group_min(full, ["root"], "doc_id", "component_id", unique="doc_id")
    return full.select("doc_id", "n_shingles", "component_id").unionByName(lone)


def unique_documents(docs: DataFrame, width: int = STAGE_WIDTH, percent: int = STAGE_PERCENT) -> DataFrame:
    """One row of each component, with its own columns: that of smallest id, null ids last.

    Rows of one id are told apart by a hash of their texts, then by a row key that is written before it is
    used; so rows that repeat an id are copies where their texts are linked, and documents of their own where not.
    Rows without shingles are linked with nothing and all stay.
    """
    rows = settled(docs.select(F.monotonically_increasing_id().alias("__k"), F.struct(*[docs[c] for c in docs.columns]).alias("row")))
    found = settled(classes(rows.select(F.col("__k").alias("doc_id"), F.col("row.text").alias("text")), width, percent).select(F.col("doc_id").alias("__k"), F.col("component_id").alias("__c")))
    several = settled(found.where("__k <> __c").select("__c").distinct())
    members = found.join(_small(several), "__c", "left_semi")
    doc_id = F.col("row.doc_id").cast("long")
    at = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("text"), F.col("__k").alias("k"))
    members = settled(rows.select("__k", at.alias("__at")).join(_small(members), "__k"))
    dropped = settled(salted_group_min(members, ["__c"], "__at", "__least", unique="__k").where("__k <> __least.k").select("__k"))
    return rows.join(_small(dropped), "__k", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
