"""Byte-level BPE through a minimal acyclic transducer.

The corpus's frequent words, with the ids that merging gives them, are compiled into the smallest acyclic
automaton that shares prefixes and suffixes; the numbers on a word's arcs add up to its place in the list of
outputs. Its arrays are memory-mapped by the executors' workers and walked for all new words of a batch in
step; words outside the lexicon are merged exactly. Encoding and decoding equal the tokenizers library's.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, forget, settled, shared_file, table

#: Words in the lexicon: the most frequent of the whole corpus. Others are merged, so no result depends on it.
LEXICON = 32_768
#: Words that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: The pattern that splits text before the merges of byte-level vocabularies (fixed value, Unicode white space spelt out).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def _members(test, end: int = 0x250) -> str:
    return "".join(re.escape(chr(c)) for c in range(end) if test(unicodedata.category(chr(c))[0]))


#: The same split for texts of these characters alone, which the standard library's engine does twice as fast.
_L, _N = _members(lambda k: k == "L"), _members(lambda k: k == "N")
SIMPLE = re.compile("[\t\n\r -~\xa0-ɏ]*")
_SPLIT_SIMPLE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


def split(text: str) -> list[str]:
    return (_SPLIT_SIMPLE if SIMPLE.fullmatch(text) else SPLIT).findall(text)


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable ones stand for themselves, others follow 255."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary file's ids, merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        chars = _byte_chars()
        vocab = made["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in made["added_tokens"])]) + 1)
        for token, i in vocab.items():
            if all(c in chars for c in token):
                self.bytes[i] = bytes(chars[c] for c in token)
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = {b: vocab[c] for c, b in chars.items()}
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(made["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pair.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of least rank, leftmost first, is merged until none is left."""
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self._merged_long(ids)
        pair, top = self.pair, (1 << 60, 0)
        ranks = [pair.get(p, top) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is top or best[0] == top[0]:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = pair.get((ids[i - 1], ids[i]), top)
            if i < len(ranks):
                ranks[i] = pair.get((ids[i], ids[i + 1]), top)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, n log n for words of any length."""
        n = len(ids)
        after, before, heap = [*range(1, n + 1)], [*range(-1, n - 1)], []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pair.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]


def compiled(words: Iterable[tuple[bytes, list[int]]]) -> np.ndarray:
    """The minimal acyclic transducer of (word, ids), as one array of 64-bit integers that can be mapped.

    Words are added in byte order. A state is frozen when no later word can change it: one with the same
    finality and arcs takes its place, so that suffixes are shared. Arcs then carry how many words of
    their state come before them, which makes every word's sum its place in the outputs.
    """
    words = sorted({w: ids for w, ids in words if w}.items())
    final, arcs = [0], [{}]
    register: dict[tuple, int] = {}
    path, last = [0], b""

    def freeze(down_to: int) -> None:
        while len(path) > down_to + 1:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][last[len(path) - 1]] = register.setdefault(key, state)

    for word, _ in words:
        common = len(os.path.commonprefix([word, last]))
        freeze(common)
        for b in word[common:]:
            final.append(0)
            arcs.append({})
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = 1
        last = word
    freeze(0)
    number, order = {0: 0}, [0]
    for state in order:
        for target in arcs[state].values():
            if target not in number:
                number[target] = len(number)
                order.append(target)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [t for t in arcs[state].values() if t not in below]
        stack.extend(todo)
        if not todo:
            below[stack.pop()] = final[state] + sum(below[t] for t in arcs[state].values())
    keys, targets, adds = [], [], []
    for state in order:
        before = final[state]
        for b, target in sorted(arcs[state].items()):
            keys.append(number[state] << 8 | b)
            targets.append(number[target])
            adds.append(before)
            before += below[target]
    flat = [i for _, ids in words for i in ids]
    ends = np.cumsum([0, *(len(ids) for _, ids in words)])
    parts = [keys, targets, adds, [final[s] for s in order], ends, flat]
    return np.concatenate([np.array([len(p) for p in parts], np.int64), *(np.asarray(p, np.int64) for p in parts)])


class Lexicon:
    """Looks words up in a compiled() array, all of a batch in step."""

    def __init__(self, data: np.ndarray):
        at, parts = 6, []
        for n in data[:6]:
            parts.append(data[at : at + int(n)])
            at += int(n)
        self.keys, self.targets, self.adds, self.final, self.ends, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the outputs, -1 if it isn't in the lexicon."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(words), np.uint8)
        alive = np.flatnonzero(sizes)
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            want = state[alive] << 8 | flat[starts[alive] + step]
            found = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[found] == want
            alive, found = alive[hit], found[hit]
            state[alive] = self.targets[found]
            total[alive] += self.adds[found]
            step += 1
            done = sizes[alive] == step
            ended = alive[done]
            ok = ended[self.final[state[ended]] == 1]
            out[ok] = total[ok]
            alive = alive[~done]
        return out


class Encoder:
    """Texts to ids and back, by a lexicon and exact merges."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon, self.known = merges, lexicon, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        ids, ends = self.lexicon.ids, self.lexicon.ends
        for word, data, place in zip(new, raw, self.lexicon.places(raw).tolist(), strict=True):
            found = ids[ends[place] : ends[place + 1]] if place >= 0 else self.merges.merged(data)
            self.known[word] = np.asarray(found, "<u4").tobytes()

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = self.merges.cut
        parts = [[(p, p in self.merges.special) for p in cut.split(t) if p] if cut and cut.search(t) else [(t, False)] for t in texts]
        words = [[None if special else split(p) for p, special in text] for text in parts]
        self.learn({w for text in words for part in text if part for w in part})
        for text, found in zip(parts, words, strict=True):
            out = []
            for (part, special), own in zip(text, found, strict=True):
                out.append(np.asarray([self.merges.special[part]], "<u4").tobytes() if special else b"".join(map(self.known.__getitem__, own)))
            yield b"".join(out)

    def decoded(self, ids: bytes) -> str:
        return b"".join(map(self.merges.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The most frequent words of all texts, `most` at most: as many classes of like counts as that has room for.

    Words are counted per task first, then by a shuffle of counts; no task and not the driver sees more than the words it returns.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(split(text))
                if len(counts) > REMEMBERED:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts = Counter()
        if counts:  # a frame without words would have no text column
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    words = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(counted, "word string, n long")
    counts = settled(words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("step", F.floor(64 * F.log2("n")).cast("int")))
    steps = sorted(((r["step"], r["k"]) for r in counts.groupBy("step").agg(F.count("*").alias("k")).collect()), reverse=True)  # 64 a power of two
    total, low = 0, None
    for step, k in steps:
        total += k
        if total > most:
            break
        low = step
    found = [] if low is None else [r["word"] for r in counts.where(F.col("step") >= low).select("word").collect()]  # `most` rows
    forget(counts)
    return found


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    """A worker's encoder, kept between tasks; the lexicon's arrays are mapped, not read."""
    if (vocabulary, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary, lexicon] = Encoder(Merges(vocabulary), Lexicon(np.load(SparkFiles.get(lexicon), mmap_mode="r")))
    return _ENCODERS[vocabulary, lexicon]


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Characters that are encoded together.
BLOCK = 4_000_000


def round_trip(docs: DataFrame, vocabulary: str, most: int = LEXICON) -> DataFrame:
    """Encodes every whole text and decodes it again: number and digest of the ids, digest of the decoded text.

    A null text is empty; null ids and repeated rows stay; an empty table gives no rows; columns other than
    doc_id and text are ignored. vocabulary is the path of a byte-level vocabulary file that every worker has.
    """
    merges = Merges(vocabulary)
    data = compiled((w.encode("utf-8", "surrogatepass"), merges.merged(w.encode("utf-8", "surrogatepass"))) for w in frequent_words(docs, most))
    made = io.BytesIO()
    np.save(made, data)
    name = f"lexicon-{hashlib.sha256(data.tobytes()).hexdigest()[:24]}.npy"
    # a few MB, fetched once by each executor; the path follows from the content, so a later run registers the same one
    docs.sparkSession.sparkContext.addFile(shared_file(docs.sparkSession, name, made.getvalue()))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, name)
        for batch in batches:
            block = (batch["text"].str.len().cumsum() // BLOCK).to_numpy()
            for b in np.unique(block):
                part, out = batch[block == b], []
                for ids in encoder.encoded(part["text"].tolist()):
                    text = encoder.decoded(ids).encode("utf-8", "surrogatepass")
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
                done = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                done.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield done

    return by_batches(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rows, ROUND_TRIP)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
