"""Toxicity by a bidirectional gated recurrent network over character and word inputs, in numpy.

A word's input is its own embedding beside the maximum over the embeddings of its character n-grams. Two
gated recurrent passes read windows of words, attention pools their states, and a logistic output scores the
window. A text's score is that of its worst window; windows overlap by half and cover all of it. Training sees
a bounded sample of labelled texts, of which only the worst window learns in each round.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, table

#: Most labelled texts that training sees: those of least hash of their id.
SAMPLE = 5000
#: Words of a window and between the starts of two.
WINDOW, STRIDE = 32, 16
#: Sizes: word and character embeddings, hidden states of a direction, attention.
WORD_DIMS, CHAR_DIMS, HIDDEN, ATTENTION = 4, 8, 8, 8
#: Lengths of the character n-grams (bytes, word borders included), and texts that one must occur in to have an embedding.
GRAMS, LEAST_TEXTS = (3, 4, 5, 6), 3
#: Bytes of a word; longer ones are several.
LONGEST = 64
EPOCHS, STEPS, BATCH, RATE = 3, 250, 64, 0.05
#: Words that a worker remembers, windows that it scores together, and words whose n-grams it has in hand at once.
REMEMBERED, BLOCK, PART = 300_000, 2048, 8192
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """The words of a text; one of more than LONGEST bytes is cut into parts that overlap, so that no n-gram is lost."""
    found = _WORD.findall((text or "").lower())
    if all(4 * len(w) <= LONGEST for w in found):
        return found
    return [part for w in found for part in _parts(w)]


def _parts(word: str) -> list[str]:
    if 4 * len(word) <= LONGEST or len(word.encode("utf-8", "surrogatepass")) <= LONGEST:
        return [word]
    size, shared = LONGEST if word.isascii() else LONGEST // 4, max(GRAMS) - 1
    return [word[i : i + size] for i in range(0, len(word) - shared, size - shared)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of all words, and where each word's begin; every word has one at least."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(first, sizes)
    left = np.repeat(sizes, sizes) - place
    owner = np.repeat(np.arange(len(raw)), sizes)
    hashes, owners = [], []
    rolling = np.zeros(len(flat), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.concatenate([flat[n - 1 :], np.zeros(min(n - 1, len(flat)), np.uint64)])  # a lone short word has fewer bytes than the longest n-gram
        rolling = rolling * np.uint64(0x100000001B3) + shifted
        if n in GRAMS or n == 2:
            ok = left >= n if n in GRAMS else (left >= n) & (np.repeat(sizes, sizes) == 2)
            h = (rolling[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            hashes.append(h ^ (h >> np.uint64(32)))
            owners.append(owner[ok])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return h[order], np.searchsorted(o[order], np.arange(len(raw)))


def windows(n: int) -> list[int]:
    """Starts of the windows of a text of n words: all of it is covered, the last one ends with it."""
    return [*range(0, max(1, n - WINDOW), STRIDE), n - WINDOW] if n > WINDOW else [0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 * _sigmoid(2 * x) - 1


class Network:
    """Parameters by name; the vocabularies say which rows of `words` and `chars` a word reads."""

    def __init__(self, vocabulary: dict[str, int], gram_keys: np.ndarray, word_prior: np.ndarray, gram_prior: np.ndarray):
        rng = np.random.default_rng(0)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        d = WORD_DIMS + CHAR_DIMS
        self.vocabulary, self.gram_keys = vocabulary, gram_keys
        self.p = {"words": small(len(word_prior), WORD_DIMS), "chars": small(len(gram_prior), CHAR_DIMS)}
        # what counts say about a word or an n-gram is where training starts
        self.p["words"][:, 0], self.p["chars"][:, 0] = word_prior, gram_prior
        for way in "fb":
            self.p |= {f"W{way}": small(d, 3 * HIDDEN) * 3, f"U{way}": small(HIDDEN, 3 * HIDDEN) * 3, f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
            self.p[f"c{way}"][:HIDDEN] = -1  # keeps what it has
        self.p |= {"A": small(2 * HIDDEN, ATTENTION) * 3, "a": small(ATTENTION) * 3, "o": small(2 * HIDDEN) * 3, "z": np.full(1, -1, np.float32)}

    def reads(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of `words`, of `chars` (0: none known), and where each word's n-grams begin."""
        h, first = grams(words)
        at = np.minimum(np.searchsorted(self.gram_keys, h), len(self.gram_keys) - 1)
        return np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words)), np.where(self.gram_keys[at] == h, at + 1, 0), first

    def inputs(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.embedded(*self.reads(words[i : i + PART])) for i in range(0, len(words), PART)])

    def embedded(self, own: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The inputs of words that read these rows."""
        return np.concatenate([self.p["words"][own], np.maximum.reduceat(self.p["chars"][chars], first)], 1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What both directions read of words, before any state."""
        return np.concatenate([x @ self.p[f"W{w}"] + self.p[f"c{w}"] for w in "fb"], 1)

    def _pass(self, gates: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        u, h = self.p[f"U{way}"], np.zeros((len(gates), HIDDEN), np.float32)
        out = np.empty((len(gates), gates.shape[1], HIDDEN), np.float32)
        for t in range(gates.shape[1]) if way == "f" else range(gates.shape[1] - 1, -1, -1):
            x, s = gates[:, t], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = _tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            z = z * mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, c, s[:, 2 * HIDDEN :]))
            h = h + z * (c - h)
            out[:, t] = h
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Window scores from (windows, places, 6 * HIDDEN) projections; mask is 0 where a short window has no word."""
        steps: dict[str, list | None] = {w: [] if keep is not None else None for w in "fb"}
        half = gates.shape[2] // 2
        h = np.concatenate([self._pass(gates[:, :, :half], mask, "f", steps["f"]), self._pass(gates[:, :, half:], mask, "b", steps["b"])], 2)
        t = _tanh(h @ self.p["A"])
        e = t @ self.p["a"] + (mask - 1) * 1e4
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", w, h)
        if keep is not None:
            keep |= {"steps": steps, "h": h, "t": t, "w": w, "pooled": pooled}
        return _sigmoid(pooled @ self.p["o"] + self.p["z"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean cross entropy by parameter, and by input x (windows, places, dims)."""
        keep: dict = {}
        score = self.forward(self.projected(x.reshape(-1, x.shape[2])).reshape(*x.shape[:2], -1), mask, keep)
        p, g = self.p, {}
        d = ((score - label) / len(label)).astype(np.float32)
        g["o"], g["z"] = keep["pooled"].T @ d, d.sum(keepdims=True)
        dpooled = d[:, None] * p["o"]
        h, t, w = keep["h"], keep["t"], keep["w"]
        dh = w[:, :, None] * dpooled[:, None]
        dw = np.einsum("bth,bh->bt", h, dpooled)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["a"] = np.einsum("bt,bta->a", de, t)
        dt = de[:, :, None] * p["a"] * (1 - t * t)
        g["A"] = np.einsum("bth,bta->ha", h, dt)
        dh = dh + dt @ p["A"].T
        dx = np.zeros_like(x)
        for way, cut in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u, du, after = p[f"U{way}"], np.zeros_like(p[f"U{way}"]), np.zeros((len(x), HIDDEN), np.float32)
            gates = np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            for place, before, z, r, c, s in reversed(keep["steps"][way]):
                total = after + dh[:, place, cut]
                dc = total * z * (1 - c * c)
                m = mask[:, place, None]
                dz = total * (c - before) * z * (1 - z) * m
                dr = dc * s * r * (1 - r)
                ds = np.concatenate([dz, dr, dc * r], 1)
                gates[:, place] = np.concatenate([dz, dr, dc], 1)
                du += before.T @ ds
                after = total * (1 - z) + ds @ u.T
            g[f"U{way}"] = du
            flat = gates.reshape(-1, 3 * HIDDEN)
            g[f"W{way}"], g[f"c{way}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
            dx += gates @ p[f"W{way}"].T
        return g, dx


def _prior(found: Iterable[np.ndarray], n: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items (below n, each once a text) of at least LEAST_TEXTS texts, and the log odds that their texts are toxic, row 0 for all others."""
    counts = np.zeros((2, n), np.int64)
    for items, y in zip(found, labels, strict=True):
        counts[y, items] += 1
    kept = np.flatnonzero(counts.sum(0) >= LEAST_TEXTS)
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    odds = np.log((counts[1, kept] + 1) / (n1 + 2)) - np.log((counts[0, kept] + 1) / (n0 + 2))
    return kept, np.array([0, *odds], np.float32) / 3


class _Windows:
    """The windows of texts, as places in the words of all of them: a word is stored once, however many windows it is in."""

    def __init__(self, texts: Iterable[list[str]]):
        known: dict[str, int] = {"": 0}
        flat, starts, filled, counts = [], [], [], []
        end = 0
        for words in texts:
            ids = np.zeros(max(len(words), WINDOW), np.int32)
            ids[: len(words)] = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
            own = windows(len(words))
            flat.append(ids)
            starts += [end + s for s in own]
            filled += [min(WINDOW, max(1, len(words)))] * len(own)
            counts.append(len(own))
            end += len(ids)
        #: Distinct words, '' first; the words of all texts by their places in it, each text's filled up to a window.
        self.words, self.flat = list(known), np.concatenate(flat)
        #: Where each window starts, its words, and the text that it is of.
        self.starts, self.filled, self.owner = np.array(starts), np.array(filled, np.int8), np.repeat(np.arange(len(counts)), counts)

    def __getitem__(self, part) -> tuple[np.ndarray, np.ndarray]:
        """Word indices of some windows, and their mask."""
        places = np.arange(WINDOW)
        return self.flat[self.starts[part, None] + places], (places < self.filled[part, None]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.starts)

    def blocks(self) -> Iterator[slice]:
        """All windows, BLOCK at a time."""
        return (slice(i, i + BLOCK) for i in range(0, len(self), BLOCK))

    def texts(self) -> Iterator[np.ndarray]:
        """The distinct words of each text, as indices."""
        last = np.append(np.flatnonzero(np.diff(self.owner)), len(self) - 1)
        begin = 0
        for end in self.starts[last] + WINDOW:
            own = np.unique(self.flat[begin:end])
            yield own[own > 0]
            begin = end


def _known_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of words in order, those of each word as places among them, and where each word's begin."""
    parts, sizes = [], []
    for i in range(0, len(words), PART):
        h, first = grams(words[i : i + PART])
        own, at = np.unique(h, return_inverse=True)
        parts.append((own, at.astype(np.int32)))
        sizes.append(np.diff(np.append(first, len(h))))
    known, n = np.unique(np.concatenate([own for own, _ in parts])), np.concatenate(sizes)
    placed, begin = np.empty(n.sum(), np.int32), 0
    for own, at in parts:
        placed[begin : begin + len(at)] = np.searchsorted(known, own)[at]
        begin += len(at)
    return known, placed, np.cumsum(n) - n


def train(texts: list[str | None], labels: list[int], priors: bool = True) -> Network | None:
    """Fits a network; None where one of the labels is missing. Without priors no embedding starts from counts."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    met = _Windows(words_of(t) for t in texts)
    words, owner = met.words, met.owner
    texts_words = list(met.texts())
    kept_words, word_prior = _prior(texts_words, len(words), y)
    known, placed, first = _known_grams(words)
    last = np.append(first[1:], len(placed))

    def grams_of(own: np.ndarray) -> np.ndarray:
        """The distinct n-grams of some words, as places in known."""
        n = last[own] - first[own]
        return np.unique(placed[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])

    kept_grams, gram_prior = _prior(map(grams_of, texts_words), len(known), y)
    some = len(kept_grams) > 0
    if not priors:
        word_prior, gram_prior = 0 * word_prior, 0 * gram_prior
    net = Network({words[i]: k + 1 for k, i in enumerate(kept_words.tolist())}, known[kept_grams] if some else np.zeros(1, np.uint64), word_prior, gram_prior if some else np.zeros(2, np.float32))
    own = np.zeros(len(words), np.int32)
    own[kept_words] = np.arange(len(kept_words)) + 1
    row = np.zeros(len(known), np.int32)
    row[kept_grams] = np.arange(len(kept_grams)) + 1
    chars = row[placed]
    del known, placed, texts_words, row

    def by_word(made: Callable[[slice, slice, np.ndarray], np.ndarray]) -> np.ndarray:
        """made() of all words, PART at a time: the words, their n-grams, and where each word's begin among these."""
        return np.concatenate([made(slice(i, i + PART), slice(first[i], last[min(i + PART, len(words)) - 1]), first[i : i + PART] - first[i]) for i in range(0, len(words), PART)])

    speed = {k: np.zeros_like(v) for k, v in net.p.items()}
    rng = np.random.default_rng(1)

    def descend(name: str, at, grad: np.ndarray) -> None:
        """Steps that shrink with what a parameter has moved."""
        speed[name][at] += grad * grad
        net.p[name][at] -= RATE * grad / np.sqrt(speed[name][at] + 1e-8)

    weight = by_word(lambda w, g, begin: np.maximum(word_prior[own[w]], np.maximum.reduceat(gram_prior[chars[g]], begin))) if some else word_prior[own]
    score = np.concatenate([np.where(mask > 0, weight[rows], -9).max(1) for rows, mask in map(met.__getitem__, met.blocks())])
    # each text's worst window learns; the counts choose it at first, then the network itself
    for epoch in range(EPOCHS):
        if epoch:
            table = by_word(lambda w, g, begin: net.embedded(own[w], chars[g], begin))
            score = np.concatenate([scored(net, table, *met[part]) for part in met.blocks()])
        worst = np.lexsort((-score, owner))
        worst = worst[np.unique(owner[worst], return_index=True)[1]]
        chosen = np.concatenate([worst, rng.choice(np.flatnonzero(y[owner] == 0), len(worst) // 2)])
        rng.shuffle(chosen)
        for step in range(STEPS):
            part = chosen[np.arange(step * BATCH, (step + 1) * BATCH) % len(chosen)]
            rows, mask = met[part]
            used, inverse = np.unique(rows, return_inverse=True)
            vectors, winners = [], []
            for u in used:
                g = chars[first[u] : last[u]]
                e = net.p["chars"][g]
                best = e.argmax(0)
                winners.append(g[best])
                vectors.append(e[best, np.arange(CHAR_DIMS)])
            x = np.concatenate([net.p["words"][own[used]], np.array(vectors)], 1)[inverse.reshape(len(part), WINDOW)]
            grads, dx = net.gradients(x, mask, y[owner[part]])
            for name, grad in grads.items():
                descend(name, slice(None), grad)
            each = np.zeros((len(used), WORD_DIMS + CHAR_DIMS), np.float32)
            np.add.at(each, inverse.reshape(-1), dx.reshape(-1, each.shape[1]))
            descend("words", own[used], each[:, :WORD_DIMS])
            descend("chars", (np.array(winners), np.arange(CHAR_DIMS)), each[:, WORD_DIMS:])
            net.p["words"][0], net.p["chars"][0] = 0, 0
    return net


def scored(net: Network, table: np.ndarray, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Scores of windows of word indices into a table of inputs."""
    return net.forward(net.projected(table[rows.ravel()]).reshape(*rows.shape, -1), mask)


class Scorer:
    """A worker's network and the inputs of the words it has met."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.table = np.empty((0, WORD_DIMS + CHAR_DIMS), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.float32)
        met = _Windows(words_of(t) for t in texts)
        if len(self.known) > REMEMBERED:
            self.__init__(self.net)
        new = [w for w in met.words if w not in self.known]
        if new:
            start = len(self.known)
            self.known |= {w: start + i for i, w in enumerate(new)}
            if len(self.known) > len(self.table):
                self.table = np.concatenate([self.table[:start], np.empty((2 * len(self.known) - start, WORD_DIMS + CHAR_DIMS), np.float32)])
            self.table[start : len(self.known)] = self.net.inputs(new)
        at = np.fromiter(map(self.known.__getitem__, met.words), np.int64, len(met.words))
        out = np.zeros(len(texts), np.float32)
        for part in met.blocks():
            rows, mask = met[part]
            np.maximum.at(out, met.owner[part], scored(self.net, self.table, at[rows], mask))
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learned(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network | None:
    """A network from at most `most` labelled rows that aren't held out, trained by one task; None where one of the labels is missing."""
    return pickle.loads(_pickled(docs, labels, most))


def _pickled(docs: DataFrame, labels: DataFrame, most: int) -> bytes:
    """learned() as it comes from its task: the driver passes it on packed.

    An id that is labelled more than once is toxic if one of its labels says so; of several texts of an id, that of least hash is read.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(known), "doc_id")  # `most` ids
    sample = met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "toxic": []}), *batches]).sort_values("doc_id")
        model = pickle.dumps(train(rows["text"].tolist(), rows["toxic"].astype(int).tolist()))
        give_back()
        yield pd.DataFrame({"model": [model]})

    model = sample.repartition(1).mapInPandas(fit, "model binary").first()
    return pickle.dumps(None) if model is None else bytes(model["model"])


#: Characters of texts that are scored together.
CHARS = 2_000_000


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in slices of about CHARS characters, one at least: only a slice's texts are Python's at once, the others stay packed."""
    chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.append(np.flatnonzero(np.diff(chars.cumsum() // CHARS)) + 1, len(texts))
    for begin, end in zip([0, *ends], ends):
        yield texts.slice(begin, end - begin)


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, sample_of: DataFrame | None = None) -> DataFrame:
    """docs plus score (0 to 1), the worst window's; texts alone are read, no other column.

    sample_of (docs if not given) has the doc_id and text that labels refer to.

    A null or empty text is a window without words. Where labels lack one of the classes every score is 0.
    Null ids and repeated rows stay, other columns too; an empty table gives no rows. No shuffle of texts
    but that of the sample; the network is a few MB whatever the corpus.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_pickled(docs if sample_of is None else sample_of, labels, most))

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = pickle.loads(shared.value)
        scorer = net and Scorer(net)
        for batch in texts:
            if scorer is None:
                yield pa.array(np.zeros(len(batch)))
                continue
            yield pa.array(np.concatenate([scorer.scores(block.to_pylist()) for block in _blocks(batch)]).astype(float))

    return docs.withColumn("score", scores(F.col("text").cast("string")))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; rules for odd rows as in score()."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, labels).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
