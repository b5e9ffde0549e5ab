"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Rows are dealt into shards of a fixed size by a hash. In a shard, every vector searches the graph greedily for what is near
it; relaxed distance pruning keeps of those an edge to the nearest, drops what the nearest is closer to (by a factor), and
goes on with the rest, so that edges point into all directions. Edges are made both ways and pruned again where a vector has
too many. A query walks each shard's graph with a beam from the shard's middle; the candidates of all shards are compared by
exact distances. The graph is a table of rows that can be kept and searched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_batches, settled, table

#: Rows of a shard (about), out-edges of a vector, width of the beam that builds and of the one that asks, factors of the two passes.
SHARD, DEGREE, BUILD_BEAM, BEAM, FACTORS = 8192, 32, 64, 128, (1.0, 1.2)
#: Neighbours that a query gets, and vectors that walk the graph together.
NEAREST, TOGETHER = 10, 256
#: Beam entries whose edges are followed in one step.
FOLLOWED = 4


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Graph:
    """Vectors of a shard (distinct, scaled to at most 1) and their out-edges; -1 where a vector has fewer."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, start: int):
        self.vectors, self.edges, self.start = vectors, edges, start

    def walk(self, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of asked the beam that a greedy search ends with: places (-1 behind the last) and squared distances, nearest first."""
        m, n, width = len(asked), len(self.vectors), self.edges.shape[1]
        place = np.full((m, beam), -1, np.int64)
        far = np.full((m, beam), np.inf, np.float32)
        done = np.zeros((m, beam), bool)  # whose edges have been followed
        met = np.zeros((m, n), bool)
        stamp = np.zeros((m, n), np.int32)
        place[:, 0], far[:, 0], met[:, self.start] = self.start, squared(asked, self.vectors[self.start]), True
        live = np.arange(m)
        while len(live):
            todo = ~done[live] & (place[live] >= 0)
            todo &= np.cumsum(todo, 1) <= FOLLOWED
            live, todo = live[todo.any(1)], todo[todo.any(1)]
            if not len(live):
                break
            row, at = np.nonzero(todo)
            done[live[row], at] = True
            to = self.edges[place[live[row], at]].reshape(-1)
            row = np.repeat(row, width)
            new = (to >= 0) & ~met[live[row], to]
            row, to = row[new], to[new]
            stamp[live[row], to] = np.arange(len(row))  # of equal ones the last stays
            new = stamp[live[row], to] == np.arange(len(row))
            row, to = row[new], to[new]
            met[live[row], to] = True
            if not len(row):
                continue
            d = squared(asked[live[row]], self.vectors[to])
            count = np.bincount(row, minlength=len(live))
            slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)  # row is in order
            both_place, both_far = np.full((len(live), beam + count.max()), -1, np.int64), np.full((len(live), beam + count.max()), np.inf, np.float32)
            both_done = np.zeros(both_far.shape, bool)
            both_place[:, :beam], both_far[:, :beam], both_done[:, :beam] = place[live], far[live], done[live]
            both_place[row, beam + slot], both_far[row, beam + slot] = to, d
            best = np.argsort(both_far, 1, kind="stable")[:, :beam]
            place[live], far[live], done[live] = (np.take_along_axis(x, best, 1) for x in (both_place, both_far, both_done))
        return place, far

    def pruned(self, own: np.ndarray, places: np.ndarray, factor: float) -> np.ndarray:
        """Edges for the vectors `own` from candidates (a row each, -1: none): the nearest stays, what it is closer to by the factor goes, and so on."""
        degree = self.edges.shape[1]
        places = np.sort(places, 1)
        places[:, 1:][places[:, 1:] == places[:, :-1]] = -1
        places[places == own[:, None]] = -1
        vectors = self.vectors[places]
        d = vectors - self.vectors[own][:, None]
        far = np.where(places >= 0, np.einsum("ijk,ijk->ij", d, d), np.inf)
        order = np.argsort(far, 1, kind="stable")
        places, far = np.take_along_axis(places, order, 1), np.take_along_axis(far, order, 1)
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        norm = np.einsum("ijk,ijk->ij", vectors, vectors)
        between = norm[:, :, None] + norm[:, None] - 2 * (vectors @ vectors.transpose(0, 2, 1))
        alive, rows = places >= 0, np.arange(len(own))
        out = np.full((len(own), degree), -1, np.int64)
        for k in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            out[:, k] = np.where(some, places[rows, first], -1)
            alive[rows, first] = False
            alive &= factor**2 * between[rows, first] > far
        return out

    def joined(self, own: np.ndarray, factor: float) -> None:
        """Gives the vectors that own points to the edges back; those with too many are pruned."""
        degree = self.edges.shape[1]
        source, target = np.repeat(own, degree), self.edges[own].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        known = (self.edges[target] == source[:, None]).any(1)
        source, target = source[~known], target[~known]
        near = squared(self.vectors[source], self.vectors[target])
        order = np.lexsort((near, target))
        source, target = source[order], target[order]
        to, first, count = np.unique(target, return_index=True, return_counts=True)
        slot = np.arange(len(target)) - np.repeat(first, count)
        ok = slot < 2 * degree  # of very many new edges to one vector the nearest are candidates
        added = np.full((len(to), min(2 * degree, count.max(initial=0))), -1, np.int64)
        added[np.repeat(np.arange(len(to)), count)[ok], slot[ok]] = source[ok]
        have = (self.edges[to] >= 0).sum(1)
        fits = have + count <= degree
        if fits.any():
            both = np.concatenate([self.edges[to[fits]], added[fits]], 1)
            self.edges[to[fits]] = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)[:, :degree]
        for i in range(0, (~fits).sum(), TOGETHER):
            part = np.flatnonzero(~fits)[i : i + TOGETHER]
            self.edges[to[part]] = self.pruned(to[part], np.concatenate([self.edges[to[part]], added[part]], 1), factor)


def scale_of(vectors: np.ndarray) -> float:
    return float(np.abs(vectors).max(initial=0)) or 1.0


def graph_of(vectors: np.ndarray, seed: int, degree: int = DEGREE, beam: int = BUILD_BEAM) -> Graph:
    """A graph of distinct vectors, from random edges: each vector in two passes searches, prunes what it met and is linked back. The same input gives the same graph."""
    n, rng = len(vectors), np.random.default_rng(seed)
    small = (vectors / scale_of(vectors)).astype(np.float32)
    edges = rng.integers(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = -1
    graph = Graph(small, edges, int(squared(small, small.mean(0)).argmin()))
    for factor in FACTORS:
        order = rng.permutation(n)
        for i in range(0, n, TOGETHER):
            own = order[i : i + TOGETHER]
            place, _ = graph.walk(small[own], beam)
            graph.edges[own] = graph.pruned(own, np.concatenate([place, graph.edges[own]], 1), factor)
            graph.joined(own, factor)
    return graph


def _clean(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, each pair once."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).distinct()


INDEX = "dim long, shard long, node long, vec_ids array<bigint>, embedding array<double>, edges array<bigint>, start boolean"


def _sharded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of one (dim, shard) after another, of batches that are in that order; one shard is held."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for key, part in batch.groupby(["dim", "shard"], sort=True):
            if held and held[0][0] != key:
                yield held[0][0], pd.concat([p for _, p in held])
                held = []
            held.append((key, part))
    if held:
        yield held[0][0], pd.concat([p for _, p in held])


def index(rows: DataFrame, shard_rows: int = SHARD, degree: int = DEGREE, beam: int = BUILD_BEAM, ids: int = NEAREST + 1) -> DataFrame:
    """The graphs of all vectors: dim, shard, node, vec_ids, embedding, edges (nodes of the shard), start.

    Equal vectors of a shard are one node, whose vec_ids are the smallest `ids` of theirs: as many as a query for
    ids - 1 neighbours beside itself can need. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without an id, take no part; repeated rows count once; an id may have several vectors. Vectors of
    other dimensions are in other shards. An empty table gives no rows. A task holds one shard.
    """
    clean = settled(_clean(rows))
    shards = max(1, -(-clean.count() // shard_rows))
    dealt = clean.select(F.size("embedding").cast("long").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(shards)).alias("shard"), "vec_id", "embedding")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (dim, shard), part in _sharded(batches):
            vectors, node = np.unique(np.stack(part["embedding"].to_list()), axis=0, return_inverse=True)
            of = pd.Series(part["vec_id"].astype("int64").to_numpy()).groupby(node.reshape(-1)).agg(lambda x: sorted(set(x))[:ids])
            graph = graph_of(vectors, int(shard), degree, beam)
            for i in range(0, len(vectors), 1024):
                nodes = range(i, min(i + 1024, len(vectors)))
                yield pd.DataFrame({"dim": dim, "shard": shard, "node": nodes, "vec_ids": of.iloc[nodes].to_list(), "embedding": list(vectors[nodes]), "edges": [e[e >= 0] for e in graph.edges[nodes]], "start": [k == graph.start for k in nodes]})

    ordered = dealt.repartition(min(tasks, shards), "dim", "shard").sortWithinPartitions("dim", "shard", "vec_id", "embedding")
    return by_batches(ordered, build, INDEX, ids=("vec_id",))


FOUND = "query_id long, vec_id long, score double"


def search(graphs: DataFrame, queries: DataFrame, nearest: int = NEAREST, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of an index() to each query (vec_id, embedding) but its own id's.

    Every query asks every shard of its dimension; ties go to the smaller vec_id. A query that has no vector by the
    rules of index() gets no rows; of several vectors of one id, asked or found, the nearest pair counts.
    A shard is one task's, with its queries in batches; at most `nearest` rows a query and shard meet.
    """
    last = graphs.groupBy("dim").agg(F.max("shard").alias("last"))  # a row a dimension
    last = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last
    asked = _clean(queries).withColumn("dim", F.size("embedding").cast("long")).join(last, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    empty = {"node": "long", "vec_ids": "array<bigint>", "edges": "array<bigint>", "start": "boolean"}
    rows = asked.select("dim", "shard", F.lit(1).alias("asks"), "vec_id", "embedding", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    nodes = graphs.select("dim", "shard", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("vec_id"), "embedding", *empty)
    tasks = int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = nodes.unionByName(rows).repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "asks", "node", "vec_id")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts, graph, vectors, owners, scale = None, [], None, None, None, 1.0
        for batch in batches:
            for (dim, shard, asks), part in batch.groupby(["dim", "shard", "asks"], sort=True):
                if (dim, shard) != key:
                    key, parts, graph = (dim, shard), [], None
                if not asks:
                    parts.append(part)
                    continue
                if graph is None and not parts:
                    continue  # a shard that no vector fell into
                if graph is None:
                    whole = pd.concat(parts)
                    vectors, owners = np.stack(whole["embedding"].to_list()), [np.asarray(x, np.int64) for x in whole["vec_ids"]]
                    edges = np.full((len(whole), max(1, max(map(len, whole["edges"])))), -1, np.int64)
                    for k, e in enumerate(whole["edges"]):
                        edges[k, : len(e)] = e
                    scale, parts = scale_of(vectors), []
                    graph = Graph((vectors / scale).astype(np.float32), edges, int(np.flatnonzero(whole["start"])[0]))
                ids, points = part["vec_id"].astype("int64").to_numpy(), np.stack(part["embedding"].to_list())
                for i in range(0, len(ids), TOGETHER):
                    yield _answers(graph, vectors, owners, ids[i : i + TOGETHER], points[i : i + TOGETHER], scale, nearest, beam)

    found = by_batches(together, ask, FOUND, ids=("query_id", "vec_id"))
    pairs = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _answers(graph: Graph, vectors: np.ndarray, owners: list[np.ndarray], ids: np.ndarray, points: np.ndarray, scale: float, nearest: int, beam: int) -> pd.DataFrame:
    place, _ = graph.walk((points / scale).astype(np.float32), beam)
    out = []
    for k, own in enumerate(ids.tolist()):
        at = place[k][place[k] >= 0]
        score = np.sqrt(((vectors[at] - points[k]) ** 2).sum(1))
        names = [owners[a] for a in at]
        score, vec = np.repeat(score, list(map(len, names))), np.concatenate(names)
        score, vec = score[vec != own], vec[vec != own]
        best = np.lexsort((vec, score))[:nearest]
        out.append(pd.DataFrame({"query_id": own, "vec_id": vec[best], "score": score[best]}))
    return pd.concat(out).astype({"query_id": str, "vec_id": str})


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(settled(index(rows)), rows.where(F.col("vec_id") % 100 == 0))
