"""The graph index against brute force: exact scores, ties, odd rows and recall."""

import numpy as np
import pytest

from kelpline.llm import neighbours

TABLES = "/root/testdata"


def brute(rows, asked, nearest=10):
    """The nearest of each query by exact distances; rows and queries as the operator cleans them."""
    fit = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and fit(v)]
    out = {}
    for own in {i for i, v in asked if i is not None and fit(v)}:
        best = {}
        for q in (np.array(v, float) for i, v in asked if i == own and fit(v)):
            for i, v in rows:
                if i != own and len(v) == len(q):
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
        if best:
            out[own] = sorted((d, i) for i, d in best.items())[:nearest]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for _, i in want[q]} & {i for _, i in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(100, [1.0, 2.0, 3.0, 4.0])] * 9 + [(7, [1.0, 2.0, 3.0, 4.5])]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 2.0, 3.0]), (204, [1.0, float("nan"), 2.0, 3.0]), (205, [float("inf")] * 4), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (400, [5.0]), (2**53 + 1, [1.0, 2.0, 3.0, 4.1]), (2**53 + 2, [1.0, 2.0, 3.0, 4.2])]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<double>, rank int, shard string").repartition(5)
    for shard_rows in (8192, 30):
        got = answers(neighbours.search(neighbours.index(table, shard_rows), table))
        assert got == brute(rows, rows)
    assert 400 not in got and [i for _, i in got[100]] == list(range(101, 111))
    empty = table.limit(0)
    assert neighbours.index(empty).collect() == []
    assert neighbours.search(neighbours.index(empty), table).collect() == [] == neighbours.search(neighbours.index(table), empty).collect()


def test_hot_vectors(spark):
    """A third of all rows are one vector, another third close around it."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([np.ones((500, 8)), 1 + 0.01 * rng.normal(size=(500, 8)), rng.normal(size=(500, 8))]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in rows if r[0] % 50 == 0]
    got, want = answers(neighbours.search(neighbours.index(table, 400), table.where("vec_id % 50 = 0"))), brute(rows, asked)
    assert recall(got, want) >= 0.98
    assert all(got[q] == want[q] for q in want if q < 500)


def test_same_graph():
    vectors = np.random.default_rng(3).normal(size=(700, 16))
    one, two = (neighbours.graph_of(vectors, 5) for _ in range(2))
    assert (one.edges == two.edges).all() and one.start == two.start
    assert ((one.edges >= 0).sum(1) <= neighbours.DEGREE).all() and (one.edges != np.arange(700)[:, None]).all()


def test_pruning():
    """An edge is dropped where one that stays is nearer to its end by the factor."""
    vectors = np.random.default_rng(4).normal(size=(50, 3)).astype(np.float32)
    graph = neighbours.Graph(vectors, np.full((50, 6), -1), 0)
    own, places = np.arange(50), np.tile(np.arange(50), (50, 1))
    for factor in (1.0, 1.2):
        got = graph.pruned(own, places, factor)
        for p in range(50):
            d, left, kept = np.sqrt(((vectors - vectors[p]) ** 2).sum(1)), [], []
            left = sorted((i for i in range(50) if i != p), key=lambda i: d[i])
            while left and len(kept) < 6:
                kept.append(left[0])
                left = [i for i in left[1:] if factor * np.sqrt(((vectors[kept[-1]] - vectors[i]) ** 2).sum()) > d[i]]
            assert [i for i in got[p].tolist() if i >= 0] == kept


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query(spark, sf):
    path = f"{TABLES}/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = answers(neighbours.query(spark, path)), brute(rows, [r for r in rows if r[0] % 100 == 0])
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.95
    for q, found in got.items():
        exact = {i: d for d, i in brute(rows, [r for r in rows if r[0] == q], len(rows))[q]}
        assert all(abs(exact[i] - d) < 1e-12 for d, i in found)
