"""Graph search against brute force: recall, exact scores and order, copies, odd vectors."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, shard string, dim string, x string, token string"
SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=20):
    """``{query: [(score, vec_id), ...]}`` over all candidates, best first; components are 32-bit floats."""
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if len(v) and np.isfinite(v).all() and v.any()]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            found = []
            for i, v in rows:
                if i != q and len(v) == len(x):
                    score = 0.0
                    for a, b in zip(v, x, strict=True):
                        score += float(a) * float(b)
                    found.append((score, i))
            out[q] = sorted(found, key=lambda s: (-s[0], s[1]))[:k]
    return out


def results(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, want):
    n = sum(len(v) for v in want.values())
    return sum(len({i for _, i in found[q]} & {i for _, i in best}) for q, best in want.items()) / n


def test_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found, want = results(hnsw.search(table, F.col("vec_id") % 20 == 0)), plain(rows)
    assert set(found) == set(want) and recall(found, want) >= 0.99


@pytest.mark.parametrize("rows_of_shard", [hnsw.ROWS, 700])
def test_clusters_and_copies(spark, rows_of_shard):
    """Lengths that differ much, tight clusters, a third of all rows equal, equal rows that tie."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 24)) * rng.lognormal(size=(1500, 1))
    near = base[rng.integers(0, 5, 900)] * (1 + 1e-3 * rng.normal(size=(900, 24)))
    same = np.repeat(base[:1], 1200, axis=0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.permutation(np.concatenate([base, near, same])))]
    found, want = results(hnsw.search(frame(spark, rows), F.col("vec_id") % 20 == 0, rows=rows_of_shard, queries=64)), plain(rows)
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    assert recall(found, want) >= 0.9
    scores = {(q, i): s for q, best in want.items() for s, i in best}
    for q, best in found.items():
        assert best == sorted(best, key=lambda s: (-s[0], s[1]))
        assert all(scores.get((q, i), s) == s for s, i in best)


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, -0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0])]
    rows += [(8, [1e-30, 0.0]), (9, [-3e30, 2.0]), (10, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (40, None), (60, [0.0, 0.0]), (11, [0.0, 5.0]), (12, [-0.0, 5.0])]
    assert dict(results(hnsw.search(frame(spark, rows), F.col("vec_id") % 20 == 0))) == {q: v for q, v in plain(rows).items() if v}
    assert hnsw.search(frame(spark, rows).where("vec_id < 0"), F.col("vec_id") % 20 == 0).collect() == []
    assert hnsw.search(frame(spark, rows), F.col("vec_id") == 0, k=1).collect()[0].vec_id == 1


def test_graph_is_one_piece():
    """Every node of a graph over clusters is reached from the entry."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)] + 0.01 * rng.normal(size=(2000, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = hnsw.build(x, rng.integers(0, 2**63, 2000).astype(np.uint64))
    assert sorted(order) == list(range(2000)) and all(len(a) > len(b) for a, b in zip(graph.layers, graph.layers[1:]))
    seen, todo = {0}, [0]
    while todo:
        new = set(graph.layers[0][todo].ravel().tolist()) - seen - {-1}
        seen |= new
        todo = list(new)
    assert len(seen) >= 1980
    best, _ = graph.search(graph.vectors[:100], 30)
    assert (best[:, 0] == np.arange(100)).mean() > 0.97
