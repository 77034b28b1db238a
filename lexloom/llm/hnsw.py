"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard of the vectors.

Vectors of one length are dealt into shards by hash. A shard's graph is built in one task and kept as flat arrays
of neighbours, one for each layer: nodes are numbered by descending level, so layer l holds the first nodes, and
its array has a row of neighbours for each. Largest inner product becomes nearness by one more component, which
gives all vectors of the shard the same length. Nodes are added in batches: a batch is searched for at once, its
members look at each other too, and neighbours are chosen so that they lie in different directions, hence clusters
of near copies stay linked with the rest. Queries meet every shard in blocks; the shards' results are merged, and
scores are computed anew on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.llm.words import mixed
from lexloom.plans.scratch import Scratch

#: Vectors of a shard and queries of a block, on average; links of a node (twice as many in layer 0).
ROWS, QUERIES, LINKS = 16_384, 2_048, 16
#: Nodes held while a graph is built, and while a query is answered.
BUILD, SEARCH = 96, 192
#: Nodes that a query expands in one step, queries that are answered together, and nodes added together.
WIDTH, TOGETHER, BATCH = 4, 256, 512
NONE = np.float32(-np.inf)


class Graph:
    """A graph over rows of equal length: ``layers[l]`` has the neighbours of the first nodes, -1 where there are none."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    def search(self, queries: np.ndarray, width: int, lowest: int = 0, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the ``width`` best found for each query in layer ``lowest``, best first; -1 and -inf fill up.

        With ``known``, only so many first nodes are looked at.
        """
        at = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.layers) - 1, lowest, -1):
            at = self._beam(queries, at, layer, 1, known)[0]
        return self._beam(queries, at, lowest, width, known)

    def _beam(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int, known: int | None):
        links = self.layers[layer][:known]
        n, rows = len(queries), np.arange(len(queries))[:, None]
        nodes = np.full((n, width), -1, np.int64)
        nodes[:, : start.shape[1]] = start
        sims = np.full((n, width), NONE)
        sims[:, : start.shape[1]] = np.einsum("qsd,qd->qs", self.vectors[start], queries)
        seen = np.zeros((n, len(links)), bool)
        seen[rows, start] = True
        expanded = nodes < 0
        step = min(WIDTH, width)
        active = np.arange(n)
        while len(active):
            open_ = np.where(expanded[active], NONE, sims[active])
            pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if width > step else np.tile(np.arange(width), (len(active), 1))
            usable = np.take_along_axis(open_, pick, 1) > NONE
            going = usable.any(axis=1)
            active, pick, usable = active[going], pick[going], usable[going]
            if not len(active):
                break
            expanded[active[:, None], pick] |= usable
            found = links[np.where(usable, nodes[active[:, None], pick], 0)]
            found = np.where(usable[:, :, None] & (found < len(links)), found, -1).reshape(len(active), -1)
            fresh = (found >= 0) & ~seen[active[:, None], found]
            # A node that two expanded ones point to counts once.
            order = np.argsort(found, axis=1, kind="stable")
            ordered = np.take_along_axis(found, order, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~again
            q, c = np.nonzero(fresh)
            new = found[q, c]
            seen[active[q], new] = True
            got = np.full(found.shape, NONE)
            got[q, c] = np.einsum("nd,nd->n", self.vectors[new], queries[active[q]])
            all_nodes = np.concatenate([nodes[active], found], axis=1)
            all_sims = np.concatenate([sims[active], got], axis=1)
            all_done = np.concatenate([expanded[active], ~fresh], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            nodes[active] = np.take_along_axis(all_nodes, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            expanded[active] = np.take_along_axis(all_done, best, 1)
        nodes[sims == NONE] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def _spread(vectors: np.ndarray, nodes: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """For each row of candidates (best first, -1 for none) the neighbours to keep: those nearer to the owner than to any kept one, then the best others."""
    held = vectors[nodes]
    between = held @ held.transpose(0, 2, 1)
    there = nodes >= 0
    kept, nearest, count = np.zeros_like(there), np.full(sims.shape, NONE), np.zeros(len(nodes), np.int64)
    for i in range(nodes.shape[1]):
        take = there[:, i] & (nearest[:, i] < sims[:, i]) & (count < links)
        kept[:, i] = take
        count += take
        np.copyto(nearest, np.maximum(nearest, between[:, :, i]), where=take[:, None])
    rank = np.where(kept, 0, np.where(there, 1, 2)) * nodes.shape[1] + np.arange(nodes.shape[1])
    chosen = np.argsort(rank, axis=1)[:, :links]
    return np.take_along_axis(nodes, chosen, 1)


def build(vectors: np.ndarray, tokens: np.ndarray, links: int = LINKS, held: int = BUILD) -> tuple[Graph, np.ndarray]:
    """A graph over the vectors, and the order in which it numbers them; ``tokens``, 64-bit hashes, give each its level."""
    share = (mixed(tokens) >> np.uint64(11)).astype(np.float64) / 2.0**53
    levels = np.minimum((-np.log(np.maximum(share, 2.0**-60)) / np.log(links)).astype(np.int64), 12)
    order = np.lexsort((tokens, -levels))
    vectors, levels = np.ascontiguousarray(vectors[order]), levels[order]
    sizes = [int((levels >= layer).sum()) for layer in range(levels[0] + 1)]
    layers = [np.full((size, 2 * links if layer == 0 else links), -1, np.int32) for layer, size in enumerate(sizes)]
    graph, done = Graph(vectors, layers), 1
    while done < len(vectors):
        level = int(levels[done])
        # Of one level only, and no more than the graph holds, so that most neighbours are there to be found.
        end = min(sizes[level], done + min(BATCH, max(32, done // 2)))
        batch = vectors[done:end]
        mates = batch @ batch.T
        np.fill_diagonal(mates, NONE)
        for layer in range(level, -1, -1):
            _link(graph, layer, done, end, batch, mates, held)
        done = end
    return graph, order


def _link(graph: Graph, layer: int, done: int, end: int, batch: np.ndarray, mates: np.ndarray, held: int) -> None:
    """Link new nodes with the best found in a layer, and these with the new nodes."""
    flat, vectors = graph.layers[layer], graph.vectors
    width = flat.shape[1]
    parts = [graph.search(batch[i : i + TOGETHER], min(held, done), layer, done) for i in range(0, len(batch), TOGETHER)]
    nodes, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
    near = np.argsort(-mates, axis=1, kind="stable")[:, : min(width, len(batch) - 1)]
    nodes = np.concatenate([nodes, near + done], axis=1)
    sims = np.concatenate([sims, np.take_along_axis(mates, near, 1)], axis=1)
    best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
    nodes, sims = np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)
    chosen = _spread(vectors, nodes, sims, width // 2 if layer == 0 else width)
    flat[done:end, : chosen.shape[1]] = chosen
    # Each chosen node gets the new ones that point to it, as far as they are among its best.
    owner, source = chosen.ravel(), np.repeat(np.arange(done, end), chosen.shape[1])
    owner, source = owner[owner >= 0], source[owner >= 0]
    score = np.einsum("nd,nd->n", vectors[owner], vectors[source])
    order = np.lexsort((-score, owner))
    owner, source = owner[order], source[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    fits = place < width
    touched = owner[first]
    row = np.searchsorted(touched, owner)
    pool = np.full((len(touched), 2 * width), -1, np.int64)
    pool[:, :width] = flat[touched]
    pool[row[fits], width + place[fits]] = source[fits]
    # A node of the batch may have chosen the one that now points to it.
    twice = np.array([(pool[:, width + i : width + i + 1] == pool[:, :width]).any(axis=1) for i in range(width)]).T
    pool[:, width:][twice] = -1
    for i in range(0, len(touched), TOGETHER):
        some, own = pool[i : i + TOGETHER], touched[i : i + TOGETHER]
        sims = np.where(some >= 0, np.einsum("tpd,td->tp", vectors[some], vectors[own]), NONE)
        best = np.argsort(-sims, axis=1, kind="stable")
        flat[own] = _spread(vectors, np.take_along_axis(some, best, 1), np.take_along_axis(sims, best, 1), width)


def _packed(vectors: DataFrame, is_query: Column) -> DataFrame:
    """``vec_id, asks, dim, x``: components as packed doubles; rows without id and vectors that take no part drop out."""

    def run(batches):
        for batch in batches:
            ids, asks, dims, packed = [], [], [], []
            for i, q, v in zip(*(batch.column(n).to_pylist() for n in ("vec_id", "asks", "embedding")), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0
                if x.any() and np.isfinite(x).all():
                    ids.append(i), asks.append(bool(q)), dims.append(len(x)), packed.append(x.tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(asks, pa.bool_()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "asks", "dim", "x"])

    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"), "embedding")
    return some.mapInArrow(run, "vec_id long, asks boolean, dim int, x binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _scale(x: np.ndarray) -> float:
    """A power of two that brings the largest component near 1, so that 32-bit floats hold all."""
    return float(2.0 ** -np.frexp(np.abs(x).max())[1])


def _index(links: int, held: int):
    """A shard's rows to one row of its flat arrays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        x = _matrix(pdf["x"], dim)
        short = (x * _scale(x)).astype(np.float32)
        squares = np.einsum("nd,nd->n", short, short, dtype=np.float64)
        rest = np.sqrt(np.maximum(squares.max() - squares, 0)).astype(np.float32)
        graph, order = build(np.concatenate([short, rest[:, None]], axis=1), pdf["token"].to_numpy().view(np.uint64), links, held)
        ids = pdf["ids"].to_numpy()[order]
        return pd.DataFrame(
            {
                "dim": [dim],
                "shard": [int(pdf["shard"].iloc[0])],
                "vectors": [x[order].tobytes()],
                "ids": [np.concatenate(ids).astype(np.int64).tobytes()],
                "n_ids": [np.array([len(i) for i in ids], np.int32).tobytes()],
                "sizes": [[len(layer) for layer in graph.layers]],
                "neighbours": [np.concatenate([layer.ravel() for layer in graph.layers]).tobytes()],
            }
        )

    return run


def build_index(vectors: DataFrame, rows: int = ROWS, links: int = LINKS, held: int = BUILD, copies: int = 21, scratch: Scratch | None = None) -> DataFrame:
    """One row of flat arrays for each shard of ``vectors(vec_id, dim, x)``, saved.

    Equal vectors are one node with its ``copies`` smallest ids, as no more of them can be among the best
    ``copies - 1`` of a query; they are cut before they are shuffled, so that a vector of many rows fills no task.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    order = Window.partitionBy("dim", "x").orderBy("vec_id")
    few = vectors.select("vec_id", "dim", "x").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= copies)
    nodes = scratch.save(few.groupBy("dim", "x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // rows))
    token = F.xxhash64("x", F.lit("token"))
    dealt = nodes.select("dim", "x", "ids", token.alias("token"), F.pmod(F.xxhash64("x", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"))
    schema = "dim int, shard int, vectors binary, ids binary, n_ids binary, sizes array<int>, neighbours binary"
    index = scratch.save(dealt.groupBy("dim", "shard").applyInPandas(_index(links, held), schema))
    scratch.drop(nodes)
    return index


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, added from the first component to the last in double precision."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * q[:, j]
    return total


def _answer(k: int, links: int, width: int):
    """A block of queries on a shard: the shard's best k rows of each query, with exact scores."""

    def run(key, asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or shard.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        dim, row = int(key[0]), shard.iloc[0]
        x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        scale = _scale(x)
        short = (x * scale).astype(np.float32)
        squares = np.einsum("nd,nd->n", short, short, dtype=np.float64)
        rest = np.sqrt(np.maximum(squares.max() - squares, 0)).astype(np.float32)
        flat, layers, at = np.frombuffer(row["neighbours"], np.int32), [], 0
        for layer, size in enumerate(row["sizes"]):
            each = 2 * links if layer == 0 else links
            layers.append(flat[at : at + size * each].reshape(size, each))
            at += size * each
        graph = Graph(np.concatenate([short, rest[:, None]], axis=1), layers)
        n_ids, ids = np.frombuffer(row["n_ids"], np.int32), np.frombuffer(row["ids"], np.int64)
        first = np.r_[0, np.cumsum(n_ids)]
        query_ids, q = asked["vec_id"].to_numpy(), _matrix(asked["x"], dim)
        q_short = np.zeros((len(q), dim + 1), np.float32)
        q_short[:, :dim] = q / np.abs(q).max(axis=1, keepdims=True)
        out = []
        for i in range(0, len(q), TOGETHER):
            nodes, _ = graph.search(q_short[i : i + TOGETHER], min(max(width, 2 * k), len(x)))
            # 32-bit similarities choose, with room to spare; doubles decide.
            nodes = nodes[:, : 2 * k + 2]
            who, where = np.nonzero(nodes >= 0)
            node, who = nodes[who, where], who + i
            score = exact_scores(x[node], q[who])
            each = n_ids[node]
            member = ids[np.repeat(first[node], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            who, score = np.repeat(who, each), np.repeat(score, each)
            other = member != query_ids[who]
            who, member, score = who[other], member[other], score[other]
            order = np.lexsort((member, -score, who))
            who, member, score = who[order], member[order], score[order]
            start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
            best = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)])) < k
            out.append(pd.DataFrame({"query_id": query_ids[who[best]], "vec_id": member[best], "score": score[best]}))
        return pd.concat(out)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, rows: int = ROWS, queries: int = QUERIES, links: int = LINKS, held: int = BUILD, width: int = SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k rows of largest inner product that the graphs find, nearest first.

    ``vectors(vec_id, embedding)``; queries are the rows for which ``is_query`` holds, one for each id (of several
    vectors under one id, the first in byte order asks). Every row is indexed, and rows with the query's own id
    are no candidates; only vectors of the query's length are. Scores are exact, in double precision; ties go to
    smaller ids, and repeated rows each take a rank. Null ids, and vectors that are null, empty, zero or hold a
    component that is null or not finite take no part. Fewer than k candidates are all returned, unless the graph misses
    some; an empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    packed = scratch.save(_packed(vectors, is_query))
    index = build_index(packed, rows, links, held, k + 1, scratch)
    asked = packed.where("asks").groupBy("vec_id").agg(F.min(F.struct("x", "dim")).alias("v")).select("vec_id", "v.dim", "v.x")
    blocks = max(1, -(-packed.where("asks").count() // queries))
    shards = index.select("dim", F.col("shard").alias("meets"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    held_in = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meet = asked.join(shards, "dim").groupBy("dim", "meets", "block").cogroup(held_in.groupBy("dim", "shard", "block"))
    best = meet.applyInPandas(_answer(k, links, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
