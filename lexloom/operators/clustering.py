"""Trees from distances, one for each group (dataset, resample) at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexloom.plans.scratch import Scratch


def _matrix(pairs: pd.DataFrame, missing: float | None) -> tuple[list[str], np.ndarray]:
    taxa = sorted({*pairs.taxon_a, *pairs.taxon_b})
    at = {t: i for i, t in enumerate(taxa)}
    d = np.full((len(taxa), len(taxa)), np.nan if missing is None else missing)
    np.fill_diagonal(d, 0)
    for a, b, value in zip(pairs.taxon_a, pairs.taxon_b, pairs.distance, strict=True):
        d[at[a], at[b]] = d[at[b], at[a]] = value
    if np.isnan(d).any():
        raise ValueError("the matrix lacks a pair")
    return taxa, d


def _first_least(d: np.ndarray) -> tuple[int, int]:
    """The pair above the diagonal with the least value, the first in order of equals."""
    return divmod(int(np.argmin(np.where(np.tri(len(d), dtype=bool), np.inf, d))), len(d))


def _upgma(taxa: list[str], d: np.ndarray) -> list[tuple]:
    """Join the nearest two clusters (the first in order of equals); distances to the new one are means over leaves."""
    names, sizes, heights, edges = list(taxa), [1] * len(taxa), [0.0] * len(taxa), []
    while len(names) > 1:
        i, j = _first_least(np.round(d, 12))
        new, height = f"node{len(taxa) - len(names) + 1}", d[i, j] / 2
        edges += [(new, names[i], 1, height - heights[i]), (new, names[j], 2, height - heights[j])]
        mean = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
        keep = [k for k in range(len(names)) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], mean[keep][:, None]], [mean[keep][None], np.zeros((1, 1))]])
        names, sizes, heights = [names[k] for k in keep] + [new], [sizes[k] for k in keep] + [sizes[i] + sizes[j]], [heights[k] for k in keep] + [height]
    return edges


def _neighbor(taxa: list[str], d: np.ndarray) -> list[tuple]:
    """Neighbour joining; the last two or three clusters hang on the root, and lengths are 0 at least."""
    names, edges = list(taxa), []
    while len(names) > 3:
        n, total = len(names), d.sum(axis=1)
        i, j = _first_least(np.round((n - 2) * d - total[:, None] - total[None], 9))
        own = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        new = f"node{len(taxa) - n + 1}"
        edges += [(new, names[i], 1, max(own, 0.0)), (new, names[j], 2, max(d[i, j] - own, 0.0))]
        rest = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], rest[keep][:, None]], [rest[keep][None], np.zeros((1, 1))]])
        names = [names[k] for k in keep] + [new]
    if len(names) == 3:
        lengths = [(d[i].sum() - d[(i + 1) % 3, (i + 2) % 3]) / 2 for i in range(3)]
    else:
        lengths = [d[0, 1] / 2] * len(names) if len(names) == 2 else []
    return edges + [("root", name, k + 1, max(float(x), 0.0)) for k, (name, x) in enumerate(zip(names, lengths, strict=False))]


METHODS = {"upgma": _upgma, "neighbor": _neighbor}


def cluster_trees(distances: DataFrame, keys: list[str], method: str = "upgma", missing: float | None = None) -> DataFrame:
    """``keys, parent_id, child_id, child_ordinal, branch_length``: a tree of each group of ``distances(keys, taxon_a, taxon_b, distance)``.

    A group is one matrix of distances between languages, held whole by a task; every pair must be there once,
    unless ``missing`` says how far the others are apart.
    Groups are independent, so many datasets or resamples are solved side by side. One taxon makes no tree.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {sorted(METHODS)}, not {method}")
    solve = METHODS[method]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        edges = solve(*_matrix(group, missing))
        rows = pd.DataFrame(edges, columns=["parent_id", "child_id", "child_ordinal", "branch_length"])
        for k in keys:
            rows[k] = group[k].iloc[0]
        return rows[[*keys, "parent_id", "child_id", "child_ordinal", "branch_length"]]

    kinds = dict(distances.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", parent_id string, child_id string, child_ordinal int, branch_length double"
    return distances.select(*keys, "taxon_a", "taxon_b", F.col("distance").cast("double").alias("distance")).groupBy(*keys).applyInPandas(one, schema)


def resampled_distances(distances: DataFrame, replicates: int, seed: str = "boot") -> DataFrame:
    """``replicate, taxon_a, taxon_b, distance`` of bootstrap resamples of the concepts in ``distances(taxon_a, taxon_b, concept_id, d)``.

    Each replicate draws as many concepts as there are, with replacement: the draws are hashes of the seed, so they are
    the same in every run, and a concept counts as often as it is drawn. Replicate 0 is the whole, each concept once. A pair that
    has no concept of a replicate's draws is not in it.
    """
    concepts = distances.select("concept_id").distinct()
    number = F.row_number().over(Window.orderBy("concept_id")) - 1  # one row a concept
    numbered = Scratch(distances.sparkSession).save(concepts.withColumn("_i", number))
    n = numbered.count()
    draws = numbered.select(F.col("_i").alias("_draw"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = draws.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "replicate", "_draw"), F.lit(max(n, 1))).cast("int"))
    weights = drawn.groupBy("replicate", "_i").agg(F.count("*").alias("w")).join(numbered, "_i").select("replicate", "concept_id", "w")
    weights = weights.unionByName(numbered.select(F.lit(0).alias("replicate"), "concept_id", F.lit(1).cast("long").alias("w")))
    weighed = distances.join(weights, "concept_id").groupBy("replicate", "taxon_a", "taxon_b")
    return weighed.agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("distance"))


def clades(edges: DataFrame, keys: list[str], rooted: bool = True) -> DataFrame:
    """``keys, leaves``: the sets of two leaves or more below the inner nodes of each tree, but for the whole.

    Where trees are not ``rooted``, a set and the rest of the leaves are one split, named by the side without the first leaf.
    """

    def one(tree: pd.DataFrame) -> pd.DataFrame:
        up, inner = dict(zip(tree.child_id, tree.parent_id, strict=True)), set(tree.parent_id)
        every = set(up) - inner
        below: dict[str, set[str]] = {}
        for leaf in every:
            node = leaf
            while node in up:
                node = up[node]
                below.setdefault(node, set()).add(leaf)
        sides = {tuple(sorted(x if rooted or min(every) not in x else every - x)) for x in below.values()}
        found = pd.DataFrame({"leaves": [list(x) for x in sorted(sides) if 1 < len(x) < len(every) - (0 if rooted else 1)]})
        for k in keys:
            found[k] = tree[k].iloc[0]
        return found[[*keys, "leaves"]]

    kinds = dict(edges.dtypes)
    return edges.groupBy(*keys).applyInPandas(one, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", leaves array<string>")


def clade_support(distances: DataFrame, replicates: int, method: str = "upgma", seed: str = "boot", missing: float | None = 1.0) -> DataFrame:
    """``leaves, n, support, in_tree``: how many of the resampled trees have each clade, and whether the tree of the whole has it.

    ``distances`` are those of :func:`lexloom.operators.evaluation.concept_distances`. All replicates are one plan: a
    weighted mean, a tree for each in tasks of their own, and a count of their clades.
    """
    trees = cluster_trees(resampled_distances(distances, replicates, seed), ["replicate"], method, missing)
    found = clades(trees, ["replicate"], rooted=method == "upgma")
    n = F.count_if(F.col("replicate") > 0)
    return found.groupBy("leaves").agg(n.alias("n"), (n / replicates).alias("support"), F.bool_or(F.col("replicate") == 0).alias("in_tree"))
