"""Alignment of many forms at once: profiles are joined two by two along a guide tree.

A profile counts the tokens and gaps of each column. Two profiles are aligned at the least sum of the costs of
all pairs of their members; the guide tree joins the nearest first (by average distance). A task aligns at most
``SIZE`` profiles: the forms of a larger group are dealt into blocks in their order, and the blocks' profiles are
aligned in the same way, level upon level, so a group may be of any size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexloom.plans.scratch import Scratch

#: Profiles that are aligned in one task.
SIZE = 64
GAP = ""
GROUP = ["concept_id", "cognate_set_id"]
PROFILE = "array<map<string,int>>"


@dataclass(frozen=True)
class Costs:
    """What it costs to face one token with another, in whole numbers; ``table`` has pairs in either order.

    The table holds a pair for each two tokens of an inventory that differ less than others, and goes to every task.
    """

    gap: int = 1000
    unequal: int = 1000
    table: dict[tuple[str, str], int] = field(default_factory=dict)

    def of(self, a: str, b: str) -> int:
        if a == b:
            return 0
        if GAP in (a, b):
            return self.gap
        return self.table.get((a, b), self.table.get((b, a), self.unequal))


def class_costs(classes: dict[str, str], same: int = 500, unequal: int = 1000, gap: int = 800) -> Costs:
    """Tokens of one sound class differ by ``same``, others by ``unequal``."""
    table = {(a, b): same for a in classes for b in classes if a < b and classes[a] == classes[b]}
    return Costs(gap, unequal, table)


def _paths(cross: np.ndarray, down: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cost tables of many pairs: ``cross[p, i, j]`` for a step on both sides, ``down[p, i]`` and ``right[p, j]`` on one."""
    pairs, m, n = cross.shape
    cost = np.zeros((m + 1, n + 1, pairs), np.int64)
    cost[1:, 0], cost[0, 1:] = np.cumsum(down, axis=1).T, np.cumsum(right, axis=1).T
    for i in range(m):
        for j in range(n):
            one = np.minimum(cost[i, j + 1] + down[:, i], cost[i + 1, j] + right[:, j])
            cost[i + 1, j + 1] = np.minimum(cost[i, j] + cross[:, i, j], one)
    return cost


class Aligner:
    """Aligns profiles given as arrays of counts: a row for each column, a column for each token, gaps first."""

    def __init__(self, tokens: list[str], costs: Costs):
        self.costs = np.array([[costs.of(a, b) for b in tokens] for a in tokens], np.int64).reshape(len(tokens), len(tokens))

    def distances(self, profiles: list[np.ndarray]) -> np.ndarray:
        """Mean cost of two members, over the greater width, for each two profiles."""
        n, width = len(profiles), max(map(len, profiles))
        out = np.full((n, n), np.inf)
        a, b = np.triu_indices(n, 1)
        if not len(a):
            return out
        padded = np.zeros((n, width, len(self.costs)), np.int64)
        for row, p in zip(padded, profiles, strict=True):
            row[: len(p)] = p
        size, length = np.array([p[0].sum() if len(p) else 1 for p in profiles]), np.array(list(map(len, profiles)))
        priced = padded @ self.costs
        lone = priced[:, :, 0]
        table = _paths(np.einsum("pis,pjs->pij", priced[a], padded[b]), lone[a] * size[b][:, None], lone[b] * size[a][:, None])
        best = table[length[a], length[b], np.arange(len(a))]
        out[a, b] = out[b, a] = best / (size[a] * size[b] * np.maximum(np.maximum(length[a], length[b]), 1))
        return out

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Columns of both profiles that face each other, -1 where one has none; a step on both sides is preferred, then one on the left."""
        size_a, size_b = (int(p[0].sum()) if len(p) else 1 for p in (a, b))
        cross, down, right = a @ self.costs @ b.T, (a @ self.costs[:, 0]) * size_b, (b @ self.costs[:, 0]) * size_a
        table = _paths(cross[None], down[None], right[None])[:, :, 0]
        i, j, out = len(a), len(b), []
        while i or j:
            if i and j and table[i, j] == table[i - 1, j - 1] + cross[i - 1, j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif i and table[i, j] == table[i - 1, j] + down[i - 1]:
                i -= 1
                out.append((i, -1))
            else:
                j -= 1
                out.append((-1, j))
        return out[::-1]


def align_profiles(profiles: list[list[dict[str, int]]], costs: Costs = Costs()) -> tuple[list[list[int]], list[dict[str, int]]]:
    """For each profile, its own column at each column of the whole (-1: a gap); and the profile of the whole.

    The nearest two are joined first, their distance to others being the mean over members; of equal ones those that come first.
    """
    tokens = [GAP, *sorted({t for p in profiles for column in p for t in column} - {GAP})]
    at = {t: i for i, t in enumerate(tokens)}
    aligner, counts = Aligner(tokens, costs), []
    for p in profiles:
        table = np.zeros((len(p), len(tokens)), np.int64)
        for i, column in enumerate(p):
            for t, n in column.items():
                table[i, at[t]] = n
        counts.append(table)
    far, live = aligner.distances(counts), list(range(len(profiles)))
    members = {i: {i: list(range(len(p)))} for i, p in enumerate(profiles)}
    sizes = [int(p[0].sum()) if len(p) else 1 for p in counts]
    while len(live) > 1:
        some = far[np.ix_(live, live)]
        x, y = divmod(int(np.argmin(np.where(np.tri(len(live), dtype=bool), np.inf, some))), len(live))
        a, b = live[x], live[y]
        steps = aligner.join(counts[a], counts[b])
        gaps = np.zeros((2, len(tokens)), np.int64)
        gaps[0, 0], gaps[1, 0] = sizes[a], sizes[b]
        counts[a] = np.array([(counts[a][i] if i >= 0 else gaps[0]) + (counts[b][j] if j >= 0 else gaps[1]) for i, j in steps], np.int64).reshape(len(steps), len(tokens))
        left, right = [i for i, _ in steps], [j for _, j in steps]
        members[a] = {k: [v[i] if i >= 0 else -1 for i in left] for k, v in members[a].items()} | {k: [v[j] if j >= 0 else -1 for j in right] for k, v in members.pop(b).items()}
        far[a] = far[:, a] = (far[a] * sizes[a] + far[b] * sizes[b]) / (sizes[a] + sizes[b])
        far[a, a] = np.inf
        sizes[a] += sizes[b]
        live.remove(b)
    whole = [{t: int(n) for t, n in zip(tokens, column, strict=True) if n} for column in counts[live[0]]]
    return [members[live[0]][i] for i in range(len(profiles))], whole


def _solve(costs: Costs) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        places, whole = align_profiles([[{t: int(n) for t, n in (c.items() if isinstance(c, dict) else c)} for c in p] for p in pdf["profile"]], costs)
        pdf["places"] = places
        pdf["whole"] = [whole] + [None] * (len(pdf) - 1)
        return pdf[[*GROUP, "block", "item", "places", "whole"]]

    return run


def align_forms(forms: DataFrame, costs: Costs | None = None, size: int = SIZE) -> DataFrame:
    """Add ``aligned`` (gaps are null, one width for each group) to the distinct ``forms(concept_id, cognate_set_id, segments)``."""
    if size < 2:
        raise ValueError("a block holds two profiles or more")
    scratch = Scratch(forms.sparkSession)
    number = F.row_number().over(Window.partitionBy(*GROUP).orderBy("segments")) - 1
    forms = forms.select(*GROUP, "segments").distinct().withColumn("item", number)
    single = F.transform("segments", lambda s: F.create_map(s, F.lit(1)))
    level, aligned = forms.select(*GROUP, "item", single.alias("profile")), None
    rows = scratch.save(forms.select(*GROUP, "item", "segments", F.col("segments").alias("aligned")))
    same = lambda a, b, *more: (F.col(f"{a}.concept_id").eqNullSafe(F.col(f"{b}.concept_id"))) & (F.col(f"{a}.cognate_set_id").eqNullSafe(F.col(f"{b}.cognate_set_id")))
    while True:
        dealt = level.withColumn("block", F.expr(f"item div {size}").cast("int"))
        schema = f"concept_id string, cognate_set_id string, block int, item int, places array<int>, whole {PROFILE}"
        solved = scratch.save(dealt.groupBy(*GROUP, "block").applyInPandas(_solve(costs or Costs()), schema))
        placed = rows.alias("r").join(solved.alias("s"), same("r", "s") & (F.col("r.item") == F.col("s.item")))
        now = F.transform("s.places", lambda p: F.get("r.aligned", F.when(p >= 0, p)))
        aligned = scratch.save(placed.select("r.concept_id", "r.cognate_set_id", F.col("s.block").alias("item"), "r.segments", now.alias("aligned")))
        level = solved.where("whole is not null").select(*GROUP, F.col("block").alias("item"), F.col("whole").alias("profile"))
        scratch.drop(rows)
        rows = aligned
        if level.agg(F.max("item")).first()[0] in (None, 0):
            scratch.keep(rows)
            return rows.select(*GROUP, "segments", "aligned")
