"""Bootstrap support of clades and ids named in calls, beside plain versions."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.operators import clustering, runs


def plain_upgma(taxa, d):
    """Clades of the tree that joins the nearest two clusters, whose distance to others is the mean over leaves."""
    live, found = [(t,) for t in sorted(taxa)], set()
    while len(live) > 1:
        mean = lambda x, y: sum(d[frozenset((a, b))] for a in x for b in y) / (len(x) * len(y))
        i, j = min(((i, j) for i in range(len(live)) for j in range(i + 1, len(live))), key=lambda p: (round(mean(live[p[0]], live[p[1]]), 12), p))
        new = live[i] + live[j]
        live = [c for k, c in enumerate(live) if k not in (i, j)] + [new]
        found.add(tuple(sorted(new)))
    return {c for c in found if len(c) < len(taxa)}


def test_bootstrap(spark):
    rng, taxa, concepts = random.Random(4), "abcdef", [f"k{i:02d}" for i in range(12)]
    rows = [(x, y, c, rng.random()) for i, x in enumerate(taxa) for y in taxa[i + 1 :] for c in concepts if rng.random() < 0.95]
    df = spark.createDataFrame(rows, "taxon_a string, taxon_b string, concept_id string, d double")
    # The draws, by the hash that names them.
    n = spark.range(12).select("id", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("r"))
    n = n.select("r", F.pmod(F.xxhash64(F.lit("boot"), "r", F.col("id").cast("int")), F.lit(12)).alias("i")).collect()
    weights = defaultdict(Counter)
    for r in n:
        weights[r.r][concepts[r.i]] += 1
    weights[0] = Counter(concepts)
    seen = Counter()
    for r, w in weights.items():
        sums = defaultdict(lambda: [0.0, 0])
        for x, y, c, value in rows:
            sums[frozenset((x, y))][0] += value * w[c]
            sums[frozenset((x, y))][1] += w[c]
        for clade in plain_upgma(taxa, {k: s / m if m else 1.0 for k, (s, m) in sums.items()}):
            seen[clade] += r > 0
            seen[clade, "whole"] += r == 0
    got = clustering.clade_support(df, 25).collect()
    assert {tuple(r.leaves): (r.n, r.in_tree) for r in got} == {c: (seen[c], seen[c, "whole"] > 0) for c in seen if c[-1] != "whole"}
    assert all(r.support == pytest.approx(r.n / 25) for r in got) and sum(r.in_tree for r in got) == 4


def test_splits(spark):
    """Splits of a tree without root are named by the side without the first leaf."""
    rows = [("t", "n1", "a", 1, 1.0), ("t", "n1", "b", 2, 1.0), ("t", "root", "n1", 1, 1.0), ("t", "root", "c", 2, 1.0), ("t", "root", "d", 3, 1.0)]
    edges = spark.createDataFrame(rows, "g string, parent_id string, child_id string, child_ordinal int, branch_length double").coalesce(1)
    assert [r.leaves for r in clustering.clades(edges, ["g"], rooted=False).collect()] == [["c", "d"]]
    assert [r.leaves for r in clustering.clades(edges, ["g"]).collect()] == [["a", "b"]]


def walk(node, key=None):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from walk(v, k)
    elif isinstance(node, list):
        for v in node:
            yield from walk(v, key)
    elif node is not None and not isinstance(node, bool):
        yield key, str(node)


def test_inspected(spark):
    told = [
        {"concept_id": "k1"}, {"concept_ids": ["k2", ["k3", {"x": "k4"}]], "k5": 1}, {"a": {"b": {"form_ids": [7, "8", 99]}}}, {"note": "k6"}, {"concept_ids": "k\"7"},
        {"supporting_form_ids": {"concept_id": None}}, {}, [], "k1", {"concept_ids": ["unknown"]}, {"deep": [[[[[{"form_id": 9}]]]]]},
    ]
    texts = [json.dumps(t) for t in told] + ['{"concept_ids": ["k1"', None, '{"concept_id": "k\\u0032"}']
    calls = spark.createDataFrame([(i % 5, i, "all" if i % 2 else "one", t) for i, t in enumerate(texts)], "session_id long, event_id long, tool string, arguments string")
    concepts = [f"k{i}" for i in range(1, 8)] + ['k"7']
    forms = [(7, "k4"), (8, "k5"), (9, "k6")]
    got = runs.inspected_concepts(
        calls, spark.createDataFrame(forms, "form_id long, concept_id string"), spark.createDataFrame([(c,) for c in concepts], "concept_id string"), ("all",)
    )
    want, by_form = set(), {str(f): c for f, c in forms}
    for i, text in enumerate(texts):
        try:
            pairs = list(walk(json.loads(text)))
        except (TypeError, ValueError):
            pairs = []
        named = {v for k, v in pairs if k in ("concept_id", "concept_ids") and v in concepts}
        named |= {by_form[v] for k, v in pairs if k in ("form_id", "form_ids", "supporting_form_ids") and v in by_form}
        want |= {(i % 5, c) for c in (named or (concepts if i % 2 else ()))}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equal_arguments_are_taken_apart_once(spark, monkeypatch):
    texts = ['{"concept_id": "k1"}', '{"form_id": 7}', "[]", None]
    calls = spark.createDataFrame([(i // 100, i, "all" if i % 200 < 100 else "one", texts[i // 100 % 4]) for i in range(800)], "session_id long, event_id long, tool string, arguments string")
    plain, seen = runs.named_values, []
    monkeypatch.setattr(runs, "named_values", lambda c: (seen.append(c.count()), plain(c))[1])
    got = runs.inspected_concepts(calls, spark.createDataFrame([(7, "k2")], "form_id long, concept_id string"), spark.createDataFrame([("k1",), ("k2",)], "concept_id string"), ("all",))
    assert sorted(map(tuple, got.collect())) == [(0, "k1"), (1, "k2"), (2, "k1"), (2, "k2"), (4, "k1"), (5, "k2"), (6, "k1"), (6, "k2")]
    assert seen == [4]
