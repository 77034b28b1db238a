"""Recoverability of branches, policies at ties and largest misses against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql.functions import udf

from lexloom.operators import alignment, evaluation, selection

PAIRS = "child_id string, concept_id string, ordinal int, left array<string>, right array<string>"


def plain_recoverability(rows):
    counts, first = defaultdict(Counter), {}
    for child, concept, ordinal, left, right in rows:
        for i, (x, y) in enumerate(zip(*alignment.align(left, right), strict=True)):
            if x is not None:
                counts[child, x][y] += 1
                first[child, x, y] = min(first.get((child, x, y), (ordinal, i)), (ordinal, i))
    best = {(c, x): min(ys, key=lambda y: (-ys[y], first[c, x, y])) for (c, x), ys in counts.items()}
    hit, whole, deletions = defaultdict(bool), defaultdict(bool), defaultdict(lambda: [0, 0])
    for child, concept, _, left, right in rows:
        shown = [y for y in (best[child, x] for x in left) if y is not None]
        a, b = alignment.align(left, right)
        intact = all(x is not None for x, y in zip(a, b, strict=True) if y is not None)
        hit[concept] |= shown == right
        whole[concept] |= intact
        deletions[child][0] += 1
        deletions[child][1] += not intact
    return {c: "single" if hit[c] else "mixed" if whole[c] else "none" for c in hit}, {k: tuple(v) for k, v in deletions.items()}


def test_recoverability(spark):
    rng, rows = random.Random(6), []
    for c in range(40):
        gold = [rng.choice("abcd") for _ in range(rng.randrange(1, 5))]
        for child in ("x", "y"):
            form = [s for s in gold if rng.random() < 0.7] + [rng.choice("abcd")] * (rng.random() < 0.3)
            rows.append((child, f"c{c}", c, form, gold))
    rows += [("z", "e1", 90, ["x", "a", "b"], ["a", "b"]), ("z", "e2", 91, ["x", "x"], ["x", "x"]), ("p", "e3", 92, ["a"], ["a", "b"]), ("q", "e3", 93, ["b"], ["a", "b"])]
    classes, deletions = evaluation.recoverability(spark.createDataFrame(rows, PAIRS))
    want, deleted = plain_recoverability(rows)
    assert {r.concept_id: r["class"] for r in classes.collect()} == want
    assert {r.child_id: (r.n_concepts, r.n_deleting) for r in deletions.collect()} == deleted
    # A branch with a segment too many does not reach the form; two branches that lack one each do not together either.
    assert want["e1"] == "mixed" and want["e3"] == "none" and set(want.values()) == {"single", "mixed", "none"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] / max(len(a), len(b), 1)


def plain_policies(ties, clades, forms, gold):
    leaf = {}
    for form_id, variety, concept, segments in sorted(forms):
        leaf.setdefault((variety, concept), segments)
    out = {}
    for node in {t[0] for t in ties}:
        own = defaultdict(set)
        for n, clade, member in clades:
            if n == node:
                own[clade].add(member)
        judged = [t for t in ties if t[0] == node and t[1] in gold]
        ceiling = sum(gold[c] in (a, b) for _, c, a, b in judged)
        hits = Counter()
        for _, c, a, b in judged:

            def support(x, y):
                real = (set(x) - set(y)) - {"+", "-"}
                return sum(any((m, c) in leaf and real <= set(leaf[m, c]) for m in ms) for ms in own.values()) if real else 0

            near = [[distance(x, leaf[m, c]) for ms in own.values() for m in ms if (m, c) in leaf] for x in (a, b)]
            near = [sum(n) / len(n) if n else 1.0 for n in near]
            by_clades = a if support(a, b) >= support(b, a) else b
            parts = [sum(s in "+-" for s in x) for x in (a, b)]
            picks = {"alphabetical": min(a, b), "daughters": a if near[0] <= near[1] else b, "clades": by_clades}
            picks["morphs"] = by_clades if parts[0] == parts[1] else a if parts[0] < parts[1] else b
            hits.update(p for p, form in picks.items() if form == gold[c])
        for policy in evaluation.POLICIES:
            out[node, policy] = (len(judged), ceiling, len(own), hits[policy] if own else None)
    return out


def test_policies(spark):
    rng = random.Random(3)
    word = lambda: [rng.choice("abc+") for _ in range(rng.randrange(1, 5))]
    clades = [("n1", "c1", "v1"), ("n1", "c1", "v2"), ("n1", "c2", "v3"), ("n2", "c3", "v4"), ("n2", "c1", "v1")]
    forms = [(i, f"v{rng.randrange(1, 5)}", f"k{rng.randrange(30)}", word()) for i in range(90)]
    ties = [(n, f"k{i}", *pair) for n in ("n1", "n2", "n3") for i in range(28) for pair in [(word(), word())] if pair[0] != pair[1]]
    gold = {f"k{i}": rng.choice([t for t in ties if t[1] == f"k{i}"])[2 + rng.randrange(2)] for i in range(25)}
    tied = spark.createDataFrame(ties, "node_id string, concept_id string, first array<string>, second array<string>")
    around = spark.createDataFrame(clades, "node_id string, clade_id string, leaf_id string")
    known = spark.createDataFrame(forms, "form_id long, variety_id string, concept_id string, segments array<string>")
    right = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(gold.items())], "form_id long, concept_id string, segments array<string>")
    got = evaluation.compare_policies(evaluation.clade_support(tied, around, known), right, around).collect()
    assert {(r.node_id, r.policy): (r.n_ties, r.ceiling, r.n_clades, r.hits) for r in got} == plain_policies(ties, clades, forms, gold)


def test_support_is_for_what_differs(spark):
    """A clade that holds b supports ``a b`` against ``a c``, whatever else the form has."""
    tie = spark.createDataFrame([("n", "k", ["a", "b"], ["a", "c"])], "node_id string, concept_id string, first array<string>, second array<string>")
    clades = spark.createDataFrame([("n", "c", "v")], "node_id string, clade_id string, leaf_id string")
    forms = spark.createDataFrame([(1, "v", "k", ["b"])], "form_id long, variety_id string, concept_id string, segments array<string>")
    row = evaluation.clade_support(tie, clades, forms).first()
    assert (row.n_clades_first, row.n_clades_second) == (1, 0)
    assert (row.distance_first, row.distance_second) == (pytest.approx(0.5), pytest.approx(1.0))


def test_tied_pairs(spark):
    rows = [("n", "k", 1, -1.0, ["b"]), ("n", "k", 2, -1.0, ["a"]), ("n", "k", 3, -1.0, ["c"]), ("n", "j", 1, -1.0, ["a"]), ("n", "j", 2, -1.5, ["b"]), ("m", "k", 1, 0.0, ["a"])]
    got = evaluation.tied_pairs(spark.createDataFrame(rows, "node_id string, concept_id string, rank int, log_score double, segments array<string>"), ["node_id", "concept_id"])
    assert [tuple(r) for r in got.collect()] == [("n", "k", ["b"], ["a"])]


def test_recovery_and_misses(spark):
    outputs = spark.createDataFrame([("b", "p", "k1", ["a"]), ("b", "p", "k2", ["a"])], "child_id string, parent_id string, concept_id string, output array<string>")
    parents = spark.createDataFrame([("p", "k1", ["a"])], "parent_id string, concept_id string, segments array<string>")
    assert evaluation.functional_recovery(outputs, parents).first().rate == 0.5
    scored = spark.createDataFrame([("n", "k1", 2), ("n", "k2", 5), ("n", "k3", 2), ("m", "k1", 1), ("m", "k2", None)], "node_id string, concept_id string, ed int")
    assert sorted(map(tuple, selection.largest_misses(scored, 2).collect())) == [("m", "k1", 1, 1), ("n", "k1", 2, 2), ("n", "k2", 5, 1)]


def test_long_chain_of_changes(spark):
    """As many rounds as there are changes."""
    chain = spark.createDataFrame([("b", f"s{i:03d}", f"s{i + 1:03d}") for i in range(250)], "child_id string, source string, target string")
    assert [r.source for r in alignment.oracle_rules(chain, ["child_id"]).orderBy("rule_ordinal").collect()] == [f"s{i:03d}" for i in range(249, -1, -1)]


def test_copies_meet_gold_once(spark, monkeypatch):
    """Pairs are of different forms: a thousand copies against a thousand are as many pairs as their forms."""
    rows = [(i, f"k{i % 2}", list("ab") if i % 4 < 2 else list("abc")) for i in range(1000)] + [(1000, "k9", ["a"]), (1001, "k0", None), (1002, "k1", []), (0, "k0", list("ab"))]
    forms = spark.createDataFrame(rows, "form_id long, concept_id string, segments array<string>")
    gold = spark.createDataFrame([(f"k{i % 2}", list("xb") if i % 3 else list("abd")) for i in range(1000)], "concept_id string, segments array<string>")
    asked = spark.sparkContext.accumulator(0)

    @udf("int")
    def counted(a, b):
        asked.add(1)
        return 1

    got = evaluation.nearest_gold(forms, gold).collect()
    monkeypatch.setattr(evaluation, "edit_distance", counted)
    assert len(evaluation.nearest_gold(forms, gold).collect()) == len(got) == 1002  # a copy of a whole row counts once; a concept without gold is left out
    assert asked.value <= 20
    near = {("a", "b"): (["a", "b", "d"], 1, 1 / 3), ("a", "b", "c"): (["a", "b", "d"], 1, 1 / 3)}
    want = {(i, c, tuple(s)): near[tuple(s)] for i, c, s in rows[:1000]}
    assert {(r.form_id, r.concept_id, tuple(r.segments)): (r.nearest, r.ed, pytest.approx(r.ned)) for r in got if r.segments} == want
