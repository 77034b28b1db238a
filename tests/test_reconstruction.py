"""Beams of several children against a plain version that keeps its states in dictionaries."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.operators import alignment, reconstruction, rules

EDGES = "parent_id string, child_id string, child_ordinal int, branch_length double"
RULES = "node_id string, rule_ordinal int, dsl string, source_child_ids array<string>, confidence double"


def add(values):
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def plain(children, k, anchors, boost):
    """Rank and share of each form of ``combined``."""
    best = combined(children, k, anchors, boost)
    whole = add([s for _, s in best])
    return {seg: (rank, math.exp(s - whole)) for rank, (seg, s) in enumerate(best, 1)}


def combined(children, k, anchors, boost):
    """Forms and scores, best first. ``children``: for each, in order, its (output, score, fired)."""
    states = {(): 0.0}
    for rows in children:
        new = defaultdict(list)
        for state, score in states.items():
            for out, s, fired in rows:
                held = {seg: (n, h) for seg, n, h in state}
                n, h = held.get(out, (0, 0))
                held[out] = (n + 1, max(h, anchors.get(out, 0) if fired else 0))
                new[tuple(sorted((seg, n, h) for seg, (n, h) in held.items()))].append(score + s)
        merged = [(state, add(v)) for state, v in new.items()]
        merged.sort(key=lambda x: (-round(x[1] + max(h for _, _, h in x[0]) * boost, 12), x[0]))
        states = dict(merged[:k])
    raw = defaultdict(list)
    for state, score in states.items():
        total = sum(n for _, n, _ in state)
        for seg, n, h in state:
            raw[seg].append(score + math.log(n) - math.log(total) + h * boost)
    return sorted(((seg, add(v)) for seg, v in raw.items()), key=lambda x: (-round(x[1], 12), x[0]))[:k]


@pytest.mark.parametrize("policy", ["advisory", "scored"])
def test_combine(spark, policy):
    rng = random.Random(3)
    schema = "parent_id string, child_id string, child_ordinal int, concept_id string, segments array<string>, rank int, output array<string>, score double, fired boolean"
    rows, want, anchors = [], {}, [("p", "k0", ["a"]), ("p", "k1", ["b", "a"]), ("p", "k1", ["b", "a"])]
    for concept in ("k0", "k1", "k2", "k3"):
        children = []
        for child in range(4):
            if concept == "k2" and child == 1:
                continue  # a child without the concept
            cands = [([rng.choice("ab") for _ in range(rng.randrange(1, 3))], math.log(rng.choice([1, 2, 5]) / 10), rng.random() < 0.5) for _ in range(rng.randrange(1, 4))]
            children.append([(tuple(o), s, f) for o, s, f in cands])
            rows += [("p", f"c{child}", child, concept, o, i + 1, o, s, f) for i, (o, s, f) in enumerate(cands)]
        known = defaultdict(int)
        for _, c, seg in anchors:
            if c == concept:
                known[tuple(seg)] += 1
        want[concept] = plain(children, 3, known if policy == "scored" else {}, math.log(100) if policy == "scored" else 0.0)
    given = spark.createDataFrame(anchors, "node_id string, concept_id string, segments array<string>")
    got = reconstruction.combine_children(spark.createDataFrame(rows, schema), 3, given, policy).collect()
    mine = defaultdict(dict)
    for r in got:
        mine[r.concept_id][tuple(r.segments)] = (r.rank, r.probability)
    assert {c: {s: r for s, (r, _) in v.items()} for c, v in mine.items()} == {c: {s: r for s, (r, _) in v.items()} for c, v in want.items()}
    assert all(mine[c][s][1] == pytest.approx(p) for c, v in want.items() for s, (_, p) in v.items())


def family(spark):
    edges = [("inner_a", "d1", 1), ("inner_a", "d2", 2), ("inner_b", "d3", 1), ("inner_b", "d4", 2), ("proto", "inner_a", 1), ("proto", "inner_b", 2)]
    return spark.createDataFrame([(p, c, n, 1.0) for p, c, n in edges], EDGES)


def test_four_against_one(spark):
    """Four children with one form and one with another: 0.80 and 0.20."""
    edges = spark.createDataFrame([("p", f"c{i}", i, 1.0) for i in range(5)], EDGES)
    forms = spark.createDataFrame([(i, f"c{i}", "k", ["a", "W" if i == 4 else "k", "a"]) for i in range(5)], "form_id long, variety_id string, concept_id string, segments array<string>")
    beams, children = reconstruction.reconstruct_tree(forms, edges, rules.compile_rules(spark.createDataFrame([], RULES)), 5)
    found = {tuple(r.segments): round(r.probability, 9) for r in beams.where("node_id = 'p'").collect()}
    assert found == {("a", "k", "a"): 0.8, ("a", "W", "a"): 0.2}
    assert reconstruction.branch_support(children, beams, edges).first().support == pytest.approx(0.8)


def test_family_there_and_back(spark):
    """Forms derived from a proto-language by rules come back under the swapped rules."""
    edges = family(spark)
    proto = spark.createDataFrame([("proto", f"k{i}", w.split()) for i, w in enumerate(["p a t a", "k u t i", "t u p u", "a k i"])], "node_id string, concept_id string, segments array<string>")
    law = rules.compile_rules(spark.createDataFrame([("inner_a", 1, "p > f", None, 1.0), ("d2", 1, "k > x", None, 1.0), ("d3", 1, "t > θ", None, 1.0), ("d4", 1, "u > o", None, 1.0)], RULES))
    derived = reconstruction.derive_daughters(proto, edges, law)
    got = {(r.node_id, r.concept_id): " ".join(r.segments) for r in derived.collect()}
    assert got["d2", "k1"] == "x u t i" and got["d1", "k0"] == "f a t a" and got["d4", "k2"] == "t o p o"
    assert {r.child_id: r.invertible for r in reconstruction.invert_and_verify(derived, edges, law).collect()} == dict.fromkeys(["inner_a", "inner_b", "d1", "d2", "d3", "d4"], True)
    lossy = rules.compile_rules(spark.createDataFrame([("d1", 1, "t > k", None, 1.0), ("d2", 1, "a > Ø / _ #", None, 1.0)], RULES))
    found = {r.child_id: r.invertible for r in reconstruction.invert_and_verify(reconstruction.derive_daughters(proto, edges, lossy), edges, lossy).collect()}
    assert found["d1"] is False and found["d2"] is False and found["d3"] is True
    back = rules.compile_rules(spark.createDataFrame([("proto", 1, "f > p", ["inner_a"], 1.0), ("inner_a", 1, "x > k", ["d2"], 1.0), ("inner_b", 1, "θ > t", ["d3"], 1.0), ("inner_b", 2, "o > u", ["d4"], 1.0)], RULES))
    leaves = derived.where("node_id like 'd%'").withColumnRenamed("node_id", "variety_id")
    beams, _ = reconstruction.reconstruct_tree(leaves, edges, back, 5)
    best = {r.concept_id: (" ".join(r.segments), round(r.probability, 9)) for r in beams.where("node_id = 'proto' and rank = 1").collect()}
    assert best == {"k0": ("p a t a", 1.0), "k1": ("k u t i", 1.0), "k2": ("t u p u", 1.0), "k3": ("a k i", 1.0)}


def test_confidence_and_taint(spark):
    edges = family(spark)
    forms = spark.createDataFrame([("d1", "k", ["p"]), ("d2", "k", ["f"])], "variety_id string, concept_id string, segments array<string>")
    law = rules.compile_rules(spark.createDataFrame([("inner_a", 1, "p > b", ["d1"], 0.5), ("inner_a", 2, "f > v", ["d1"], 0.1)], RULES))
    _, children = reconstruction.reconstruct_tree(forms, edges, law, 5)
    got = {r.child_id: (r.output, r.score) for r in children.where("parent_id = 'inner_a'").collect()}
    assert got["d1"] == (["b"], pytest.approx(math.log(0.5))) and got["d2"] == (["f"], pytest.approx(0.0))
    from lexloom.operators import tree

    failed = spark.createDataFrame([("inner_a",)], "node_id string")
    marks = {r.node_id: (r.failed, r.tainted) for r in reconstruction.mark_fallback_taint(failed, tree.closure(edges)).collect()}
    assert marks["inner_a"] == (True, True) and marks["proto"] == (False, True) and marks["inner_b"] == (False, False)


def plain_ways(children, k):
    """As ``plain``, with (supports, derivations) of each state; children's rows are (output, score, child, candidate, rules)."""
    states = [((), 0.0, {}, [((), ())])]
    for rows in children:
        new = defaultdict(list)
        for state, score, supports, ways in states:
            for out, s, child, cand, fired in rows:
                held = dict(state)
                held[out] = held.get(out, 0) + 1
                own = supports | {out: (*supports.get(out, ()), child)}
                longer = [((*c, cand), tuple(dict.fromkeys((*r, *fired)))) for c, r in ways]
                new[tuple(sorted(held.items()))].append((score + s, own, longer))
        merged = [(state, add([x[0] for x in v]), max(v, key=lambda x: x[0])[1], [w for x in v for w in x[2]][:k]) for state, v in new.items()]
        states = sorted(merged, key=lambda x: (-round(x[1], 12), x[0]))[:k]
    found = {}
    for state, _, supports, ways in states:
        for out, _ in state:
            first, told = found.setdefault(out, (supports[out], []))
            told += [(c, r, supports[out]) for c, r in ways]
    return {out: (first, told[:k]) for out, (first, told) in found.items()}


def test_provenance(spark):
    """Which children give a candidate, and by which candidates and rules, kept through merging and pruning."""
    rng = random.Random(8)
    trace = "array<struct<rule_id:string,n_matches:int>>"
    schema = f"parent_id string, child_id string, child_ordinal int, concept_id string, segments array<string>, rank int, output array<string>, score double, fired boolean, trace {trace}"
    from hashlib import sha256

    rows, want = [], {}
    for concept in ("k0", "k1", "k2"):
        children = []
        for child in range(5):
            if concept == "k1" and child == 2:
                continue
            own = []
            for i in range(rng.randrange(1, 4)):
                source, out = [f"s{i}"], [rng.choice("ab") for _ in range(rng.randrange(1, 3))]
                # No two scores are the same, so that the order of ways is one.
                score, ran = -rng.random(), [(f"r{j}", rng.randrange(2)) for j in range(3)]
                own.append((tuple(out), score, f"c{child}", sha256("s%d".encode() % i).hexdigest()[:12], tuple(r for r, n in ran if n)))
                rows.append(("p", f"c{child}", child, concept, source, i + 1, out, score, True, ran))
            children.append(own)
        want[concept] = plain_ways(children, 3)
    got = reconstruction.combine_children(spark.createDataFrame(rows, schema), 3, provenance=True).collect()
    assert {r.concept_id for r in got} == set(want)
    for r in got:
        first, told = want[r.concept_id][tuple(r.segments)]
        assert tuple(r.supporting_child_ids) == first
        assert [tuple(map(tuple, (d.child_candidate_ids, d.rule_ids, d.supporting_child_ids))) for d in r.derivations] == told


def plain_oracle(leaves, tree, gold, k):
    """Beams ``{node: {concept: [(form, score)]}}``: at each node of ``tree`` (children before parents) maps are learned on the children's best forms."""
    beams = {d: {c: [(f, 0.0)] for c, f in forms.items()} for d, forms in leaves.items()}
    for parent, kids in tree:
        changed = []
        for kid in kids:
            counts, seen = defaultdict(lambda: defaultdict(int)), {}
            for c in sorted(beams[kid]):
                for i, (x, y) in enumerate(zip(*alignment.align(list(beams[kid][c][0][0]), gold[c]), strict=True)):
                    if x is not None:
                        counts[x][y] += 1
                        seen.setdefault((x, y), (c, i))
            left = {x: min(ys, key=lambda y: (-ys[y], seen[x, y])) for x, ys in counts.items()}
            left, order = {x: y for x, y in left.items() if x != y}, []
            while free := sorted(x for x, y in left.items() if y not in left or y == x):
                order += [(x, left.pop(x)) for x in free]
            out = {}
            for c, cands in beams[kid].items():
                out[c] = []
                for form, score in cands:
                    for x, y in order:
                        form = tuple(z for z in (y if s == x else s for s in form) if z is not None)
                    out[c].append((form, score, True))
            changed.append(out)
        beams[parent] = {c: combined([o[c] for o in changed if c in o], k, {}, 0.0) for c in {c for o in changed for c in o}}
    return beams


@pytest.mark.parametrize("k", [1, 5])
def test_oracle_tree(spark, k):
    """Maps, rules and beams of a nested family, level by level, beside a plain version; one map of the leaves would not do."""
    rng, edges = random.Random(5), family(spark)
    gold = {f"k{i}": [rng.choice("aiuptks") for _ in range(rng.randrange(2, 6))] for i in range(14)}
    change = {"d1": {"p": "f"}, "d2": {"p": "f", "t": "θ", "u": None}, "d3": {"k": "x", "s": "k"}, "d4": {"a": "o", "i": "o"}}
    told = {d: {c: tuple(y for y in (change[d].get(s, s) for s in w) if y) for c, w in gold.items()} for d in change}
    told = {d: {c: f for c, f in forms.items() if f and rng.random() < 0.95} for d, forms in told.items()}
    rows = [(i, d, c, list(f)) for d, forms in told.items() for i, (c, f) in enumerate(forms.items())]
    leaves = spark.createDataFrame(rows, "form_id long, variety_id string, concept_id string, segments array<string>")
    target = spark.createDataFrame(list(gold.items()), "concept_id string, segments array<string>")
    got = defaultdict(lambda: defaultdict(dict))
    for r in reconstruction.oracle_tree(leaves, edges, target, k).collect():
        got[r.node_id][r.concept_id][r["rank"]] = (tuple(r.segments), r.log_score)
    want = plain_oracle(told, [("inner_a", ["d1", "d2"]), ("inner_b", ["d3", "d4"]), ("proto", ["inner_a", "inner_b"])], gold, k)
    for node in ("inner_a", "inner_b", "proto"):
        assert set(got[node]) == set(want[node])
        for c, cands in want[node].items():
            mine = [got[node][c][i] for i in range(1, len(got[node][c]) + 1)]
            assert [f for f, _ in mine] == [f for f, _ in cands]
            assert [s for _, s in mine] == pytest.approx([s for _, s in cands])
    assert sum(list(got["proto"][c][1][0]) == w for c, w in gold.items()) >= 8


def test_oracle_trees(spark):
    """A forest of several widths gives each width's own tree, also with copies of forms and colons in ids, in no more jobs than one tree."""
    edges = family(spark).withColumns({c: F.concat(F.lit("x:"), c) for c in ("parent_id", "child_id")})
    rows = [(f"x:{d}", c, list(w)) for d, words in (("d1", "fat kus"), ("d2", "pat kos"), ("d3", "pax kas"), ("d4", "pot tus")) for c, w in zip("ab", words.split(), strict=True) for _ in range(1 + (d == "d2"))]
    rows += [("x:d1", "a", list("pat")), ("x:d3", "b", list("kus")), ("x:d4", "a", list("pat"))]
    leaves = spark.createDataFrame(rows, "variety_id string, concept_id string, segments array<string>")
    gold = spark.createDataFrame([("a", list("pat")), ("b", list("kus"))], "concept_id string, segments array<string>")

    def jobs(build):
        spark.sparkContext.setJobGroup(group := f"trees-{id(build)}", "")
        found = build().collect()
        spark.sparkContext.setJobGroup("none", "")
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    columns = ("node_id", "concept_id", "rank", "segments")
    got, many = jobs(lambda: reconstruction.oracle_trees(leaves, edges, gold, [1, 5]))
    one = 0
    for k in (1, 5):
        want, one = jobs(lambda k=k: reconstruction.oracle_tree(leaves, edges, gold, k))
        want = {tuple(map(str, (r[c] for c in columns))): (r.log_score, r.probability) for r in want}
        mine = {tuple(map(str, (r[c] for c in columns))): (r.log_score, r.probability) for r in got if r.width == k}
        assert set(mine) == set(want)
        assert all(mine[x] == pytest.approx(want[x]) for x in want)
    assert many <= one + 8


def test_circle_of_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1, 1.0), ("b", "a", 1, 1.0)], EDGES)
    proto = spark.createDataFrame([("a", "k", ["x"])], "node_id string, concept_id string, segments array<string>")
    with pytest.raises(ValueError, match="circle"):
        reconstruction.derive_daughters(proto, edges, rules.compile_rules(spark.createDataFrame([], RULES)))
