"""Hand-computed cases of rules, beams and trees."""

import math

from pyspark.sql import functions as F

from lexloom.operators import beam, rules, tree


def cascade(spark, form, dsls):
    compiled = rules.compile_rules(spark.createDataFrame([("n", i, d) for i, d in enumerate(dsls)], "node_id string, rule_ordinal int, dsl string"))
    forms = spark.createDataFrame([("n", form.split())], "node_id string, segments array<string>")
    row = rules.apply_cascade(forms, compiled).first()
    return " ".join(row.output), [t.n_matches for t in row.trace]


def test_cascade(spark):
    assert cascade(spark, "p a p a", ["p > f / # _"]) == ("f a p a", [1])
    assert cascade(spark, "a a a", ["a a > b"]) == ("b a", [2])
    assert cascade(spark, "t a k a", ["t > s", "k > t"]) == ("s a t a", [1, 1])
    assert cascade(spark, "ʔ a ʔ", ["ʔ > Ø / # _"]) == ("a ʔ", [1])
    assert cascade(spark, "a i a", ["a > e / _ i"]) == ("e i a", [1])
    assert cascade(spark, "a", ["b c > d", "a > e / _ #"]) == ("e", [0, 1])


def test_compile_errors(spark):
    bad = {
        "a > b > c": "arrow", "a > b / c / _": "slash", "a > b / c": "focus", "a > b / _ _": "focus", "> b": "target", "Ø > b": "target", "a >": None, "a > b / x # _": "edge",
        "a > a": "no-op", "": "arrow", "a > ∅": None, "a > b / # c _ d #": None, "a > b / #a _": None, "a > b Ø": None, "a# > b": "marker", "a > b_": "marker", "a > b / Ø _": "context",
    }
    rows = rules.compile_rules(spark.createDataFrame([(d,) for d in bad], "dsl string")).collect()
    assert {r.dsl: r.error for r in rows} == bad


def test_compiled_parts(spark):
    """Sides are read as they are written: a # at an edge, and Ø alone."""
    rows = rules.compile_rules(spark.createDataFrame([("a > b / #a _ c#",), (" a b > b Ø ",), ("a >",)], "dsl string")).collect()
    assert [(r.target, r.replacement, r.left, r.right, r.word_initial, r.word_final) for r in rows] == [(["a"], ["b"], ["a"], ["c"], True, True), (["a", "b"], ["b", "Ø"], [], [], False, False), (["a"], [], [], [], False, False)]
    assert [r.c for r in rules.compile_rules(spark.createDataFrame([("a > b / # x _ c d",), ("a >",)], "dsl string")).select(rules.complexity().alias("c")).collect()] == [7, 2]


def results(spark, dsl, *forms):
    compiled = rules.compile_rules(spark.createDataFrame([(dsl,)], "dsl string"))
    table = spark.createDataFrame([(i, f.split()) for i, f in enumerate(forms)], "form_id long, segments array<string>")
    return [(" ".join(r.output), r.status, r.spans, r.target_occurrences, r.emptied) for r in rules.apply_rule(table, compiled).orderBy("form_id").collect()]


def test_results(spark):
    assert results(spark, "a > Ø", "a", "b a", "c", "") == [("", "applied", [0], 1, True), ("b", "applied", [1], 1, False), ("c", "absent", [], 0, False), ("", "absent", [], 0, True)]
    assert results(spark, "a a > b", "a a a") == [("b a", "applied", [0, 1], 2, False)]
    assert results(spark, "a > $1\\ / . _", ". a", "x a", "a") == [(". $1\\", "applied", [1], 1, False), ("x a", "context", [], 1, False), ("a", "context", [], 1, False)]
    assert results(spark, "t > d", "tt t tʃ") == [("tt d tʃ", "applied", [1], 1, False)]
    assert results(spark, "a > b / # c _", "c a") == [("c a", "context", [], 1, False)]  # the edge holds for the target itself


def test_spread_and_contradictions(spark):
    from lexloom.operators import runs

    law = spark.createDataFrame([("r", "x", 0.9), ("r", "y", 0.6), ("s", "x", 0.9), ("s", "y", 0.8), ("t", "x", 0.1)], "rule_id string, node_id string, confidence double")
    assert [(r.rule_id, r.n_nodes, round(r.spread, 9)) for r in runs.confidence_spread(law).collect()] == [("r", 2, 0.3)]
    parts = "node_id string, target array<string>, left array<string>, right array<string>, word_initial boolean, word_final boolean, replacement array<string>"
    rows = [("p", ["a"], [], [], False, False, ["e"]), ("c", ["a"], [], [], False, False, ["o"]), ("d", ["a"], [], [], True, False, ["o"]), ("e", ["a"], [], [], False, False, ["e"])]
    edges = spark.createDataFrame([("p", "c"), ("p", "d"), ("p", "e")], "parent_id string, child_id string")
    assert [(r.child_id, r.parent_to, r.child_to) for r in runs.contradictory_mappings(spark.createDataFrame(rows, parts), edges).collect()] == [("c", ["e"], ["o"])]


def test_beam(spark):
    rows = [("k", ["a", "k"], 0.0)] * 4 + [("k", ["a", "W"], 0.0), ("k", [], 0.0), ("k", ["x"], float("nan")), ("k", ["x"], None)]
    got = beam.merge_prune_normalize(spark.createDataFrame(rows, "key string, segments array<string>, log_score double"), ["key"], 5).orderBy("rank").collect()
    assert [(r.segments, round(r.probability, 9)) for r in got] == [(["a", "k"], 0.8), (["a", "W"], 0.2)]
    assert abs(got[0].log_score - math.log(4)) < 1e-12


def test_tree(spark):
    edges = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("a", "c", 1), ("a", "d", 2)], "parent_id string, child_id string, child_ordinal int")
    assert {(r.node_id, r.height, tuple(r.children)) for r in tree.node_levels(edges).collect()} == {("r", 2, ("a", "b")), ("a", 1, ("c", "d"))}
    assert {(r.node_id, r.clade_id, r.leaf_id) for r in tree.outgroups(edges).collect()} == {("a", "b", "b"), ("b", "a", "c"), ("b", "a", "d"), ("c", "b", "b"), ("d", "b", "b"), ("c", "d", "d"), ("d", "c", "c")}
    assert tree.closure(edges).where(F.col("depth") == 2).count() == 2
