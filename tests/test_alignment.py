"""Alignment, correspondences and what builds on them, against small brute-force versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexloom import queries_history
from lexloom.operators import alignment, clustering, evaluation
from lexloom.sources import views

FORM = "concept_id string, cognate_set_id string, form_id long, variety_id string, segments array<string>"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


def words(n, seed, alphabet=("a", "e", "tʃ", "t", "ʃ", "aa")):
    rng = random.Random(seed)
    return [[rng.choice(alphabet) for _ in range(rng.randrange(0, 7))] for _ in range(n)]


def test_pairs(spark):
    cases = [("p a t a", "b a d a", [("p", "b"), ("a", "a"), ("t", "d"), ("a", "a")]), ("a b", "b", [("a", None), ("b", "b")]), ("", "a", [(None, "a")]), ("a a", "a", [("a", None), ("a", "a")])]
    for left, right, want in cases:
        x, y = alignment.align(left.split(), right.split())
        assert list(zip(x, y)) == want
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(words(80, 1), words(80, 2)))] + [(900, None, ["a"]), (901, [], []), (901, [], [])]
    rows = alignment.align_pairs(spark.createDataFrame(pairs, "id int, left array<string>, right array<string>")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        x, y = list(r.left or []), list(r.right or [])
        assert [t for t in r.aligned_left if t is not None] == x and [t for t in r.aligned_right if t is not None] == y
        assert sum(s != t for s, t in zip(r.aligned_left, r.aligned_right, strict=True)) == distance(x, y)
        assert not any(s is None and t is None for s, t in zip(r.aligned_left, r.aligned_right))


def test_distance_in_tokens(spark):
    pairs = [(a, b) for a, b in zip(words(60, 3), words(60, 4))] + [(["t", "ʃ"], ["tʃ"]), ([], [])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("*", evaluation.edit_distance(F.col("a"), F.col("b")).alias("d"), evaluation.normalized_edit_distance(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.d == distance(r.a, r.b)
        assert r.n == pytest.approx(distance(r.a, r.b) / max(len(r.a), len(r.b), 1))


def test_bcubed(spark):
    rows = [(["p", "a"], ["b", "e"]), (["a", "a"], ["b", "e"]), ([], []), (["a"], [])]
    got = evaluation.bcubed(spark.createDataFrame(rows, "left array<string>, right array<string>")).collect()
    by = {(tuple(r.left), tuple(r.right)): (r.precision, r.recall, r.f1) for r in got}
    assert by[("p", "a"), ("b", "e")] == (1.0, 1.0, 1.0)
    assert by[("a", "a"), ("b", "e")] == (0.5, 1.0, pytest.approx(2 / 3))
    assert by[(), ()] == (1.0, 1.0, 1.0) and by[("a",), ()] == (1.0, 1.0, 1.0)


def test_groups(spark):
    rng = random.Random(7)
    rows = []
    for c, s in itertools.product(["c1", "c2", "c3"], ["x", None]):
        for k in range(rng.randrange(1, 9)):
            rows.append((c, s, len(rows), f"v{rng.randrange(4)}", [rng.choice("abcd") for _ in range(rng.randrange(1, 8))]))
    rows += [("c9", "x", 900, "v1", ["a"]), ("c9", "x", 901, "v1", ["b"])]  # one variety: no group
    got = alignment.align_groups(spark.createDataFrame(rows, FORM)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    want = {k: v for k, v in groups.items() if len({r[3] for r in v}) > 1}
    assert sorted(r.form_id for r in got) == sorted(r[2] for v in want.values() for r in v)
    texts = {r[2]: r[4] for r in rows}
    for key, members in want.items():
        mine = [r for r in got if (r.concept_id, r.cognate_set_id) == key]
        assert len({len(r.aligned) for r in mine}) == 1 and len({r.alignment_id for r in mine}) == 1
        assert all([t for t in r.aligned if t is not None] == texts[r.form_id] for r in mine)
        assert all(any(r.aligned[i] is not None for r in mine) for i in range(len(mine[0].aligned)))
    equal = spark.createDataFrame([("c", "s", i, f"v{i}", list("abc")) for i in range(3)], FORM)
    assert {tuple(r.aligned) for r in alignment.align_groups(equal).collect()} == {("a", "b", "c")}
    anchored = alignment.align_groups(equal, spark.createDataFrame([("c", "s", 50, "z", list("ab")), ("q", "s", 51, "z", list("ab"))], FORM)).collect()
    assert [(r.form_id, r.variety_id, tuple(r.aligned)) for r in anchored if r.is_anchor] == [(50, None, ("a", "b", None))]


def test_segment_map_and_rules(spark):
    pairs = [("b", i, list(x), list(y)) for i, (x, y) in enumerate([("kat", "tas"), ("kik", "tit"), ("ta", "sa"), ("pu", "u")])]
    maps = alignment.segment_map(spark.createDataFrame(pairs, "child_id string, ordinal int, left array<string>, right array<string>"), ["child_id"])
    assert {(r.source, r.target) for r in maps.collect()} == {("k", "t"), ("a", "a"), ("t", "s"), ("i", "i"), ("p", None), ("u", "u")}
    order = {r.source: r.rule_ordinal for r in alignment.oracle_rules(maps, ["child_id"]).collect()}
    assert set(order) == {"k", "t", "p"} and order["t"] < order["k"]  # else k > t feeds t > s
    circle = spark.createDataFrame([("b", "x", "y"), ("b", "y", "x"), ("b", "q", "x"), ("b", "+", "a")], "child_id string, source string, target string")
    assert [r.source for r in alignment.oracle_rules(circle, ["child_id"]).collect()] == []
    chain = spark.createDataFrame([("b", "x", "y"), ("b", "y", "z")], "child_id string, source string, target string")
    assert [r.source for r in alignment.oracle_rules(chain, ["child_id"]).orderBy("rule_ordinal").collect()] == ["y", "x"]


def test_clustering(spark):
    # Distances along the tree ((a:1, b:1):2, (c:2, d:2):1).
    rows = [("a", "b", 2.0), ("a", "c", 6.0), ("a", "d", 6.0), ("b", "c", 6.0), ("b", "d", 6.0), ("c", "d", 4.0)]
    for method in ("upgma", "neighbor"):
        df = spark.createDataFrame([(k, *r) for k in ("x", "y") for r in rows], "g string, taxon_a string, taxon_b string, distance double")
        edges = [r for r in clustering.cluster_trees(df, ["g"], method).collect() if r.g == "x"]
        up = {r.child_id: (r.parent_id, r.branch_length) for r in edges}

        def path(node):
            found, total = {node: 0.0}, 0.0
            while node in up:
                total += up[node][1]
                node = up[node][0]
                found[node] = total
            return found

        for a, b, d in rows:
            x, y = path(a), path(b)
            assert min(x[n] + y[n] for n in x.keys() & y.keys()) == pytest.approx(d)
    with pytest.raises(Exception, match="lacks a pair"):
        clustering.cluster_trees(spark.createDataFrame([("x", "a", "b", 1.0), ("x", "b", "c", 1.0)], "g string, taxon_a string, taxon_b string, distance double"), ["g"]).collect()


def test_pairs_of_classes(spark, tmp_path):
    """Twice the forms are twice the members and the same pairs; both joined give each form with each gold form."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.withColumn("p_partkey", F.col("p_partkey") + 1000).union(part).write.parquet(str(tmp_path / "part.parquet"))
    for query, solved in ((queries_history.aligned_pairs, ["aligned_left", "aligned_right"]), (queries_history.bcubed_scores, ["precision", "recall", "f1"])):
        once, twice = query(spark, "/root/testdata/sf0.001").cache(), query(spark, str(tmp_path)).cache()
        pairs = lambda rows: sorted(map(str, rows.where("part = 'pair'").select("concept_id", "left", "right", *solved).collect()))
        assert pairs(once) == pairs(twice) and pairs(once)
        assert twice.where("part <> 'pair'").count() == 2 * once.where("part <> 'pair'").count() == 2 * part.count()
        own, gold = twice.where("part = 'form'").select("form_id", "class_id"), twice.where("part = 'gold'").select(F.col("class_id").alias("gold_class_id"))
        got = twice.where("part = 'pair'").drop("form_id").join(own, "class_id").join(gold, "gold_class_id").select("form_id", "concept_id", "left", "right")
        forms = views.forms(spark, str(tmp_path))
        right = forms.where("variety_id = 'Brand#25'").select("concept_id", F.col("segments").alias("right"))
        want = forms.where("variety_id <> 'Brand#25'").select("form_id", "concept_id", F.col("segments").alias("left")).join(right, "concept_id").select(got.columns)
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_copies_of_members(spark, monkeypatch):
    """The last member of a variety decides a column, of whatever width; members that decide none are not taken apart."""
    rng = random.Random(5)
    rows = [("c", f"s{i % 2}", i, f"v{i % 3}", [rng.choice(["a", "b", None]) for _ in range(3 + i % 2 * (i % 5 == 0))]) for i in range(300)]
    rows += [("c", "s0", None, "v0", ["q", "q", "q", "q", "q"]), ("c", None, 999, "v1", ["z"]), ("c", "s0", 297, "v0", ["b", "b", "b"])]
    members, plain, seen = spark.createDataFrame(rows, FORM.replace("segments", "aligned")), alignment.columns, []
    monkeypatch.setattr(alignment, "columns", lambda m: (seen.append(m), plain(m))[1])
    got = {tuple(r.segments): r.support for r in alignment.correspondence_sets(members, ["v0", "v1", "v2"]).collect()}
    cells = {}
    for c, s, form, v, aligned in rows:
        for i, segment in enumerate(aligned):
            cells[c, s, i, v] = max(cells.get((c, s, i, v), ((-1, ""), None)), ((-1 if form is None else form, segment or ""), segment), key=lambda x: x[0])
    want = {}
    for key in {k[:3] for k in cells}:
        shown = tuple(cells.get((*key, v), (None, None))[1] for v in ("v0", "v1", "v2"))
        if any(shown):
            want[shown] = want.get(shown, 0) + 1
    assert got == want and seen[0].count() <= 20


def test_copies_of_pairs(spark, monkeypatch):
    """Equal pairs are counted before they are aligned, and count as often as they are there; a null ordinal is the first."""
    kind = "child_id string, concept_id string, ordinal int, left array<string>, right array<string>"
    rows = [("b", "k", 5 + i, ["x", "y"], ["p", "q"]) for i in range(100)] + [("b", "k", i + 1000, ["x", "x"], ["r", "p"]) for i in range(99)] + [("d", "k", 1, ["x"], ["p"]), ("d", "k", None, ["x"], ["r"])]
    pairs, plain, seen = spark.createDataFrame(rows, kind), alignment.align_pairs, []
    for m in (alignment, evaluation):
        monkeypatch.setattr(m, "align_pairs", lambda p: (seen.append(p), plain(p))[1])
    got = {(r.child_id, r.source): (r.target, r.n) for r in alignment.segment_map(pairs, ["child_id"]).collect()}
    assert got == {("b", "x"): ("p", 199), ("b", "y"): ("q", 100), ("d", "x"): ("r", 1)}
    _, deletions = evaluation.recoverability(pairs)
    assert {tuple(r) for r in deletions.collect()} == {("b", 199, 0), ("d", 2, 0)}
    assert [s.count() for s in seen] == [4, 4, 4]
