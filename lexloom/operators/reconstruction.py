"""Ancestor forms: beams of children under their cascades, combined node by node."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.operators import beam, rules as law, tree
from lexloom.operators.alignment import oracle_rules, segment_map
from lexloom.plans.scratch import Scratch

KEY = ["parent_id", "concept_id"]
#: Rounds after which the states of a combination are saved.
SAVED = 5
POLICIES = ("ignore", "advisory", "scored")


def anchor_boost(policy: str, factor: float = 100.0) -> float:
    """What one matched anchor adds to a score: the log of ``factor`` where anchors are scored, else 0."""
    if policy not in POLICIES or not 1 <= factor < math.inf:
        raise ValueError(f"policy is one of {POLICIES}, factor finite and 1 or more")
    return math.log(factor) if policy == "scored" else 0.0


def transform_children(beams: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates ``node_id, concept_id, segments, log_score, rank`` of children, under the cascade of their branch.

    Gives ``parent_id, child_id, child_ordinal, concept_id, segments, rank, output, score, fired, trace``;
    ``score`` adds the log of the confidence of each rule that fired.
    """
    up = beams.withColumnRenamed("node_id", "child_id").join(edges.select("parent_id", "child_id", "child_ordinal"), "child_id")
    done = law.apply_cascade(up, rules.withColumnRenamed("node_id", "_n").withColumnRenamed("_n", "node_id"), "parent_id", "child_id")
    fired = F.filter("trace", lambda t: t["n_matches"] > 0)
    gain = F.aggregate(fired, F.lit(0.0), lambda s, t: s + F.log(t["confidence"]))
    return done.select("parent_id", "child_id", "child_ordinal", "concept_id", "segments", "rank", "output", (F.col("log_score") + gain).alias("score"), (F.size(fired) > 0).alias("fired"), "trace")


def _kept(k: int | Callable[[Column], Column], node: str) -> int | Column:
    return k(F.col(node)) if callable(k) else k


def _provenance_rows(children: DataFrame) -> list[Column]:
    """What a child's candidate brings to a derivation: the child, the candidate's id and rank, and the rules that fired on it."""
    fired = F.transform(F.filter("trace", lambda t: t["n_matches"] > 0), lambda t: t["rule_id"])
    return [F.col("child_id").alias("_child"), beam.candidate_id().alias("_candidate"), F.col("rank").alias("_at"), fired.alias("_rules")]


def combine_children(
    children: DataFrame, k: int | Callable[[Column], Column], anchors: DataFrame | None = None, policy: str = "advisory", factor: float = 100.0, provenance: bool = False
) -> DataFrame:
    """Transformed children to the beam of each parent: ``node_id, concept_id, segments, log_score, rank, probability``.

    Children with candidates for a concept are taken in their order, all parents and concepts at once. A
    partial state counts, for each output, the children that gave it; states with equal counts and anchors
    merge by log-sum-exp, and the k best stay. At the end each output of a state gets the state's score plus
    the log of its share of children, plus the boost of matched anchors: those of ``anchors(node_id,
    concept_id, segments)`` that equal it, if a rule fired to reach it. ``k`` may be a function of the parent's id.

    With ``provenance`` there are also ``supporting_child_ids``, the children that gave the candidate in the best state that
    has it, and ``derivations``, at most k of ``(child_candidate_ids, rule_ids, supporting_child_ids)``. Where states merge,
    the best one's children stay, and the first k derivations, those of better states and candidates first; so they stay
    few however many ways lead to a form.
    """
    boost = anchor_boost(policy, factor)
    place = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("child_ordinal", "child_id"))
    origin = _provenance_rows(children) if provenance else []
    rows = children.select(*KEY, place.alias("_round"), F.col("output").alias("seg"), "score", "fired", *origin)
    hits = F.lit(0)
    if anchors is not None and policy != "ignore":
        own = anchors.groupBy(F.col("node_id").alias("parent_id"), "concept_id", F.col("segments").alias("seg")).agg(F.count("*").cast("int").alias("_hits"))
        rows = rows.join(own, [*KEY, "seg"], "left")
        hits = F.when(F.col("fired"), F.coalesce("_hits", F.lit(0))).otherwise(0)
    scratch = Scratch(children.sparkSession)
    named = ["_child", "_candidate", "_at", "_rules"] if provenance else []
    rows = scratch.save(rows.select(*KEY, "_round", "seg", "score", hits.cast("int").alias("hits"), *named).where("score is not null"))
    rounds = rows.agg(F.max("_round")).first()[0] or 0
    one = F.array(F.struct(F.col("seg").alias("seg"), F.lit(1).alias("n"), F.col("hits").alias("hits")))

    def pruned(states: DataFrame) -> DataFrame:
        same = Window.partitionBy(*KEY, "state")
        more = []
        if provenance:
            # The way to a state: from which of the former ones, by which candidate.
            way = F.struct("_before_rank", "_at")
            first = F.struct(F.col("score"), -F.col("_before_rank"), -F.col("_at"))
            listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(way.alias("way"), F.col("derivations").alias("d")))), lambda x: x["d"]))
            more = [F.max_by("supports", first).alias("supports"), F.slice(listed, 1, _kept(k, "parent_id")).alias("derivations")]
        merged = states.withColumn("_m", F.max("score").over(same)).groupBy(*KEY, "state", "_m").agg(F.sum(F.exp(F.col("score") - F.col("_m"))).alias("_s"), *more)
        merged = merged.select(*KEY, "state", (F.col("_m") + F.log("_s")).alias("score"), *(["supports", "derivations"] if provenance else []))
        best = F.round(F.col("score") + F.array_max(F.transform("state", lambda s: s["hits"])) * boost, beam.PLACES)
        order = Window.partitionBy(*KEY).orderBy(F.desc(best), "state")
        ranked = merged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= _kept(k, "parent_id"))
        return ranked if provenance else ranked.drop("_r")

    def begun(here: DataFrame) -> DataFrame:
        if not provenance:
            return here.select(*KEY, one.alias("state"), "score")
        alone = F.struct(F.array("_candidate").alias("child_candidate_ids"), F.col("_rules").alias("rule_ids"))
        support = F.create_map("seg", F.array("_child"))
        return here.select(*KEY, one.alias("state"), "score", F.lit(0).alias("_before_rank"), "_at", support.alias("supports"), F.array(alone).alias("derivations"))

    states = None
    for number in range(1, rounds + 1):
        here = rows.where(F.col("_round") == number)
        if states is None:
            states = pruned(begun(here))
            continue
        met = states.withColumnsRenamed({"score": "_before", "_r": "_before_rank"}).join(here, KEY, "left")
        held = lambda name: F.coalesce(F.get(F.filter("state", lambda s: s["seg"] == F.col("seg")), F.lit(0))[name], F.lit(0))
        added = F.array_sort(F.concat(
            F.filter("state", lambda s: s["seg"] != F.col("seg")),
            F.array(F.struct(F.col("seg").alias("seg"), (F.lit(1) + held("n")).alias("n"), F.greatest(F.col("hits"), held("hits")).alias("hits"))),
        ))
        gone = F.col("seg").isNull()  # the concept has no further child
        more = []
        if provenance:
            own = F.concat(F.coalesce(F.element_at("supports", F.col("seg")), F.array().cast("array<string>")), F.array("_child"))
            supports = F.map_concat(F.map_filter("supports", lambda s, _: s != F.col("seg")), F.create_map("seg", own))
            longer = F.transform("derivations", lambda d: F.struct(
                F.concat(d["child_candidate_ids"], F.array("_candidate")).alias("child_candidate_ids"), F.array_distinct(F.concat(d["rule_ids"], F.col("_rules"))).alias("rule_ids"),
            ))
            kept = lambda new, old: F.when(gone, F.col(old)).otherwise(new).alias(old)
            more = ["_before_rank", F.coalesce("_at", F.lit(0)).alias("_at"), kept(supports, "supports"), kept(longer, "derivations")]
        score = F.when(gone, F.col("_before")).otherwise(F.col("_before") + F.col("score"))
        states = pruned(met.select(*KEY, F.when(gone, F.col("state")).otherwise(added).alias("state"), score.alias("score"), *more))
        if number % SAVED == 0:
            states = scratch.save(states)  # a round reads the one before once, so plans stay short and linear
    if states is None:
        states = begun(rows).withColumn("_r", F.lit(1))
    total = F.aggregate("state", F.lit(0), lambda n, s: n + s["n"])
    outputs = states.select(F.col("parent_id").alias("node_id"), "concept_id", "score", total.alias("total"), F.explode("state").alias("s"), *(["_r", "supports", "derivations"] if provenance else []))
    log_score = F.col("score") + F.log("s.n") - F.log("total") + F.col("s.hits") * boost
    raw = outputs.select("node_id", "concept_id", F.col("s.seg").alias("segments"), log_score.alias("log_score"))
    found = beam.merge_prune_normalize(raw, ["node_id", "concept_id"], _kept(k, "node_id"))
    if not provenance:
        return found
    support = F.element_at("supports", F.col("s.seg"))
    told = F.transform("derivations", lambda d: F.struct(d["child_candidate_ids"].alias("child_candidate_ids"), d["rule_ids"].alias("rule_ids"), support.alias("supporting_child_ids")))
    each = outputs.select("node_id", "concept_id", F.col("s.seg").alias("segments"), "_r", support.alias("supporting"), told.alias("d"))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_r", "d"))), lambda x: x["d"]))
    per = each.groupBy("node_id", "concept_id", "segments").agg(F.min_by("supporting", "_r").alias("supporting_child_ids"), F.slice(listed, 1, _kept(k, "node_id")).alias("derivations"))
    return found.join(per, ["node_id", "concept_id", "segments"])


def reconstruct_tree(
    forms: DataFrame, edges: DataFrame, rules: DataFrame | Callable[[DataFrame, DataFrame], DataFrame], k: int | Callable[[Column], Column], anchors: DataFrame | None = None,
    policy: str = "advisory", factor: float = 100.0, provenance: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Beams of all nodes, from the leaves up, and the transformed children of all parents.

    All nodes of a height are one job, saved before the next height reads it. Rules are compiled, and may be
    scoped by ``source_child_ids``; a node without rules passes its children's forms on. ``rules`` may also make them from
    what has been rebuilt so far: it gets the beams of the children of the next height's nodes, and the edges to them.
    ``k`` may be a function of a node's id.
    With ``provenance`` inner nodes have the columns of :func:`combine_children`; leaves have nulls there.
    """
    scratch = Scratch(forms.sparkSession)
    edges = scratch.save(edges)
    levels = scratch.save(tree.node_levels(edges).where("height > 0").select(F.col("node_id").alias("parent_id"), "height"))
    columns = ["node_id", "concept_id", "segments", "log_score", "rank", "probability"] + (["supporting_child_ids", "derivations"] if provenance else [])
    leaves = beam.leaf_beam(forms, _kept(k, "variety_id")).withColumnRenamed("variety_id", "node_id")
    if provenance:
        ways = "array<struct<child_candidate_ids:array<string>,rule_ids:array<string>,supporting_child_ids:array<string>>>"
        leaves = leaves.withColumns({"supporting_child_ids": F.lit(None).cast("array<string>"), "derivations": F.lit(None).cast(ways)})
    beams = [scratch.save(leaves.select(*columns))]
    traces = []
    for height in range(1, (levels.agg(F.max("height")).first()[0] or 0) + 1):
        own = edges.join(levels.where(F.col("height") == height).select("parent_id"), "parent_id", "left_semi")
        below = reduce(DataFrame.unionByName, beams).join(own.select(F.col("child_id").alias("node_id")), "node_id", "left_semi")
        law_of = scratch.save(rules(below, own)) if callable(rules) else rules
        traces.append(scratch.save(transform_children(below, own, law_of)))
        beams.append(scratch.save(combine_children(traces[-1], k, anchors, policy, factor, provenance).select(*columns)))
    return reduce(DataFrame.unionByName, beams), reduce(DataFrame.unionByName, traces) if traces else None


def oracle_trees(forms: DataFrame, edges: DataFrame, gold: DataFrame, widths: list[int]) -> DataFrame:
    """:func:`oracle_tree` at several widths at once, as one forest with a tree for each; adds ``width``.

    Different forms are counted once for all trees.
    """
    trees = F.explode(F.array(*map(F.lit, sorted(set(widths))))).alias("_width")
    name = lambda node: F.concat_ws(":", "_width", node).alias(node)
    width = lambda node: F.split_part(node, F.lit(":"), F.lit(1)).cast("int")
    each = Scratch(forms.sparkSession).save(beam.counted(forms)).select("*", trees).select(name("variety_id"), "concept_id", "segments", "copies")
    forest = edges.select("*", trees).select(name("parent_id"), name("child_id"), "child_ordinal", "branch_length")
    beams = _oracle_forest(each, forest, gold, width)
    return beams.withColumns({"width": width(F.col("node_id")), "node_id": F.substring("node_id", F.locate(":", "node_id") + 1, F.length("node_id"))})


def oracle_tree(forms: DataFrame, edges: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Beams of all nodes under the best rules that single segments allow: those that lead each branch to the gold forms.

    At each height the branches' best forms (as rebuilt so far) are aligned with ``gold(concept_id, segments)``, their maps
    become ordered rules, and the children are combined under these; then follows the next height. A branch's rules hold for
    it alone. The best form of a leaf is its most frequent one.
    """
    return _oracle_forest(forms, edges, gold, k)


def _oracle_forest(forms: DataFrame, edges: DataFrame, gold: DataFrame, k: int | Callable[[Column], Column]) -> DataFrame:
    want = gold.groupBy("concept_id").agg(F.min("segments").alias("right"))

    def learned(below: DataFrame, own: DataFrame) -> DataFrame:
        pairs = below.where("rank = 1").select(F.col("node_id").alias("child_id"), "concept_id", F.col("concept_id").alias("ordinal"), F.col("segments").alias("left")).join(want, "concept_id")
        found = oracle_rules(segment_map(pairs, ["child_id"]), ["child_id"]).join(own.select("parent_id", "child_id"), "child_id")
        dsl = F.concat("source", F.lit(" > "), F.coalesce("target", F.lit("Ø")))
        return law.compile_rules(found.select(F.col("parent_id").alias("node_id"), "rule_ordinal", dsl.alias("dsl"), F.array("child_id").alias("source_child_ids"), F.lit(1.0).alias("confidence")))

    return reconstruct_tree(forms, edges, learned, k)[0]


def branch_support(children: DataFrame, beams: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, concept_id, support``: share of all children of a node whose own best form becomes the winner."""
    winner = beams.where("rank = 1").select(F.col("node_id").alias("parent_id"), "concept_id", F.col("segments").alias("_w"))
    all_ = edges.groupBy("parent_id").agg(F.count("*").alias("_n"))
    top = children.where("rank = 1").join(winner, KEY).groupBy(*KEY).agg(F.count_if(F.col("output") == F.col("_w")).alias("_s"))
    return top.join(all_, "parent_id").select(F.col("parent_id").alias("node_id"), "concept_id", (F.col("_s") / F.col("_n")).alias("support"))


def heldout_convergence(cascaded: DataFrame, held: DataFrame) -> DataFrame:
    """Per node over its held-out concepts: convergence, and how rules fared.

    ``cascaded(parent_id, child_id, concept_id, output, trace)``, ``held(node_id, concept_id)``.
    """
    rows = cascaded.join(held.select(F.col("node_id").alias("parent_id"), "concept_id").distinct(), KEY, "left_semi")
    agreed = law.convergence_rate(law.convergence(rows)).drop("divergent_ids")
    steps = rows.select("parent_id", F.explode("trace").alias("t"))
    fired, there = F.col("t.n_matches") > 0, F.col("t.n_targets") > 0
    fared = steps.groupBy("parent_id").agg(F.count_if(fired).alias("n_applied"), F.count_if(~there).alias("n_absent"), F.count_if(~fired & there).alias("n_mismatched"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_applied", "n_absent", "n_mismatched")]
    return agreed.join(fared, "parent_id", "left").select("parent_id", "n_concepts", "n_converging", "n_divergent", *counts)


def node_diagnostics(children: DataFrame, anomalies: DataFrame, contrasts: DataFrame, inspected: DataFrame) -> DataFrame:
    """Per node: different rule results by outcome, coverage, anomaly rate, contrasts given up, and concepts looked at.

    ``anomalies(node_id)`` and ``inspected(node_id, concept_id)`` have one row each; ``contrasts(node_id,
    rule_id)``. Coverage is applied over applicable results: those whose target occurs.
    """
    steps = children.select("parent_id", "child_id", "concept_id", "segments", F.explode("trace").alias("t")).select("parent_id", "child_id", "concept_id", "segments", "t.rule_id", "t.input", "t.output", "t.n_matches", "t.n_targets").distinct()
    fired, there = F.col("n_matches") > 0, F.col("n_targets") > 0
    fared = steps.groupBy("parent_id").agg(F.count("*").alias("n_results"), F.count_if(fired).alias("n_applied"), F.count_if(~there).alias("n_absent"), F.count_if(~fired & there).alias("n_mismatched"))
    concepts = children.select(*KEY).distinct()
    counts = concepts.groupBy("parent_id").agg(F.count("*").alias("n_concepts"))
    looked = inspected.select(F.col("node_id").alias("parent_id"), "concept_id").distinct().join(concepts, KEY, "left_semi").groupBy("parent_id").agg(F.count("*").alias("n_inspected"))
    odd = anomalies.groupBy(F.col("node_id").alias("parent_id")).agg(F.count("*").alias("n_anomalies"))
    lost = contrasts.groupBy(F.col("node_id").alias("parent_id")).agg(F.count_distinct("rule_id").alias("n_contrasts"))
    out = reduce(lambda a, b: a.join(b, "parent_id", "left"), [counts, fared, looked, odd, lost])
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_concepts", "n_results", "n_applied", "n_absent", "n_mismatched", "n_inspected", "n_anomalies", "n_contrasts")]
    out = out.select(F.col("parent_id").alias("node_id"), *filled)
    return out.withColumns({"coverage": F.coalesce(F.try_divide("n_applied", F.col("n_results") - F.col("n_absent")), F.lit(0.0)), "anomaly_rate": F.col("n_anomalies") / F.col("n_concepts")})


def mark_fallback_taint(failures: DataFrame, paths: DataFrame) -> DataFrame:
    """``node_id, failed, tainted`` of all nodes of a closure: a failed node, and every node above one, is tainted."""
    bad = failures.select(F.col("node_id").alias("descendant_id")).distinct().withColumn("_bad", F.lit(True))
    marked = paths.join(bad, "descendant_id", "left")
    here = F.col("_bad").isNotNull()
    return marked.groupBy(F.col("ancestor_id").alias("node_id")).agg(F.bool_or(here & (F.col("depth") == 0)).alias("failed"), F.bool_or(here).alias("tainted"))


def derive_daughters(proto: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Forms of all nodes, from ``proto(node_id, concept_id, segments)`` of the root down: ``node_id, concept_id, segments``.

    The cascade of a node (``rules.node_id``) turns its parent's forms into its own. Edges that hold a circle are an error.
    """
    scratch = Scratch(proto.sparkSession)
    step = scratch.save(edges.select("parent_id", "child_id"))
    most = step.count()
    level = scratch.save(proto.select("node_id", "concept_id", "segments"))
    found = [level]
    while True:
        down = level.join(step, F.col("node_id") == F.col("parent_id")).select(F.col("child_id").alias("node_id"), "concept_id", "segments")
        level = scratch.save(law.apply_cascade(down, rules).select("node_id", "concept_id", F.col("output").alias("segments")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(level)
        if len(found) > most + 1:
            raise ValueError("the edges hold a circle")


def invert_and_verify(forms: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """``child_id, invertible``: whether the swapped, reversed cascade of a branch gives back every parent form.

    ``forms`` are those of :func:`derive_daughters`. Forms are compared concept by concept, as sets; a branch
    with a rule that cannot be swapped is not invertible, one without rules is.
    """
    back = law.invert(rules)
    broken = back.where("error is not null").select(F.col("node_id").alias("child_id")).distinct().withColumn("_broken", F.lit(True))
    down = edges.select("parent_id", "child_id").join(forms.withColumnsRenamed({"node_id": "child_id", "segments": "own"}), "child_id")
    undone = law.apply_cascade(down.withColumnRenamed("own", "segments"), back, "child_id")
    got = undone.groupBy("parent_id", "child_id", "concept_id").agg(F.array_sort(F.collect_set("output")).alias("got"))
    want = forms.groupBy(F.col("node_id").alias("parent_id"), "concept_id").agg(F.array_sort(F.collect_set("segments")).alias("want"))
    same = got.join(want, ["parent_id", "concept_id"]).groupBy("child_id").agg(F.bool_and(F.col("got") == F.col("want")).alias("same"))
    return same.join(broken, "child_id", "left").select("child_id", (F.col("same") & F.col("_broken").isNull()).alias("invertible"))
