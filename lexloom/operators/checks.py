"""Integrity checks. Each gives one row for each violation, and no row for sound tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

BOUNDARIES = ("+", "-")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _said(rows: DataFrame, violation: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.lit(violation).alias("violation"))


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")


def check_forms(forms: DataFrame, memberships: DataFrame, varieties: DataFrame) -> DataFrame:
    """``form_id, violation`` of forms and of judgements (``form_id, scope, interpretation, segment_indices``)."""
    joined = memberships.join(forms.select("form_id", "segments"), "form_id")
    partial = F.col("scope") == "segment_slice"
    outside = F.exists("segment_indices", lambda i: (i < 0) | (i >= F.size("segments")))
    only_edges = (F.size("segment_indices") > 0) & F.forall("segment_indices", lambda i: F.get("segments", i).isin(*BOUNDARIES))
    return _all([
        _said(_repeated(forms, "variety_id", "form_id"), "repeated id", "form_id"),
        _said(forms.join(varieties, "variety_id", "left_anti"), "foreign variety", "form_id"),
        _said(joined.where(partial & outside), "index outside the form", "form_id"),
        _said(joined.where(partial & ~outside & only_edges), "slice of boundaries", "form_id"),
        _said(memberships.where(~partial & (F.size("segment_indices") > 0)), "whole form with indices", "form_id"),
        _said(memberships.where(partial & (F.col("interpretation") != "partial_cognate")), "slice that is not partial", "form_id"),
    ])


def check_unique_ids(varieties: DataFrame, concepts: DataFrame, bindings: DataFrame) -> DataFrame:
    """``kind, id, violation``: ids that a payload holds more than once."""
    kinds = [("variety", varieties, "variety_id"), ("concept", concepts, "concept_id"), ("source", bindings, "source_variety_id")]
    return _all([_said(_repeated(df, c).withColumn("kind", F.lit(kind)).withColumnRenamed(c, "id"), "repeated id", "kind", "id") for kind, df, c in kinds])


def check_alignments(members: DataFrame, pairwise: DataFrame) -> DataFrame:
    """``alignment_id, violation``: rows of unequal width, and pairwise views of unknown alignments."""
    uneven = members.groupBy("alignment_id").agg(F.count_distinct(F.size("aligned")).alias("_n")).where("_n > 1")
    unknown = pairwise.select("alignment_id").distinct().join(members, "alignment_id", "left_anti")
    return _said(uneven, "unequal width", "alignment_id").unionByName(_said(unknown, "unknown alignment", "alignment_id"))


def check_beam(candidates: DataFrame, keys: list[str], k: int, within: float = 1e-8) -> DataFrame:
    """``keys, violation`` of ``candidates(keys, segments, probability, rank)``."""
    whole = candidates.groupBy(*keys).agg(
        F.sum("probability").alias("_sum"),
        F.count("*").alias("_n"),
        F.count_distinct("segments").alias("_different"),
        F.array_sort(F.collect_list(F.struct("rank", "probability"))).alias("_by_rank"),
    )
    before = lambda i: F.get("_by_rank", i)["probability"] < F.get("_by_rank", i + 1)["probability"]
    rising = F.when(F.col("_n") > 1, F.exists(F.sequence(F.lit(0), F.col("_n").cast("int") - 2), before)).otherwise(False)
    return _all([
        _said(whole.where("_different < _n"), "repeated segments", *keys),
        _said(whole.where(F.abs(F.col("_sum") - 1) > within), "probabilities do not sum to one", *keys),
        _said(whole.where(rising), "not in descending order", *keys),
        _said(whole.where(F.col("_n") > k), "too wide", *keys),
    ])


def check_tree_leaves(nodes: DataFrame) -> DataFrame:
    """``node_key, violation`` of ``nodes(node_key, parent_key, label)``: unlabelled leaves, repeated leaf and node labels."""
    inner = nodes.where("parent_key is not null").select(F.col("parent_key").alias("node_key")).distinct()
    leaves = nodes.join(inner, "node_key", "left_anti")
    labelled = F.trim(F.coalesce("label", F.lit(""))) != ""
    twice = lambda df: df.join(_repeated(df.where(labelled), "label").select("label"), "label", "left_semi")
    return _all([
        _said(leaves.where(~labelled), "unlabelled leaf", "node_key"),
        _said(twice(leaves), "repeated leaf", "node_key"),
        _said(twice(nodes).join(leaves, "node_key", "left_anti"), "repeated node", "node_key"),
    ])


def check_bindings(bindings: DataFrame, lineage: DataFrame, closure: DataFrame, edges: DataFrame, forms: DataFrame) -> DataFrame:
    """``node_id, violation`` of ``bindings(node_id, role, source_variety_id)``.

    A bound node must be internal; an anchor's concepts must be attested by the leaves below it; of
    ``lineage(node_id, branch_id, descendant_id)`` each branch must lie under exactly one child of its node,
    and no two branches under one.
    """
    inner = edges.select(F.col("parent_id").alias("node_id")).distinct()
    below = closure.select(F.col("ancestor_id").alias("node_id"), F.col("descendant_id").alias("variety_id"))
    attested = below.join(forms.select("variety_id", "concept_id"), "variety_id").select("node_id", "concept_id").distinct()
    sources = bindings.where("role = 'anchor'").select("node_id", F.col("source_variety_id").alias("variety_id"))
    asked = sources.join(forms.select("variety_id", "concept_id"), "variety_id").select("node_id", "concept_id").distinct()
    children = edges.select(F.col("parent_id").alias("node_id"), F.col("child_id").alias("_child"))
    under = closure.select(F.col("ancestor_id").alias("_child"), "descendant_id")
    placed = lineage.join(children, "node_id").join(under, ["_child", "descendant_id"]).select("node_id", "branch_id", "_child").distinct()
    per_branch = lineage.select("node_id", "branch_id").distinct().join(placed, ["node_id", "branch_id"], "left").groupBy("node_id", "branch_id").agg(F.count("_child").alias("_n"))
    return _all([
        _said(bindings.join(inner, "node_id", "left_anti"), "not an internal node", "node_id"),
        _said(asked.join(attested, ["node_id", "concept_id"], "left_anti").select("node_id").distinct(), "concept not attested", "node_id"),
        _said(per_branch.where("_n <> 1").select("node_id").distinct(), "branch not under one child", "node_id"),
        _said(_repeated(placed, "node_id", "_child").select("node_id").distinct(), "branches collapse", "node_id"),
    ])


def check_anchors(anchors: DataFrame, nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """``form_id, violation`` of ``anchors(node_id, form_id, concept_id, provenance)``."""
    given = F.trim(F.coalesce("provenance", F.lit(""))) != ""
    return _all([
        _said(anchors.join(nodes, "node_id", "left_anti"), "unknown node", "form_id"),
        _said(anchors.join(forms, "concept_id", "left_anti"), "unknown concept", "form_id"),
        _said(anchors.where(~given), "no provenance", "form_id"),
    ])


def check_target_leakage(bindings: DataFrame, varieties: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_variety_id, violation``: targets still in the evidence, or bound to a leaf."""
    targets = bindings.where("role = 'target'")
    inner = edges.select(F.col("parent_id").alias("node_id"))
    seen = varieties.select(F.col("variety_id").alias("source_variety_id"))
    return _said(targets.join(seen, "source_variety_id", "left_semi"), "in the evidence", "source_variety_id").unionByName(
        _said(targets.join(inner, "node_id", "left_anti"), "bound to a leaf", "source_variety_id")
    )


def check_rationales(rules: DataFrame, reductions: DataFrame) -> DataFrame:
    """``node_id, rule_id, violation`` of ``rules(node_id, rule_id, rationale, direction)``.

    A node of several rules needs a rationale for each; a rule of ``reductions(node_id, rule_id)`` needs one
    for its direction.
    """
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    several = rules.groupBy("node_id").agg(F.count_distinct("rule_id").alias("_n")).where("_n > 1").select("node_id")
    return _said(rules.where(empty("rationale")).join(several, "node_id", "left_semi"), "no rationale", "node_id", "rule_id").unionByName(
        _said(rules.where(empty("direction")).join(reductions, ["node_id", "rule_id"], "left_semi"), "no rationale of direction", "node_id", "rule_id")
    )


def check_commits(commits: DataFrame, changed: DataFrame, previews: DataFrame, anomalies: DataFrame, forms: DataFrame) -> DataFrame:
    """``node_id, violation`` of ``commits(commit_id, node_id, rule_ordinal, rule_id, support, scope)``.

    ``support`` (form ids) must be a part, and not an empty one, of what ``changed(node_id, rule_id, form_id)``
    lists; order, rules and scopes must equal those of ``previews(node_id, rule_ordinal, rule_id, scope)``;
    ``anomalies(node_id, form_id)`` must name known forms; a node is committed once.
    """
    did = changed.groupBy("node_id", "rule_id").agg(F.collect_set("form_id").alias("_changed"))
    cited = commits.join(did, ["node_id", "rule_id"], "left")
    beyond = (F.size("support") == 0) | (F.size(F.array_except("support", F.coalesce("_changed", F.slice("support", 1, 0)))) > 0)
    ordered = lambda df: df.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("rule_ordinal", "rule_id", F.array_sort("scope").alias("scope")))).alias("_order"))
    seen = ordered(previews).withColumnRenamed("_order", "_seen")
    other = ordered(commits).join(seen, "node_id", "left").where(~F.col("_order").eqNullSafe(F.col("_seen")))
    twice = commits.groupBy("node_id").agg(F.count_distinct("commit_id").alias("_n")).where("_n > 1")
    return _all([
        _said(cited.where(beyond).select("node_id").distinct(), "support beyond the test", "node_id"),
        _said(other, "not as previewed", "node_id"),
        _said(anomalies.join(forms, "form_id", "left_anti").select("node_id").distinct(), "anomaly of an unknown form", "node_id"),
        _said(twice, "committed more than once", "node_id"),
    ])
