"""Queries of rules, alignments, reconstruction, evaluation and distances over the wordlist views, and their DuckDB SQL.

Queries whose operator SQL cannot express (alignments, beams over several children, trees) have none; tests
hold those against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom import queries as base
from lexloom.operators import alignment, beam, checks, clustering, evaluation, reconstruction, rules, tree
from lexloom.plans.scratch import Scratch
from lexloom.sources import views

GOLD, ANCHOR = "Brand#25", "Brand#24"


def _rules(spark: SparkSession) -> DataFrame:
    return rules.compile_rules(views.rules(spark)).withColumn("rule_id", F.concat_ws(":", "node_id", F.col("rule_ordinal").cast("string")))


def _scoped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the view; the first rule of a node only concerns every second of its children."""
    edges = views.edges(spark, sf_dir).where("child_ordinal % 2 = 0")
    own = edges.groupBy(F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list("child_id")).alias("_c"))
    named = _rules(spark).drop("source_child_ids").join(own, "node_id", "left")
    return named.withColumn("source_child_ids", F.when(F.col("rule_ordinal") == 1, F.col("_c"))).drop("_c")


def _cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir).select("parent_id", F.col("child_id").alias("variety_id"))
    return rules.apply_cascade(views.forms(spark, sf_dir).join(edges, "variety_id"), _rules(spark), "parent_id").withColumnRenamed("variety_id", "child_id")


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.forms(spark, sf_dir).where(F.col("variety_id") == ANCHOR).select(F.lit("g5").alias("node_id"), "form_id", "concept_id", "cognate_set_id", "segments")


def anchored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on every form, with the outputs of the first rule as anchors: a form that another changes to else misses its anchor."""
    forms = views.forms(spark, sf_dir).select("form_id", "segments").withColumn("concept_id", F.col("form_id"))
    found = rules.apply_rule(forms, _rules(spark))
    expected = found.where("rule_id = 'root:1' and form_id % 2 = 0").select("concept_id", "form_id", F.col("output").alias("segments"))
    return rules.anchor_match(found, expected).select("form_id", "rule_id", "status", "anchor_ids", "matched_anchor_ids")


def scoped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by child; one child of each scope is not the node's."""
    own = _scoped_rules(spark, sf_dir).withColumn("source_child_ids", F.concat("source_child_ids", F.array(F.lit("nobody"))))
    known, unknown = rules.scope_rules(own.select("node_id", "rule_id", "source_child_ids", "confidence"), views.edges(spark, sf_dir))
    return known.select("node_id", "rule_id", "child_id", "confidence").unionByName(unknown.withColumn("confidence", F.lit(None).cast("double")))


def contrast_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.contrast_reductions(_cascaded(spark, sf_dir), _rules(spark), ["parent_id", "child_id"])


def _node_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrast_reductions(spark, sf_dir).select(F.col("parent_id").alias("node_id"), "rule_id").distinct()


def attesting_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tree.classify_evidence(views.edges(spark, sf_dir)).where("kind = 'observed'").select("parent_id", "node_id", "kind")
    forms = views.forms(spark, sf_dir).select(F.col("variety_id").alias("node_id"), "segments")
    return rules.attesting_nodes(_node_reductions(spark, sf_dir), _rules(spark), seen.join(forms, "node_id"))


def tested_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first rule alone on the forms of its node's children: counts, and whether it gives up a contrast."""
    edges = views.edges(spark, sf_dir).select("parent_id", F.col("child_id").alias("variety_id"))
    first = _rules(spark).where("rule_ordinal = 1")
    done = rules.apply_cascade(views.forms(spark, sf_dir).join(edges, "variety_id"), first, "parent_id").withColumnRenamed("variety_id", "child_id")
    steps = done.select("parent_id", F.explode("trace").alias("t")).groupBy("parent_id", F.col("t.rule_id").alias("rule_id")).agg(F.count_if(F.col("t.n_matches") > 0).alias("n_applied"), F.count("*").alias("n_forms"))
    lost = rules.contrast_reductions(done, first, ["parent_id"])
    return steps.join(lost, ["parent_id", "rule_id"], "left").select("parent_id", "rule_id", "n_applied", "n_forms", F.coalesce("deletes", F.lit(False)).alias("deletes"), F.coalesce("merges", F.lit(False)).alias("merges"))


def tested_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cascades: convergence at each parent with the rules that give up a contrast at any child."""
    done = _cascaded(spark, sf_dir)
    lost = rules.contrast_reductions(done, _rules(spark), ["parent_id", "child_id"]).groupBy("parent_id").agg(F.array_sort(F.collect_set("rule_id")).alias("contrasts"))
    return rules.convergence_rate(rules.convergence(done)).drop("divergent_ids").join(lost, "parent_id", "left")


def heldout_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = base.held_out_concepts(spark, sf_dir).where("held_out").select("node_id", "concept_id")
    return reconstruction.heldout_convergence(_cascaded(spark, sf_dir), held)


def matched_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of the view's rules: single ones for all, cascades for the even ones, two verdicts for some."""
    own = _rules(spark).withColumns({"scope": F.array(F.lit("b"), F.lit("a")), "overlay": F.lit(None).cast("string")})
    base_ = views.trajectories(spark, sf_dir).where("completed").select("node_id", F.col("conv_id").alias("seq"), (F.col("conv_id") % 2).alias("odd"))
    tests = own.drop("overlay").withColumn("scope", F.array(F.lit("a"), F.lit("b"))).join(base_, "node_id")
    tests = tests.withColumns({"overlay": F.lit(""), "call_id": F.col("seq"), "kind": F.when((F.col("odd") == 0) & (F.col("rule_ordinal") == 1), "cascade").otherwise("single"), "verdict": F.when(F.col("node_id") == "g2", F.col("seq") % 3).otherwise(0)})
    return rules.match_validations(own, tests)


def derived_daughters(spark: SparkSession, sf_dir: str) -> DataFrame:
    proto = views.forms(spark, sf_dir).where(F.col("variety_id") == GOLD).select(F.lit("root").alias("node_id"), "concept_id", "segments")
    return reconstruction.derive_daughters(proto, views.edges(spark, sf_dir), _rules(spark))


def invertible_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir)
    return reconstruction.invert_and_verify(derived_daughters(spark, sf_dir), edges, _rules(spark))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms without boundaries, aligned within their concept and set."""
    inputs = views.forms(spark, sf_dir).withColumn("segments", F.filter("segments", lambda s: s != "+"))
    return alignment.align_groups(inputs)


def _gold_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    forms = views.forms(spark, sf_dir).select("variety_id", "form_id", "concept_id", "segments")
    gold = F.col("variety_id") == GOLD
    return alignment.class_pairs(forms.where(~gold).drop("variety_id"), forms.where(gold).drop("variety_id"))


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of each concept against the gold ones of it: pairs of different forms (``pair``), and every form's class."""
    pairs, members = _gold_pairs(spark, sf_dir)
    return alignment.align_pairs(pairs).withColumn("part", F.lit("pair")).unionByName(members, allowMissingColumns=True)


def aligned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


def aligned_correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondences of real alignments, with one brand's forms as anchors."""
    forms = views.forms(spark, sf_dir).withColumn("segments", F.filter("segments", lambda s: s != "+"))
    anchors = forms.where(F.col("variety_id") == ANCHOR)
    return alignment.pairwise_correspondences(alignment.align_groups(forms.where(F.col("variety_id") != ANCHOR), anchors))


def summarized_correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = base.VARIETIES
    return alignment.summarize_correspondences(base.correspondence_sets(spark, sf_dir), leaves, "e", None, 2, 0, 20)


def selected_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width, members and varieties of the alignments of the concepts that end in 5."""
    forms = views.forms(spark, sf_dir).withColumn("segments", F.filter("segments", lambda s: s != "+"))
    return alignment.select_alignments(forms, forms.select("concept_id").where("concept_id like '%5'").distinct(), full=False)


def _polarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What others show where two brands have e and none of them another sound, in padded members."""
    edges = views.edges(spark, sf_dir)
    seen = tree.classify_evidence(edges).where("parent_id = 'g1' and kind = 'observed'").select("node_id", "kind", "relation")
    return alignment.polarize(views.aligned(spark, sf_dir), seen, {"Brand#1": "e", "Brand#2": "e"})


def polarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polarized(spark, sf_dir)


def polarized_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tree.classify_evidence(views.edges(spark, sf_dir)).where("parent_id = 'g1' and kind = 'observed'").select("node_id", "kind", "relation")
    return alignment.polarize(views.aligned(spark, sf_dir), seen, {"Brand#1": "s"}, "initial")


def polarize_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.polarize_candidates(_polarized(spark, sf_dir))


def anchor_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams of the group whose anchors are scored, and of the same group with them ignored."""
    edges = views.edges(spark, sf_dir).where("parent_id = 'g5'")
    leaves = beam.leaf_beam(views.forms(spark, sf_dir), 3).withColumnRenamed("variety_id", "node_id")
    children = reconstruction.transform_children(leaves, edges, _scoped_rules(spark, sf_dir))
    both = [reconstruction.combine_children(children, 3, _anchors(spark, sf_dir), p).withColumn("policy", F.lit(p)) for p in ("ignore", "scored")]
    return both[0].unionByName(both[1]).withColumns({c: F.round(c, 9) for c in ("log_score", "probability")})


def combined_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two children of each group: the beams of their parents."""
    edges = views.edges(spark, sf_dir).where("parent_id <> 'root' and child_ordinal % 5 in (1, 2)")
    leaves = beam.leaf_beam(views.forms(spark, sf_dir), 5).withColumnRenamed("variety_id", "node_id")
    children = reconstruction.transform_children(leaves, edges, _rules(spark).drop("source_child_ids"))
    return reconstruction.combine_children(children, 5).withColumns({c: F.round(c, 9) for c in ("log_score", "probability")})


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return reconstruction.reconstruct_tree(views.forms(spark, sf_dir).where(F.col("variety_id") != GOLD), views.edges(spark, sf_dir), _scoped_rules(spark, sf_dir), 5)


def reconstructed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    beams, _ = _tree(spark, sf_dir)
    return beams.withColumns({"candidate_id": beam.candidate_id(), "log_score": F.round("log_score", 9), "probability": F.round("probability", 9)})


def branch_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    beams, children = _tree(spark, sf_dir)
    return reconstruction.branch_support(children, beams, views.edges(spark, sf_dir))


def node_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _tree(spark, sf_dir)
    odd = views.trajectories(spark, sf_dir).where("n_no_ops > 0").select("node_id")
    lost = rules.contrast_reductions(children, _rules(spark), ["parent_id"]).withColumnRenamed("parent_id", "node_id")
    looked = base.held_out_concepts(spark, sf_dir).where("held_out").select("node_id", "concept_id")
    return reconstruction.node_diagnostics(children, odd, lost, looked)


def fallback_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = views.trajectories(spark, sf_dir).where("not completed and run_id = 3").select("node_id")
    return reconstruction.mark_fallback_taint(failures, tree.closure(views.edges(spark, sf_dir)))


def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beam.leaf_beam(views.forms(spark, sf_dir), 5).select("variety_id", "concept_id", "segments", beam.candidate_id().alias("candidate_id"))


def token_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between forms in tokens of two letters and their gold, by token."""
    pair = lambda c: F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / 2).cast("int") - 1), lambda i: F.array_join(F.slice(c, i * 2 + 1, F.lit(2)), ""))
    forms = views.forms(spark, sf_dir).withColumn("segments", pair(F.col("segments")))
    gold = forms.where(F.col("variety_id") == GOLD)
    return evaluation.nearest_gold(forms.where(F.col("variety_id") != GOLD).select("form_id", "concept_id", "segments"), gold)


def bcubed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each two different forms (``pair``) of :func:`aligned_pairs`, and every form's class."""
    pairs, members = _gold_pairs(spark, sf_dir)
    return evaluation.bcubed(pairs).withColumn("part", F.lit("pair")).unionByName(members, allowMissingColumns=True)


def graded_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.evaluated_targets(spark, sf_dir).withColumn("node_id", F.lit("root"))
    return evaluation.graded_metrics(found, ["node_id"]).select("node_id", "n", *[F.round(c, 7).alias(c) for c in ("mean_top_ned", "mean_best_ned", "mean_top_ed", "mean_best_ed", "selection_gap")])


def target_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.evaluated_targets(spark, sf_dir).withColumn("node_id", F.lit("root"))
    return evaluation.target_rates(found, ["node_id"]).withColumns({c: F.round(c, 9) for c in ("missing_rate", "top_exact_rate", "beam_exact_rate")})


def _branch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of the last group's brands (but the gold one) with the gold of their concept."""
    forms = views.forms(spark, sf_dir)
    gold = forms.where(F.col("variety_id") == GOLD).groupBy("concept_id").agg(F.min_by("segments", "form_id").alias("right"))
    own = forms.where(F.col("variety_id") != GOLD).select(F.col("variety_id").alias("child_id"), "concept_id", F.col("form_id").alias("ordinal"), F.col("segments").alias("left"))
    return own.join(gold, "concept_id")


def segment_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.segment_map(_branch_pairs(spark, sf_dir), ["child_id"])


def _oracle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.oracle_rules(segment_maps(spark, sf_dir), ["child_id"])


def oracle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oracle_rules(spark, sf_dir)


def _ceiling(spark: SparkSession, sf_dir: str, widths: list[int]) -> DataFrame:
    forms, edges = views.forms(spark, sf_dir), views.edges(spark, sf_dir).where(F.col("child_id") != GOLD)
    gold = Scratch(spark).save(forms.where(F.col("variety_id") == GOLD).select("concept_id", "segments").distinct())
    roots = reconstruction.oracle_trees(forms.where(F.col("variety_id") != GOLD), edges, gold, widths).where("node_id = 'root'")
    # Each concept is judged at each width.
    at = F.struct("width", "concept_id").alias("concept_id")
    wanted = gold.select(F.explode(F.array(*map(F.lit, widths))).alias("width"), "concept_id", "segments").select(at, "segments")
    judged = evaluation.evaluate_targets(roots.select(at, "segments", "rank"), wanted).withColumn("width", F.col("concept_id.width"))
    return evaluation.target_rates(judged, ["width"]).join(evaluation.graded_metrics(judged, ["width"]), "width")


def oracle_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family, rebuilt level by level with the oracle's rules, and its root held against gold."""
    return _ceiling(spark, sf_dir, [5]).withColumn("width", F.lit("root")).withColumnRenamed("width", "node_id")


def oracle_width_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ceiling, and the gap between the best and the first candidate, at several beam widths."""
    return _ceiling(spark, sf_dir, [1, 3, 10]).select("width", "n_top_exact", "n_beam_exact", "mean_top_ned", "mean_best_ned", "selection_gap")


def derived_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the groups of brands, with the children that gave them and how they came about."""
    edges = views.edges(spark, sf_dir).where("parent_id <> 'root'")
    leaves = beam.leaf_beam(views.forms(spark, sf_dir), 3).withColumnRenamed("variety_id", "node_id")
    children = reconstruction.transform_children(leaves, edges, _scoped_rules(spark, sf_dir))
    return reconstruction.combine_children(children, 3, provenance=True).select("node_id", "concept_id", "segments", "rank", "supporting_child_ids", "derivations")


def branch_recoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per concept: whether one branch's map gives the gold form, several together could, or none."""
    return evaluation.recoverability(_branch_pairs(spark, sf_dir))[0]


def branch_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per branch: concepts in which it lacks one of the gold form's segments."""
    return evaluation.recoverability(_branch_pairs(spark, sf_dir))[1]


def clade_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties of the rebuilt tree's inner nodes, decided in four ways by what the leaves outside each node show."""
    forms, edges = views.forms(spark, sf_dir), views.edges(spark, sf_dir)
    clades = Scratch(spark).save(tree.outgroups(edges))
    ties = evaluation.tied_pairs(_tree(spark, sf_dir)[0].join(edges.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_semi"), ["node_id", "concept_id"])
    gold = F.col("variety_id") == GOLD
    supported = evaluation.clade_support(ties, clades, forms.where(~gold))
    return evaluation.compare_policies(supported, forms.where(gold), clades)


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's rules as the truth of its nodes; committed are the first ones, at a wrong node too."""
    parts = ["target", "replacement", "left", "right", "word_initial", "word_final"]
    nodes = views.edges(spark, sf_dir).select(F.col("parent_id").alias("child_id")).distinct()
    answers = nodes.join(_rules(spark).select(F.col("node_id").alias("child_id"), *parts).where("child_id <> 'g1'"), "child_id", "left")
    mine = _rules(spark).where("rule_ordinal = 1").select(F.col("node_id").alias("child_id"), *parts)
    mine = mine.unionByName(mine.where("child_id = 'g2'").withColumn("child_id", F.lit("g77")))
    return evaluation.score_rules(mine, answers)


def functional_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each branch's cascade gives one of the gold forms of the concept."""
    gold = views.forms(spark, sf_dir).where(F.col("variety_id") == GOLD).select("concept_id", "segments")
    parents = views.edges(spark, sf_dir).select("parent_id").distinct().withColumn("_g", F.lit(GOLD)).join(gold.withColumn("_g", F.lit(GOLD)), "_g").drop("_g")
    return evaluation.functional_recovery(_cascaded(spark, sf_dir), parents).withColumn("rate", F.round("rate", 9))


def form_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.language_distance(views.forms(spark, sf_dir), "forms").withColumn("distance", F.round("distance", 9))


def cluster_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways to build a tree, over the distances by cognates and by forms."""
    both = [evaluation.language_distance(views.forms(spark, sf_dir), m).withColumn("dataset_id", F.lit(m)) for m in ("cognates", "forms")]
    distances = both[0].unionByName(both[1])
    trees = [clustering.cluster_trees(distances, ["dataset_id"], m, missing=1.0).withColumn("method", F.lit(m)) for m in ("upgma", "neighbor")]
    return trees[0].unionByName(trees[1])


def bootstrap_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of the clades of brands in 200 resamples of the concepts."""
    distances = evaluation.concept_distances(views.forms(spark, sf_dir), "cognates")
    return clustering.clade_support(distances, 200)


def rationale_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's rules; second ones lack a rationale, those of two nodes one of their direction."""
    texts = {"rationale": F.when(F.col("rule_ordinal") == 2, " ").otherwise("said"), "direction": F.when(~F.col("node_id").isin("g3", "g5"), "said")}
    return checks.check_rationales(_rules(spark).withColumns(texts), _node_reductions(spark, sf_dir))


def commit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that cite the first form each rule changed; bent once for each violation."""
    steps = _cascaded(spark, sf_dir).select(F.col("parent_id").alias("node_id"), "form_id", F.explode("trace").alias("t")).where("t.n_matches > 0")
    changed = steps.select("node_id", F.col("t.rule_id").alias("rule_id"), "form_id")
    first = changed.groupBy("node_id", "rule_id").agg(F.min("form_id").alias("f"))
    support = F.when(F.col("node_id") == "g2", F.array(F.lit(-1).cast("long"))).when(F.col("node_id") == "g3", F.array().cast("array<bigint>")).otherwise(F.array("f"))
    own = _rules(spark).join(first, ["node_id", "rule_id"], "left").select(F.lit(1).alias("commit_id"), "node_id", "rule_ordinal", "rule_id", support.alias("support"), F.array(F.lit("b"), F.lit("a")).alias("scope"))
    twice = own.unionByName(own.where("node_id = 'g1'").withColumn("commit_id", F.lit(2)))
    order = F.when(F.col("node_id") == "g5", 3 - F.col("rule_ordinal")).otherwise(F.col("rule_ordinal"))
    previews = own.select("node_id", order.alias("rule_ordinal"), "rule_id", F.array(F.lit("a"), F.lit("b")).alias("scope"))
    anomalies = spark.createDataFrame([("g4", -5)], "node_id string, form_id long")
    return checks.check_commits(twice, changed, previews, anomalies, views.forms(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        anchored_results, scoped_rules, contrast_reductions, attesting_nodes, tested_rules, tested_cascades, heldout_convergence, matched_validations, derived_daughters, invertible_branches,
        aligned_pairs, aligned_groups, aligned_correspondences, summarized_correspondences, selected_alignments, polarized, polarized_initial, polarize_candidates, anchor_boosts, combined_children,
        reconstructed_tree, branch_support, node_diagnostics, fallback_taint, candidate_ids, token_distances, bcubed_scores, graded_targets, target_rates, segment_maps, oracle_rules, oracle_ceiling, oracle_width_curve, derived_candidates,
        branch_recoverability, branch_deletions, clade_policies, rule_scores, functional_recovery, form_distance, cluster_trees, bootstrap_support, rationale_violations, commit_violations,
    )
}

# Rules whose context is none or one neighbour are easy to restate: each rule of the view as a replacement in a string.
_children = f"{base.FORMS}, {base.EDGES}, v_named AS (SELECT f.*, parent_id FROM v_forms f JOIN v_edges ON child_id = variety_id)"
_text = "array_to_string(segments, '')"
#: The rules of the view as patterns over forms written together; the view's tokens are single characters.
REGEX = {"root:1": ("d", "t"), "root:2": ("ll", "l"), "g1:1": ("i(n)", "e\\1"), "g2:1": ("^b", "p"), "g3:1": ("r$", ""), "g4:1": ("(\\+)w", "\\1v"), "g5:1": ("d", "t"), "g5:2": ("d(a)", "r\\1")}
_fires = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN regexp_matches(text, '{p}')" for k, (p, _) in REGEX.items()) + " END"
_gives = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN regexp_replace(text, '{p}', '{t}', 'g')" for k, (p, t) in REGEX.items()) + " END"
_has = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN contains(text, '{t}')" for k, t in (("root:1", "d"), ("root:2", "ll"), ("g1:1", "i"), ("g2:1", "b"), ("g3:1", "r"), ("g4:1", "w"), ("g5:1", "d"), ("g5:2", "d"))) + " END"
_ids = ", ".join(f"('{k}')" for k in REGEX)
#: Outputs of the cascades of each node: the second rule, if any, on what the first one gives.
_cascade = f"""WITH {_children}, c1 AS (SELECT *, {_text} AS t0, parent_id || ':1' AS r1, parent_id || ':2' AS r2 FROM v_named),
c2 AS (SELECT *, {_gives.replace('rule_id', 'r1').replace('text', 't0')} AS t1 FROM c1),
c3 AS (SELECT *, coalesce({_gives.replace('rule_id', 'r2').replace('text', 't1')}, t1) AS t2 FROM c2),
v_steps AS (SELECT form_id, variety_id, parent_id, concept_id, r1 AS rule_id, t0 AS text, t1 AS output FROM c3 UNION ALL SELECT form_id, variety_id, parent_id, concept_id, r2, t1, t2 FROM c3 WHERE parent_id IN ('root', 'g5'))"""
#: A rule of one sound to another merges if the other is there outside its matches, or the first one is (in a context).
_contrast = f"""{_cascade}, f AS (SELECT {{keys}}, rule_id, text, {_fires} AS fires FROM v_steps),
k AS (SELECT {{keys}}, rule_id, bool_or(fires) AS fired, bool_or(CASE rule_id WHEN 'g1:1' THEN contains(text, 'e') WHEN 'g2:1' THEN contains(text, 'p') WHEN 'g4:1' THEN contains(text, 'v') WHEN 'g5:1' THEN contains(text, 't') WHEN 'g5:2' THEN contains(text, 'r') WHEN 'root:1' THEN contains(text, 't') WHEN 'root:2' THEN contains(replace(text, 'll', ''), 'l') ELSE false END) AS merges FROM f GROUP BY {{keys}}, rule_id),
v_lost AS (SELECT {{keys}}, rule_id, rule_id = 'g3:1' AS deletes, merges FROM k WHERE fired AND (merges OR rule_id = 'g3:1'))"""
_by_child = _contrast.format(keys="parent_id, variety_id")
_best = base.ORACLES["evaluated_targets"].rstrip()

ORACLES = {
    "anchored_results": f"""WITH {base.FORMS}, r(rule_id) AS (VALUES {_ids}), p AS (SELECT form_id, rule_id, {_text} AS text FROM v_forms, r), o AS (SELECT *, {_fires} AS fires, {_gives} AS out, {_has} AS has FROM p),
a AS (SELECT form_id, out AS expected FROM o WHERE rule_id = 'root:1' AND form_id % 2 = 0), j AS (SELECT o.*, expected, fires AND out = expected AS hit FROM o LEFT JOIN a USING (form_id))
SELECT form_id, rule_id, CASE WHEN NOT has THEN 'absent' WHEN NOT fires THEN 'context' WHEN expected IS NOT NULL AND NOT hit THEN 'anchor' ELSE 'applied' END AS status,
CASE WHEN expected IS NULL THEN [] ELSE [form_id] END AS anchor_ids, CASE WHEN hit THEN [form_id] ELSE [] END AS matched_anchor_ids FROM j""",
    "scoped_rules": f"""WITH {base.EDGES}, r(node_id, k, confidence) AS (VALUES {', '.join(f"('{r[0]}', {r[1]}, {r[4]}::DOUBLE)" for r in views.RULES)})
SELECT node_id, node_id || ':' || k AS rule_id, child_id, CASE WHEN k = 1 THEN confidence ELSE 1.0 END AS confidence FROM r JOIN v_edges ON parent_id = node_id WHERE k = 2 OR child_ordinal % 2 = 0
UNION ALL SELECT DISTINCT node_id, node_id || ':1', 'nobody', NULL::DOUBLE FROM r JOIN v_edges ON parent_id = node_id WHERE k = 1 AND child_ordinal % 2 = 0""",
    "contrast_reductions": f"{_by_child} SELECT parent_id, variety_id AS child_id, rule_id, deletes, merges FROM v_lost",
    "attesting_nodes": f"""{_by_child}, l AS (SELECT DISTINCT parent_id AS node_id, rule_id FROM v_lost), w AS (SELECT DISTINCT l.node_id, l.rule_id, variety_id FROM l, (SELECT variety_id, {_text} AS text FROM v_forms) WHERE {_has.replace('rule_id', 'l.rule_id')})
SELECT node_id, rule_id, count(*) AS n_nodes, count(*) AS n_observed, list(variety_id ORDER BY variety_id)[1:10] AS nodes FROM w GROUP BY ALL""",
    "tested_rules": f"""{_contrast.format(keys='parent_id')}, s AS (SELECT parent_id, rule_id, count(*) FILTER ({_fires}) AS n_applied, count(*) AS n_forms FROM v_steps WHERE rule_id LIKE '%:1' GROUP BY ALL)
SELECT parent_id, rule_id, n_applied, n_forms, coalesce(deletes, false) AS deletes, coalesce(merges, false) AS merges FROM s LEFT JOIN v_lost USING (parent_id, rule_id)""",
    "tested_cascades": f"""{_by_child}, o AS (SELECT parent_id, concept_id, count(DISTINCT t2) AS o, count(DISTINCT variety_id) AS v FROM c3 GROUP BY ALL), l AS (SELECT parent_id, list_sort(list(DISTINCT rule_id)) AS contrasts FROM v_lost GROUP BY 1)
SELECT parent_id, count(*) AS n_concepts, count(*) FILTER (v = 1 OR o = 1) AS n_converging, count(*) FILTER (v <> 1 AND o <> 1) AS n_divergent, any_value(contrasts) AS contrasts FROM o LEFT JOIN l USING (parent_id) GROUP BY parent_id""",
    "heldout_convergence": f"""{_cascade}, d AS (SELECT DISTINCT parent_id AS node_id, concept_id FROM v_named), h AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY sha256(node_id || chr(0) || concept_id)) AS k, count(*) OVER (PARTITION BY node_id) AS n FROM d),
held AS (SELECT node_id, concept_id FROM h WHERE k > n - least(n - 1, round_even(n * 0.3, 0)::BIGINT)), o AS (SELECT parent_id, concept_id, count(DISTINCT t2) AS o, count(DISTINCT variety_id) AS v FROM c3 WHERE (parent_id, concept_id) IN (SELECT (node_id, concept_id) FROM held) GROUP BY ALL),
c AS (SELECT parent_id, count(*) AS n_concepts, count(*) FILTER (v = 1 OR o = 1) AS n_converging, count(*) FILTER (v <> 1 AND o <> 1) AS n_divergent FROM o GROUP BY 1),
s AS (SELECT parent_id, count(*) FILTER ({_fires}) AS n_applied, count(*) FILTER (NOT {_has}) AS n_absent, count(*) FILTER (NOT {_fires} AND {_has}) AS n_mismatched FROM v_steps WHERE (parent_id, concept_id) IN (SELECT (node_id, concept_id) FROM held) GROUP BY 1)
SELECT parent_id, n_concepts, n_converging, n_divergent, coalesce(n_applied, 0) AS n_applied, coalesce(n_absent, 0) AS n_absent, coalesce(n_mismatched, 0) AS n_mismatched FROM c LEFT JOIN s USING (parent_id)""",
    "matched_validations": f"""WITH {base.TRAJECTORIES}, r(node_id, k) AS (VALUES {', '.join(f"('{r[0]}', {r[1]})" for r in views.RULES)}), t AS (SELECT r.node_id, k, conv_id, CASE WHEN conv_id % 2 = 0 AND k = 1 THEN 1 ELSE 0 END AS c, CASE WHEN r.node_id = 'g2' THEN conv_id % 3 ELSE 0 END AS verdict FROM r JOIN v_traj t ON t.node_id = r.node_id WHERE completed),
b AS (SELECT node_id, k, max(c) AS c FROM t GROUP BY ALL), w AS (SELECT node_id, k, max(conv_id) AS call_id, any_value(CASE WHEN c = 1 THEN 'cascade' ELSE 'single' END) AS kind, count(DISTINCT verdict) > 1 AS ambiguous FROM t JOIN b USING (node_id, k, c) GROUP BY ALL)
SELECT node_id, node_id || ':' || k AS rule_id, call_id, kind, coalesce(ambiguous, false) AS ambiguous FROM r LEFT JOIN w USING (node_id, k)""",
    "summarized_correspondences": base._sets + """, m AS (SELECT *, list_contains(segments, 'e') AS seen FROM sets), c AS (SELECT count(*) AS n_sets, count(*) FILTER (seen AND support < 2) AS n_suppressed, count(*) FILTER (seen AND support >= 2) AS n_matched FROM m)
SELECT segments, support, n_concepts, examples, n_sets, n_suppressed, n_matched FROM m, c WHERE seen AND support >= 2 ORDER BY support DESC, list_transform(segments, lambda s: coalesce(s, '')) LIMIT 20""",
    "fallback_taint": f"WITH RECURSIVE {base.EDGES}, {base.CLOSURE}, {base.TRAJECTORIES}, f AS (SELECT DISTINCT node_id FROM v_traj WHERE NOT completed AND run_id = 3) SELECT ancestor_id AS node_id, bool_or(depth = 0 AND descendant_id IN (FROM f)) AS failed, bool_or(descendant_id IN (FROM f)) AS tainted FROM v_closure GROUP BY 1",
    "candidate_ids": f"WITH {base.FORMS}, {base.LEAF} SELECT variety_id, concept_id, segments, substr(sha256(array_to_string(segments, '␟')), 1, 12) AS candidate_id FROM v_leaf",
    "graded_targets": f"SELECT 'root' AS node_id, count(top_ned) AS n, round(avg(top_ned), 7) AS mean_top_ned, round(avg(best_ned), 7) AS mean_best_ned, round(avg(top_ed), 7) AS mean_top_ed, round(avg(best_ed), 7) AS mean_best_ed, round(greatest(0, avg(top_ned) - avg(best_ned)), 7)::DOUBLE AS selection_gap FROM ({_best})",
    "target_rates": f"SELECT 'root' AS node_id, count(*) AS n_concepts, count(*) FILTER (missing) AS n_missing, count(*) FILTER (top_exact) AS n_top_exact, count(*) FILTER (beam_exact) AS n_beam_exact, round(count(*) FILTER (missing) / count(*), 9) AS missing_rate, round(count(*) FILTER (top_exact) / count(*), 9) AS top_exact_rate, round(count(*) FILTER (beam_exact) / count(*), 9) AS beam_exact_rate FROM ({_best})",
    "functional_recovery": f"""{_cascade}, g AS (SELECT concept_id, {_text} AS gold FROM v_forms WHERE variety_id = 'Brand#25'), h AS (SELECT variety_id, concept_id, coalesce(bool_or(t2 = gold), false) AS hit FROM c3 LEFT JOIN g USING (concept_id) GROUP BY ALL)
SELECT variety_id AS child_id, count(*) AS n_concepts, round(avg(hit::INTEGER), 9) AS rate FROM h GROUP BY 1""",
    "form_distance": f"""WITH {base.FORMS}, s AS (SELECT DISTINCT variety_id, concept_id, replace({_text}, '+', '') AS t FROM v_forms), p AS (SELECT a.variety_id AS taxon_a, b.variety_id AS taxon_b, concept_id, avg(levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))) AS d FROM s a JOIN s b USING (concept_id) WHERE a.variety_id < b.variety_id GROUP BY ALL)
SELECT taxon_a, taxon_b, round(avg(d), 9) AS distance, count(*) AS n_concepts FROM p GROUP BY ALL""",
}
ORACLES["rationale_violations"] = f"""{_by_child}, l AS (SELECT DISTINCT parent_id, rule_id FROM v_lost) SELECT parent_id AS node_id, rule_id, 'no rationale of direction' AS violation FROM l WHERE parent_id IN ('g3', 'g5')
UNION ALL VALUES ('root', 'root:2', 'no rationale'), ('g5', 'g5:2', 'no rationale')"""
ORACLES["commit_violations"] = f"""{_cascade}, s AS (SELECT rule_id, min(form_id) FILTER ({_fires}) AS f FROM v_steps GROUP BY 1), r(rule_id) AS (VALUES {_ids})
SELECT DISTINCT split_part(r.rule_id, ':', 1) AS node_id, 'support beyond the test' AS violation FROM r LEFT JOIN s USING (rule_id) WHERE f IS NULL OR r.rule_id LIKE 'g2:%' OR r.rule_id LIKE 'g3:%'
UNION ALL VALUES ('g5', 'not as previewed'), ('g1', 'not as previewed'), ('g4', 'anomaly of an unknown form'), ('g1', 'committed more than once')"""
_polar = f"""WITH RECURSIVE {base.FORMS}, {base.PADDED}, {base.EDGES}, cells AS (SELECT * FROM v_cols), m AS (SELECT concept_id, cognate_set_id, col FROM cells c WHERE {{shown}} GROUP BY ALL HAVING count(DISTINCT variety_id) = {{n}}),
w AS (SELECT DISTINCT c.variety_id AS node_id, concept_id, cognate_set_id, col, segment FROM cells c JOIN m USING (concept_id, cognate_set_id, col)),
e AS (SELECT child_id AS node_id, CASE WHEN n <= 5 THEN 'active_child' ELSE 'outgroup' END AS relation FROM v_brands WHERE child_id NOT IN ({{children}})),
v AS (SELECT node_id, count(DISTINCT (concept_id, cognate_set_id, col)) AS columns_covered FROM w GROUP BY 1), s AS (SELECT node_id, segment, count(*) AS count, list_sort(list(DISTINCT concept_id))[1:3] AS examples FROM w GROUP BY ALL),
v_polar AS (SELECT node_id, 'observed' AS kind, relation, coalesce(columns_covered, 0) AS columns_covered, segment, coalesce(count, 0) AS count, examples FROM e LEFT JOIN v USING (node_id) LEFT JOIN s USING (node_id))"""
_both = _polar.format(shown="variety_id IN ('Brand#1', 'Brand#2') AND segment = 'e'", n=2, children="'Brand#1', 'Brand#2'")
ORACLES["polarized"] = _both + " SELECT * FROM v_polar"
ORACLES["polarized_initial"] = _polar.format(shown="variety_id = 'Brand#1' AND segment = 's' AND col = 0", n=1, children="'Brand#1'") + " SELECT * FROM v_polar"
ORACLES["polarize_candidates"] = _both + " SELECT segment, list_sort(list(DISTINCT node_id)) AS observed_node_ids, []::VARCHAR[] AS reconstructed_node_ids FROM v_polar WHERE segment IS NOT NULL GROUP BY 1"
