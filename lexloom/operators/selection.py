"""Choosing forms, concepts and varieties, and checks of what was chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.plans.products import paired

#: Tokens that mark a boundary and no sound.
BOUNDARIES = ("+", "-")


def phonetic_segments(segments: Column) -> Column:
    """The tokens without boundaries."""
    return F.filter(segments, lambda s: ~s.isin(*BOUNDARIES))


def variety_counts(forms: DataFrame) -> DataFrame:
    """Forms and distinct concepts of each variety."""
    return forms.groupBy("variety_id").agg(F.count("*").alias("n_forms"), F.count_distinct("concept_id").alias("n_concepts"))


def membership_segments(forms: DataFrame, memberships: DataFrame) -> DataFrame:
    """``form_id, membership_id, segments``: the segments of each judgement; all of them for the whole form."""
    chosen = F.when(F.size("segment_indices") > 0, F.transform("segment_indices", lambda i: F.get("_s", i))).otherwise(F.col("_s"))
    own = forms.select("form_id", F.col("segments").alias("_s"))
    return memberships.join(own, "form_id").select("form_id", "membership_id", chosen.alias("segments"))


def cognate_sets_of_form(forms: DataFrame, memberships: DataFrame) -> DataFrame:
    """``form_id, sets``: the different sets of a form's judgements, else its own; none: an empty array."""
    judged = memberships.groupBy("form_id").agg(F.array_sort(F.collect_set("cognate_set_id")).alias("_sets"))
    own = F.array_compact(F.array("cognate_set_id"))
    return forms.join(judged, "form_id", "left").select("form_id", F.coalesce("_sets", own).alias("sets"))


def select_evidence(forms: DataFrame, varieties: DataFrame, concepts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Forms of chosen varieties and concepts, without those of bound historical sources.

    Raises an error if a chosen variety that is not bound keeps no form, or fewer than two remain.
    """
    bound = bindings.select(F.col("source_variety_id").alias("variety_id"))
    wanted = varieties.select("variety_id").distinct().join(bound, "variety_id", "left_anti")
    kept = forms.join(wanted, "variety_id", "left_semi").join(concepts, "concept_id", "left_semi")
    left = kept.select("variety_id").distinct()
    empty = [r.variety_id for r in wanted.join(left, "variety_id", "left_anti").limit(5).collect()]
    if empty:
        raise ValueError(f"no form is left of {empty}")
    if left.limit(2).count() < 2:
        raise ValueError("fewer than two varieties are left")
    return kept


def bind_historical_forms(requests: DataFrame, forms: DataFrame) -> DataFrame:
    """``node_id, role, form_id, concept_id, segments``: forms of each request's source variety, on its node."""
    rows = requests.select("node_id", "role", F.col("source_variety_id").alias("variety_id"))
    return rows.join(forms, "variety_id").select("node_id", "role", "form_id", "concept_id", "segments")


def merge_anchors(embedded: DataFrame, supplied: DataFrame) -> DataFrame:
    """Both sources of anchors with ``repeated``, which is true for a form_id that meets twice."""
    every = embedded.unionByName(supplied)
    return every.withColumn("repeated", F.count("*").over(Window.partitionBy("form_id")) > 1)


def benchmark_report(concepts: DataFrame, forms: DataFrame, gold: DataFrame) -> DataFrame:
    """``node_id, n_daughters, n_concepts, n_gold_forms`` of a benchmark: chosen concepts, their forms, gold by node."""
    used = forms.join(concepts, "concept_id", "left_semi").agg(F.count_distinct("variety_id").alias("n_daughters"), F.count_distinct("concept_id").alias("n_concepts"))
    per = gold.join(concepts, "concept_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("n_gold_forms"))
    return per.join(F.broadcast(used)).select("node_id", "n_daughters", "n_concepts", "n_gold_forms")  # one row of counts


def apply_overlay(forms: DataFrame, memberships: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forms and judgements under ``overlay(form_id, segments)``, which sets boundaries anew; and what is wrong with it.

    Sounds must stay as they are (``changed``), and a form has one overlay (``ambiguous``); forms in error
    keep their own segments. A judgement's indices move to where the same sounds are.
    """
    new = overlay.groupBy("form_id").agg(F.min("segments").alias("_new"), F.count_distinct("segments").alias("_n"))
    joined = forms.join(new, "form_id", "left")
    same = phonetic_segments(F.col("_new")) == phonetic_segments(F.col("segments"))
    error = F.when(F.col("_n") > 1, "ambiguous").when(F.col("_new").isNotNull() & ~same, "changed")
    joined = joined.withColumn("error", error)
    good = F.col("_new").isNotNull() & F.col("error").isNull()
    done = joined.select(*[F.when(good, F.col("_new")).otherwise(F.col("segments")).alias(c) if c == "segments" else c for c in forms.columns])
    places = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).isin(*BOUNDARIES))
    maps = joined.where(good).select("form_id", places(F.col("segments")).alias("_from"), places(F.col("_new")).alias("_to"))
    moved = F.filter(F.transform("segment_indices", lambda i: F.get("_to", F.array_position("_from", i).cast("int") - 1)), lambda i: i.isNotNull())
    judged = memberships.join(maps, "form_id", "left")
    judged = judged.select(*[F.when(F.col("_from").isNull() | F.col("segment_indices").isNull(), F.col("segment_indices")).otherwise(moved).alias(c) if c == "segment_indices" else c for c in memberships.columns])
    return done, judged, joined.where("error is not null").select("form_id", "error")


def list_concepts(forms: DataFrame, concepts: DataFrame, query: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of ``concept_id, n_forms, nodes`` of the concepts in scope that hold ``query`` in their id, gloss, field or aliases.

    The page is the feature; the order is by concept_id.
    """
    text = F.lower(F.concat_ws("\0", "concept_id", "gloss", "concepticon_id", "semantic_field", "aliases"))
    found = concepts.where(text.contains(query.lower()))
    per = forms.groupBy("concept_id").agg(F.count("*").alias("n_forms"), F.array_sort(F.collect_set("variety_id")).alias("nodes"))
    return per.join(found, "concept_id", "left_semi").orderBy("concept_id").offset(offset).limit(limit)


def list_nodes(evidence: DataFrame, forms: DataFrame, prior: DataFrame) -> DataFrame:
    """``parent_id, node_id, kind, relation, leaf_ids, n_forms, n_concepts, has_hypothesis`` of the visible nodes."""
    per = forms.groupBy(F.col("variety_id").alias("node_id")).agg(F.count("*").alias("n_forms"), F.count_distinct("concept_id").alias("n_concepts"))
    known = prior.select("node_id").distinct().withColumn("_known", F.lit(True))
    joined = evidence.join(per, "node_id", "left").join(known, "node_id", "left")
    return joined.select("parent_id", "node_id", "kind", "relation", "leaf_ids", F.coalesce("n_forms", F.lit(0)).alias("n_forms"), F.coalesce("n_concepts", F.lit(0)).alias("n_concepts"), F.col("_known").isNotNull().alias("has_hypothesis"))


def lookup_committed_rules(commits: DataFrame, anomalies: DataFrame, evidence: DataFrame) -> DataFrame:
    """``parent_id, node_id, rules, n_anomalies, identity``: what each finished node that is visible committed to.

    ``commits(node_id, rule_ordinal, dsl)`` (a null dsl for a node without rules), ``anomalies(node_id)``.
    """
    written = F.transform(F.array_sort(F.collect_list(F.when(F.col("dsl").isNotNull(), F.struct("rule_ordinal", "dsl")))), lambda r: r["dsl"])
    per = commits.groupBy("node_id").agg(written.alias("rules"))
    odd = anomalies.groupBy("node_id").agg(F.count("*").alias("n_anomalies"))
    seen = evidence.where("kind = 'reconstructed'").select("parent_id", "node_id")
    joined = seen.join(per, "node_id").join(odd, "node_id", "left")
    return joined.select("parent_id", "node_id", "rules", F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"), (F.size("rules") == 0).alias("identity"))


def resumable_commits(trajectories: DataFrame, steps: DataFrame, run_id: int, configuration: int) -> DataFrame:
    """Completed trajectories of one run and configuration whose node is in the checkpoint."""
    same = trajectories.where(F.col("completed") & (F.col("run_id") == run_id) & (F.col("schema_hash") == configuration))
    return same.join(steps, "node_id", "left_semi")


def choose_concepts(marked: DataFrame, policy: str, most: int | None = None) -> DataFrame:
    """``concept_id`` of :func:`benchmark_concepts` by policy (all, shared, fully_cognate), in order; ``most`` is the wanted size of a benchmark."""
    if policy not in ("all", "shared", "fully_cognate"):
        raise ValueError(f"policy is all, shared or fully_cognate, not {policy}")
    kept = marked if policy == "all" else marked.where(policy)
    ordered = kept.select("concept_id").orderBy("concept_id")
    return ordered if most is None else ordered.limit(most)


def benchmark_concepts(forms: DataFrame, daughters: list[str], gold: str) -> DataFrame:
    """``concept_id, shared, fully_cognate`` of the concepts that any daughter attests.

    ``shared``: every daughter attests it; ``fully_cognate``: every daughter also shares a cognate set with
    the gold variety. Each is one aggregation; the gold sets are joined on concept and set.
    """
    sets = forms.where(F.col("variety_id") == gold).select("concept_id", "cognate_set_id").distinct().withColumn("in_gold", F.lit(True))
    own = forms.where(F.col("variety_id").isin(daughters)).select("variety_id", "concept_id", "cognate_set_id").distinct()
    per = own.join(sets, ["concept_id", "cognate_set_id"], "left").groupBy("concept_id").agg(F.count_distinct("variety_id").alias("_n"), F.count_distinct(F.when(F.col("in_gold"), F.col("variety_id"))).alias("_g"))
    return per.select("concept_id", (F.col("_n") == len(daughters)).alias("shared"), (F.col("_g") == len(daughters)).alias("fully_cognate"))


def search_forms(forms: DataFrame, pattern: list[str], position: str = "any", boundaries: bool = True, concepts: list[str] | None = None, text: str | None = None, sets: list[str] | None = None) -> DataFrame:
    """Forms whose tokens hold ``pattern`` anywhere (``any``), at the start (``initial``), the end (``final``) or alone (``exact``).

    Without ``boundaries``, they are left out of the form before it is searched. A null form is never found.
    ``concepts``, ``text`` (part of the sounds written together) and ``sets`` narrow the search.
    """
    if concepts is not None:
        forms = forms.where(F.col("concept_id").isin(concepts))
    if sets is not None:
        forms = forms.where(F.col("cognate_set_id").isin(sets))
    if text is not None:
        forms = forms.where(F.array_join(phonetic_segments(F.col("segments")), "").contains(text))
    seg = F.col("segments") if boundaries else phonetic_segments(F.col("segments"))
    want, w = F.array(*map(F.lit, pattern)), len(pattern)
    if position == "exact":
        found = seg == want
    elif position == "initial":
        found = F.slice(seg, 1, w) == want
    elif position == "final":
        found = (F.size(seg) >= w) & (F.slice(seg, F.greatest(F.size(seg) - w, F.lit(0)) + 1, w) == want)
    elif position == "any":
        starts = F.when(F.size(seg) >= w, F.sequence(F.lit(1), F.size(seg) - w + 1)).otherwise(F.array().cast("array<int>"))
        found = F.exists(starts, lambda i: F.slice(seg, i, w) == want)
    else:
        raise ValueError(f"position is any, initial, final or exact, not {position}")
    return forms.where(found)


def reconcile_tree(edges: DataFrame, forms: DataFrame) -> DataFrame:
    """``variety_id, violation``: varieties with forms that are no leaf of the tree."""
    inner = edges.select(F.col("parent_id").alias("_inner")).distinct()
    leaves = edges.select(F.col("child_id").alias("_leaf")).join(inner, F.col("_leaf") == F.col("_inner"), "left_anti")
    return forms.select("variety_id").distinct().join(leaves, F.col("variety_id") == F.col("_leaf"), "left_anti").withColumn("violation", F.lit("missing from the tree"))


def check_distances(distances: DataFrame) -> DataFrame:
    """``taxon_a, taxon_b, violation`` of a table of distances: negative, asymmetric, without a mirror, off zero on the diagonal, or missing.

    A table without the diagonal is whole if it has every pair of different taxa.
    """
    taxa = distances.select(F.col("taxon_a").alias("t")).union(distances.select("taxon_b")).distinct()
    # A whole matrix holds every pair, so listing the pairs is of its own size.
    pairs = paired(taxa.withColumnRenamed("t", "taxon_a"), taxa.withColumnRenamed("t", "taxon_b")).where("taxon_a < taxon_b")
    either = distances.select(F.least("taxon_a", "taxon_b").alias("taxon_a"), F.greatest("taxon_a", "taxon_b").alias("taxon_b")).distinct()
    missing = pairs.join(either, ["taxon_a", "taxon_b"], "left_anti").withColumn("violation", F.lit("missing"))
    mirror = distances.select(F.col("taxon_b").alias("taxon_a"), F.col("taxon_a").alias("taxon_b"), F.col("distance").alias("_mirror"))
    both = distances.join(mirror, ["taxon_a", "taxon_b"], "left")
    found = F.array_compact(F.array(
        F.when(F.col("distance") < 0, "negative"),
        F.when(F.col("_mirror").isNull(), "no mirror"),
        F.when(F.col("_mirror") != F.col("distance"), "asymmetric"),
        F.when((F.col("taxon_a") == F.col("taxon_b")) & (F.col("distance") != 0), "diagonal"),
    ))
    return both.select("taxon_a", "taxon_b", F.explode(found).alias("violation")).unionByName(missing)


def largest_misses(evaluations: DataFrame, k: int) -> DataFrame:
    """The ``k`` concepts of each node that are furthest from gold (``node_id, concept_id, ed``), ties to the smaller concept_id."""
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("ed"), "concept_id"))
    return evaluations.where("ed is not null").select("node_id", "concept_id", "ed").withColumn("rank", rank).where(F.col("rank") <= k)
