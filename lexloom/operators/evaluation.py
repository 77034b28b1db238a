"""Distances between forms, comparisons with gold, and distributions of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions.binding import let
from lexloom.operators.alignment import align_different, align_pairs, each_pair, segment_map
from lexloom.operators.selection import BOUNDARIES, phonetic_segments

#: Characters that stand for the different tokens of two forms, by their number.
ALPHABET = "".join(chr(0x4E00 + i) for i in range(20_000))


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance in tokens, whatever their length.

    Each different token of the two arrays becomes one character of its own, so that the built-in distance of
    strings counts tokens; single characters stand for themselves.
    """
    single = F.forall(F.concat(a, b), lambda t: F.length(t) == 1)
    code = lambda x, names: F.array_join(F.transform(x, lambda t: F.substring(F.lit(ALPHABET), F.array_position(names, t).cast("int"), F.lit(1))), "")
    coded = let(F.array_distinct(F.concat(a, b)), lambda names: F.levenshtein(code(a, names), code(b, names)))
    return F.when(single, F.levenshtein(F.array_join(a, ""), F.array_join(b, ""))).otherwise(coded)


def normalized_edit_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 if both are empty."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 0.0).otherwise(edit_distance(a, b) / longest)


def bcubed(pairs: DataFrame) -> DataFrame:
    """Add ``precision, recall, f1`` to ``pairs(left, right)``: B-Cubed over the columns of their alignment.

    Columns with one symbol on a side are a class of it; gaps are one symbol. Two empty forms score 1. Each different pair is
    scored once.
    """
    return each_pair(pairs, _bcubed)


def _bcubed(pairs: DataFrame) -> DataFrame:
    aligned = align_different(pairs)
    every = F.when(F.size("aligned_left") > 0, F.sequence(F.lit(0), F.size("aligned_left") - 1)).otherwise(F.array().cast("array<int>"))
    alike = lambda side, i, j: F.get(side, i).eqNullSafe(F.get(side, j))
    n = F.size("aligned_left")

    def mean(side: str) -> Column:
        both = lambda i: F.size(F.filter(every, lambda j: alike("aligned_left", i, j) & alike("aligned_right", i, j)))
        own = lambda i: F.size(F.filter(every, lambda j: alike(side, i, j)))
        return F.when(n == 0, 1.0).otherwise(F.aggregate(F.transform(every, lambda i: both(i) / own(i)), F.lit(0.0), lambda s, x: s + x) / n)

    scored = aligned.withColumns({"precision": mean("aligned_left"), "recall": mean("aligned_right")}).drop("aligned_left", "aligned_right")
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def nearest_gold(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """For each candidate, the gold form of its concept that is nearest by normalised distance, distance, tokens.

    Different forms of a concept meet its different gold forms; copies take what was found for their form.
    """
    each = candidates.select("concept_id", "segments").distinct()
    pairs = each.join(gold.select("concept_id", F.col("segments").alias("gold")).distinct(), "concept_id")
    scored = pairs.withColumns({"ned": normalized_edit_distance(F.col("segments"), F.col("gold")), "ed": edit_distance(F.col("segments"), F.col("gold"))})
    best = scored.groupBy("concept_id", "segments").agg(F.min(F.struct("ned", "ed", "gold")).alias("_b"))
    c, b = candidates.distinct().alias("c"), best.alias("b")
    joined = c.join(b, (F.col("c.concept_id") == F.col("b.concept_id")) & F.col("c.segments").eqNullSafe(F.col("b.segments")))
    return joined.select("c.*", F.col("b._b.gold").alias("nearest"), F.col("b._b.ed").alias("ed"), F.col("b._b.ned").alias("ned"))


def distribution(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, mean, sample deviation (0 for one value), minimum, quartiles and maximum; nulls are skipped."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(value).alias("max"))


def distributions(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """:func:`distribution` of several columns, one row for each ``metric``."""
    named = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")
    return distribution(df.select(*keys, named).select(*keys, "m.*"), "value", [*keys, "metric"])


def evaluate_targets(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold concept: missing, top exact, beam exact; distances of the top and of the best candidate.

    ``candidates(concept_id, segments, rank)``; several gold forms are alternatives, each different one met once. The
    graded columns are null where no candidate is.
    """
    marked = gold.select("concept_id", F.col("segments").alias("gold")).distinct().join(candidates, "concept_id", "left")
    exact = F.coalesce(F.col("segments") == F.col("gold"), F.lit(False))
    there, top = F.col("segments").isNotNull(), F.col("rank") == 1
    scored = marked.withColumn("_d", F.when(there, F.struct(normalized_edit_distance(F.col("segments"), F.col("gold")).alias("ned"), edit_distance(F.col("segments"), F.col("gold")).alias("ed"))))
    per = scored.groupBy("concept_id").agg((F.count("segments") == 0).alias("missing"), F.bool_or(exact & top).alias("top_exact"), F.bool_or(exact).alias("beam_exact"), F.min(F.when(top, F.col("_d"))).alias("_t"), F.min("_d").alias("_b"))
    return per.select("concept_id", "missing", F.coalesce("top_exact", F.lit(False)).alias("top_exact"), "beam_exact", F.col("_t.ed").alias("top_ed"), F.col("_t.ned").alias("top_ned"), F.col("_b.ed").alias("best_ed"), F.col("_b.ned").alias("best_ned"))


def target_rates(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of :func:`evaluate_targets`; rates divide by all gold concepts, missing ones included."""
    n = F.count("*")
    counts = {c: F.count_if(c) for c in ("missing", "top_exact", "beam_exact")}
    return evaluated.groupBy(*keys).agg(n.alias("n_concepts"), *[v.alias(f"n_{c}") for c, v in counts.items()], *[(v / n).alias(f"{c}_rate") for c, v in counts.items()])


def graded_metrics(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Means of the graded columns, missing concepts skipped, and the selection gap: mean top less mean best, 0 at least."""
    means = evaluated.groupBy(*keys).agg(F.count("top_ned").alias("n"), F.avg("top_ned").alias("mean_top_ned"), F.avg("best_ned").alias("mean_best_ned"), F.avg("top_ed").alias("mean_top_ed"), F.avg("best_ed").alias("mean_best_ed"))
    return means.withColumn("selection_gap", F.greatest(F.lit(0.0), F.col("mean_top_ned") - F.col("mean_best_ned")))


def concept_distances(forms: DataFrame, method: str = "cognates") -> DataFrame:
    """``taxon_a, taxon_b, concept_id, d``: how far two varieties are apart in each concept that both have.

    ``cognates``: 0 where they have a common cognate set, else 1; a form without one has a set of its concept and
    sounds. ``forms``: the mean normalised distance of all pairs of their forms. A variety and concept has few forms, so
    pairs stay few.
    """
    if method == "cognates":
        own = F.coalesce("cognate_set_id", F.concat_ws("\x1f", "concept_id", F.array_join(phonetic_segments(F.col("segments")), "\x1e")))
        sets = forms.groupBy("variety_id", "concept_id").agg(F.collect_set(own).alias("sets"))
    elif method == "forms":
        sets = forms.select("variety_id", "concept_id", phonetic_segments(F.col("segments")).alias("sets")).distinct()
    else:
        raise ValueError(f"method is cognates or forms, not {method}")
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.concept_id") == F.col("b.concept_id")) & (F.col("a.variety_id") < F.col("b.variety_id")))
    named = pairs.select(F.col("a.variety_id").alias("taxon_a"), F.col("b.variety_id").alias("taxon_b"), F.col("a.concept_id").alias("concept_id"), F.col("a.sets").alias("x"), F.col("b.sets").alias("y"))
    if method == "cognates":
        return named.select("taxon_a", "taxon_b", "concept_id", (1 - F.arrays_overlap("x", "y").cast("int")).alias("d"))
    return named.groupBy("taxon_a", "taxon_b", "concept_id").agg(F.avg(normalized_edit_distance(F.col("x"), F.col("y"))).alias("d"))


def language_distance(forms: DataFrame, method: str = "cognates") -> DataFrame:
    """``taxon_a, taxon_b, distance, n_concepts``: the mean of :func:`concept_distances`, each concept counting once."""
    return concept_distances(forms, method).groupBy("taxon_a", "taxon_b").agg(F.avg("d").alias("distance"), F.count("*").alias("n_concepts"))


def holdout(concepts: DataFrame, share: float = 0.3) -> DataFrame:
    """``node_id, concept_id`` in the order of sha256(node NUL concept); the last are held out, never all."""
    digest = F.sha2(F.concat("node_id", F.lit("\0"), "concept_id"), 256)
    node = Window.partitionBy("node_id")
    n = F.count("*").over(node)
    held = F.least(n - 1, F.bround(n * F.lit(share)).cast("long"))
    return concepts.withColumns({"position": F.row_number().over(node.orderBy(digest)), "_n": n, "_held": held}).select("node_id", "concept_id", "position", (F.col("position") > F.col("_n") - F.col("_held")).alias("held_out"))


def recoverability(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How far the branches' own segment maps lead to the gold forms: ``concept_id, class``, and ``child_id, n_concepts, n_deleting``.

    ``pairs(child_id, concept_id, ordinal, left, right)`` are a branch's form and the gold of the concept.
    ``single``: some branch's form becomes the gold form when each of its segments is replaced by what most often stands for
    it; ``mixed``: none does, and some branch has a segment for each of the gold form's; ``none`` otherwise. A branch deletes
    in a concept where one of the gold form's segments has none in it.
    """
    maps = segment_map(pairs, ["child_id"])
    # A branch has as many entries as segments.
    entry = F.struct("source", F.struct(F.col("target").alias("t")))
    maps = maps.groupBy("child_id").agg(F.map_from_entries(F.collect_list(entry)).alias("map"))
    different = pairs.groupBy("child_id", "concept_id", "left", "right").agg(F.count("*").alias("_n"))
    aligned = align_pairs(different).join(maps, "child_id", "left")
    shown = F.filter(F.transform("left", lambda s: F.element_at("map", s)["t"]), lambda t: t.isNotNull())
    both = F.arrays_zip(F.col("aligned_left").alias("a"), F.col("aligned_right").alias("b"))
    deletes = F.exists(both, lambda c: c["a"].isNull() & c["b"].isNotNull())
    judged = aligned.select("child_id", "concept_id", "_n", (shown == F.col("right")).alias("hit"), deletes.alias("deletes"))
    per = judged.groupBy("concept_id").agg(F.bool_or("hit").alias("hit"), F.bool_and("deletes").alias("deletes"))
    classes = per.select("concept_id", F.when(F.col("hit"), "single").when(~F.col("deletes"), "mixed").otherwise("none").alias("class"))
    deletions = judged.groupBy("child_id").agg(F.sum("_n").alias("n_concepts"), F.sum(F.when(F.col("deletes"), F.col("_n")).otherwise(0)).alias("n_deleting"))
    return classes, deletions


def tied_pairs(candidates: DataFrame, keys: list[str], within: float = 1e-9) -> DataFrame:
    """``keys, first, second``: the two best candidates where their scores lie within ``within``."""
    two = candidates.where("rank <= 2").groupBy(*keys).agg(
        *[F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}_{i}") for i in (1, 2) for c in ("log_score", "segments")]
    )
    return two.where(F.col("log_score_1") - F.col("log_score_2") < within).select(*keys, F.col("segments_1").alias("first"), F.col("segments_2").alias("second"))


def clade_support(ties: DataFrame, clades: DataFrame, forms: DataFrame) -> DataFrame:
    """Evidence from outside a node for the two candidates of ``ties(node_id, concept_id, first, second)``.

    Adds for each, as ``_first`` and ``_second``: ``n_clades``, the clades outside the node (``clades(node_id, clade_id,
    leaf_id)``) of which one leaf's form has all the segments that the one candidate has and the other has not (boundaries
    apart; 0 if there are none); ``distance``, the mean normalised edit distance to the forms of the outside leaves (1 without
    any); ``boundaries``, their number. A leaf counts with one form of a concept, that of the smallest form_id.
    """
    leaf = forms.groupBy(F.col("variety_id").alias("leaf_id"), "concept_id").agg(F.min_by("segments", "form_id").alias("form"))
    outside = clades.select("node_id", "clade_id", "leaf_id").distinct().join(leaf, "leaf_id")
    sides = {"first": "second", "second": "first"}
    pairs = ties.join(outside, ["node_id", "concept_id"], "left")
    totals = []
    for side, other in sides.items():
        own = F.filter(F.array_except(side, other), lambda s: ~s.isin(*BOUNDARIES))
        shows = (F.size(own) > 0) & (F.size(F.array_except(own, F.col("form"))) == 0)
        near = F.when(F.col("form").isNotNull(), normalized_edit_distance(F.col(side), F.col("form")))
        totals += [F.count_distinct(F.when(shows, F.col("clade_id"))).alias(f"n_clades_{side}"), F.coalesce(F.avg(near), F.lit(1.0)).alias(f"distance_{side}")]
    per = pairs.groupBy("node_id", "concept_id", "first", "second").agg(*totals)
    return per.withColumns({f"boundaries_{side}": F.size(F.filter(side, lambda s: s.isin(*BOUNDARIES))) for side in sides})


POLICIES = ("alphabetical", "daughters", "clades", "morphs")


def compare_policies(supported: DataFrame, gold: DataFrame, clades: DataFrame) -> DataFrame:
    """``node_id, policy, n_ties, ceiling, n_clades, hits``: how often each way to choose between tied candidates picks the gold form.

    Policies: the smaller by code points; the nearer to the outside leaves; more clades; fewer boundaries, then more
    clades. What is left open goes to the first candidate. ``ceiling``: ties of which either candidate is gold. Concepts
    without gold are left out; a node without clades outside has null hits.
    """
    right = gold.groupBy("concept_id").agg(F.min_by("segments", "form_id").alias("gold"))
    judged = supported.join(right, "concept_id")
    by = lambda name, sign=1: F.col(f"{name}_first") * sign <= F.col(f"{name}_second") * sign
    fewer = F.col("boundaries_first") - F.col("boundaries_second")
    ways = dict(zip(POLICIES, (F.col("first") <= F.col("second"), by("distance"), by("n_clades", -1), (fewer < 0) | ((fewer == 0) & by("n_clades", -1))), strict=True))
    picked = lambda way: F.when(way, F.col("first")).otherwise(F.col("second")) == F.col("gold")
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), picked(way).alias("hit")) for name, way in ways.items()])).alias("p")
    either = (F.col("first") == F.col("gold")) | (F.col("second") == F.col("gold"))
    per = judged.select("node_id", either.alias("either"), rows).groupBy("node_id", "p.policy")
    per = per.agg(F.count("*").alias("n_ties"), F.count_if("either").alias("ceiling"), F.count_if("p.hit").alias("hits"))
    sizes = clades.groupBy("node_id").agg(F.count_distinct("clade_id").alias("n_clades"))
    out = per.join(sizes, "node_id", "left").withColumn("n_clades", F.coalesce("n_clades", F.lit(0)))
    return out.select("node_id", "policy", "n_ties", "ceiling", "n_clades", F.when(F.col("n_clades") > 0, F.col("hits")).alias("hits"))


SHAPE = ("target", "replacement", "left", "right", "word_initial", "word_final")


def score_rules(commits: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: committed rules against true ones by structure and branch.

    Both hold ``child_id`` and the parts of a rule. ``n_right`` committed rules are true ones of their branch,
    ``n_found`` true ones are committed; ``n_misdirected`` rules sit on a known branch that has no true rule,
    ``n_unknown`` on a branch that the answers do not name (rows with null parts name a branch without rules).
    """
    known = answers.select("child_id").distinct()
    true = answers.where("target is not null").select("child_id", *SHAPE).distinct()
    mine = commits.select("child_id", *SHAPE).distinct()
    keys = ["child_id", *SHAPE]
    marked = mine.join(true.withColumn("_true", F.lit(1)), keys, "left").join(known.withColumn("_known", F.lit(1)), "child_id", "left").join(true.select("child_id").distinct().withColumn("_changed", F.lit(1)), "child_id", "left")
    own = marked.agg(F.count("*").alias("n_committed"), F.count("_true").alias("n_right"), F.count_if(F.col("_known").isNotNull() & F.col("_changed").isNull()).alias("n_misdirected"), F.count_if(F.col("_known").isNull()).alias("n_unknown"))
    found = true.join(mine.withColumn("_mine", F.lit(1)), keys, "left").agg(F.count("*").alias("n_true"), F.count("_mine").alias("n_found"))
    return own.join(F.broadcast(found)).withColumns({"precision": F.try_divide("n_right", "n_committed"), "recall": F.try_divide("n_found", "n_true")})


def functional_recovery(outputs: DataFrame, parents: DataFrame) -> DataFrame:
    """``child_id, n_concepts, rate``: share of concepts in which a branch's cascade gives the parent's form.

    ``outputs(child_id, parent_id, concept_id, output)``, ``parents(parent_id, concept_id, segments)``; a
    concept counts once, and is reached if any pair of forms agrees; one that the parent lacks is not.
    """
    joined = outputs.join(parents.select("parent_id", "concept_id", F.col("segments").alias("_want")), ["parent_id", "concept_id"], "left")
    agrees = F.coalesce(F.col("output") == F.col("_want"), F.lit(False))
    per = joined.groupBy("child_id", "concept_id").agg(F.bool_or(agrees).alias("hit"))
    return per.groupBy("child_id").agg(F.count("*").alias("n_concepts"), F.avg(F.col("hit").cast("int")).alias("rate"))
