"""Queries over the comparative-wordlist views, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.operators import alignment, beam, evaluation, rules, runs, selection, tree
from lexloom.plans.scratch import Scratch
from lexloom.sources import views
from lexloom.sources.tables import table
from lexloom.streaming import events

#: All leaves of the tree in child order, for the SQL of tuples; the queries read them from the tree.
VARIETIES = [f"Brand#{i}" for i in range(1, 26)]

# Shared SQL of the views.
FORMS = "v_forms AS (SELECT p_partkey AS form_id, p_brand AS variety_id, 'c' || p_size AS concept_id, list_transform(regexp_extract_all(p_name, '.'), lambda c: CASE WHEN c = ' ' THEN '+' ELSE c END) AS segments, 'c' || p_size || ':' || substr(p_name, 1, 1) AS cognate_set_id FROM part)"
EDGES = "v_brands AS (SELECT DISTINCT p_brand AS child_id, regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER AS n FROM part), v_edges AS (SELECT 'g' || ceil(n / 5)::INTEGER AS parent_id, child_id, n AS child_ordinal, 1.0::DOUBLE AS branch_length FROM v_brands UNION ALL SELECT DISTINCT 'root', 'g' || ceil(n / 5)::INTEGER, ceil(n / 5)::INTEGER, 1.0::DOUBLE FROM v_brands)"
CLOSURE = "v_closure AS (SELECT node AS ancestor_id, node AS descendant_id, 0 AS depth FROM (SELECT parent_id AS node FROM v_edges UNION SELECT child_id FROM v_edges) UNION ALL SELECT c.ancestor_id, e.child_id, c.depth + 1 FROM v_closure c JOIN v_edges e ON e.parent_id = c.descendant_id)"
PADDED = "v_groups AS (SELECT concept_id, cognate_set_id, max(len(segments)) AS width FROM v_forms GROUP BY ALL HAVING count(DISTINCT variety_id) >= 2), v_cells AS (SELECT concept_id, cognate_set_id, variety_id, form_id, unnest(range(0, width))::INTEGER AS col, segments FROM v_forms JOIN v_groups USING (concept_id, cognate_set_id)), v_cols AS (SELECT concept_id, cognate_set_id, variety_id, form_id, col, segments[col + 1] AS segment FROM v_cells)"
CALLS = """v_calls AS (SELECT user_id AS session_id, event_id, ts, event_type AS tool, event_type = 'error' AS rejected,
    'schema:f' || (k % 4) AS code, value AS cost, (k % 60)::DOUBLE AS seconds, k
    FROM (SELECT *, (props ->> '$.k')::BIGINT AS k FROM events))"""
TRAJECTORIES = """v_traj AS (SELECT conv_id, conv_id % 7 AS run_id, 'g' || (1 + conv_id % 5) AS node_id, conv_id % 5 <> 0 AS completed,
    count(*) AS tool_calls, count(*) FILTER (role = 'system') AS protocol_failures, conv_id % 3 AS schema_hash, 'm' || (conv_id % 2) AS model,
    CASE WHEN conv_id % 10 = 0 THEN 'timeout: turn ' || count(*) WHEN conv_id % 5 = 0 THEN 'stall: ' || conv_id END AS failure,
    conv_id % 4 AS n_rules, count(*) FILTER (role = 'assistant') AS n_steps, (conv_id % 11 = 0)::BIGINT AS n_no_ops,
    count(*) FILTER (role = 'user') % 3 AS n_inspections, count(*) FILTER (role = 'assistant') AS n_tests, conv_id % 3 AS n_cascades,
    CASE WHEN conv_id % 9 <> 0 THEN (conv_id % 10) / 10.0::DOUBLE END AS anomaly_rate FROM conversations GROUP BY conv_id)"""
LEAF = "v_raw AS (SELECT variety_id, concept_id, segments, -ln(count(*) OVER (PARTITION BY variety_id, concept_id)) AS s FROM v_forms), v_mx AS (SELECT *, max(s) OVER (PARTITION BY variety_id, concept_id, segments) AS m FROM v_raw), v_merged AS (SELECT variety_id, concept_id, segments, m + ln(sum(exp(s - m))) AS log_score FROM v_mx GROUP BY variety_id, concept_id, segments, m), v_ranked AS (SELECT *, row_number() OVER (PARTITION BY variety_id, concept_id ORDER BY round(log_score, 12) DESC, segments)::INTEGER AS rank FROM v_merged), v_beam AS (SELECT *, exp(log_score - max(log_score) OVER (PARTITION BY variety_id, concept_id)) AS w FROM v_ranked WHERE rank <= 5), v_leaf AS (SELECT variety_id, concept_id, segments, log_score, rank, w / sum(w) OVER (PARTITION BY variety_id, concept_id) AS probability FROM v_beam)"


def _rules_sql() -> str:
    """The compiled rules as literal rows, as lists."""
    compiled = []
    for node, ordinal, dsl, _, confidence in views.RULES:
        body, _, context = dsl.partition("/")
        target, to = (x.split() for x in body.split(">"))
        left, _, right = context.partition("_")
        left, right = left.split(), right.split()
        first, last = left[:1] == ["#"], right[-1:] == ["#"]
        lists = [target, [t for t in to if t not in rules.EMPTY], left[1:] if first else left, right[:-1] if last else right]
        sql = ", ".join("[" + ", ".join(f"'{t}'" for t in x) + "]::VARCHAR[]" for x in lists)
        compiled.append(f"('{node}', {ordinal}, '{dsl}', {sql}, {first}, {last}, {confidence}::DOUBLE)")
    return "v_rules(node_id, rule_ordinal, dsl, target, replacement, lft, rgt, word_initial, word_final, confidence) AS (VALUES " + ", ".join(compiled) + ")"


RULES = _rules_sql()
_match = "list_filter(range(0, greatest(len(seg) - len(target) + 1, 0)), lambda i: seg[i + 1:i + len(target)] = target AND i >= len(lft) AND seg[greatest(i - len(lft), 0) + 1:greatest(i - len(lft), 0) + len(lft)] = lft AND i + len(target) + len(rgt) <= len(seg) AND seg[i + len(target) + 1:i + len(target) + len(rgt)] = rgt AND (NOT word_initial OR i = 0) AND (NOT word_final OR i + len(target) = len(seg)))"


def _rewrite_sql(source: str, keep: str) -> str:
    """Walk each (form, rule) row left to right, replacing at free matches."""
    return f"""s AS (SELECT *, {_match} AS starts FROM {source}),
    w AS (SELECT {keep}, seg, target, replacement, starts, 0 AS pos, []::VARCHAR[] AS output FROM s
      UNION ALL SELECT {keep}, seg, target, replacement, starts, CASE WHEN list_contains(starts, pos) THEN pos + len(target) ELSE pos + 1 END, CASE WHEN list_contains(starts, pos) THEN list_concat(output, replacement) ELSE list_append(output, seg[pos + 1]) END FROM w WHERE pos < len(seg))"""


def wordlist_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.forms(spark, sf_dir)


#: Rule strings with A and B for two tokens, and what the grammar says of each: target, replacement,
#: left and right as tokens written together, edge flags, error.
GRAMMAR = [
    ("A > B", "A", "B", "", "", False, False, None), ("A > Ø", "A", "", "", "", False, False, None), ("A >", "A", "", "", "", False, False, None),
    ("A > ∅ / _ B", "A", "", "", "B", False, False, None), ("A > B / # _", "A", "B", "", "", True, False, None), ("A > B / #A _ B#", "A", "B", "A", "B", True, True, None),
    ("A B > B Ø / A _", "A B", "B Ø", "A", "", False, False, None), ("Ø > B", "", "B", "", "", False, False, "target"), ("> B", "", "B", "", "", False, False, "target"),
    ("A# > B", "A#", "B", "", "", False, False, "marker"), ("A > _B", "A", "_B", "", "", False, False, "marker"), ("A > B / A", "A", "B", "A", "", False, False, "focus"),
    ("A > B / _ _", "A", "B", "", "", False, False, "focus"), ("A > B / A / _", "A", "B", "", "", False, False, "slash"), ("A > B / A # _", "A", "B", "A #", "", False, False, "edge"),
    ("A > B / Ø _", "A", "B", "", "", False, False, "context"), ("A > A", "A", "A", "", "", False, False, "no-op"), ("A B", "A B", "", "", "", False, False, "arrow"),
]


def compiled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid rule strings of the first two letters of each part's name."""
    shape = F.element_at(F.array(*[F.lit(g[0]) for g in GRAMMAR]), (F.col("p_partkey") % len(GRAMMAR) + 1).cast("int"))
    dsl = F.replace(F.replace(shape, F.lit("A"), F.substring("p_name", 1, 1)), F.lit("B"), F.substring("p_name", 2, 1))
    different = F.substring("p_name", 1, 1) != F.substring("p_name", 2, 1)
    strings = table(spark, sf_dir, "part").where(different).select(dsl.alias("dsl")).distinct()
    compiled = rules.compile_rules(strings).withColumn("complexity", rules.complexity())
    good = F.col("error").isNull()
    parts = [F.when(good, F.col(c)).alias(c) for c in ("target", "replacement", "left", "right", "word_initial", "word_final", "complexity")]
    return compiled.select("dsl", "rule_id", *parts, "error")


def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = rules.compile_rules(views.rules(spark)).withColumn("rule_id", F.concat_ws(":", "node_id", F.col("rule_ordinal").cast("string")))
    found = rules.apply_rule(views.forms(spark, sf_dir).select("form_id", "segments"), compiled)
    return found.select("form_id", "rule_id", "output", "n_matches", "target_occurrences", "status", "emptied")


def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_report(rule_results(spark, sf_dir))


def _cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir).select("parent_id", F.col("child_id").alias("variety_id"))
    compiled = rules.compile_rules(views.rules(spark))
    return rules.apply_cascade(views.forms(spark, sf_dir).join(edges, "variety_id"), compiled, "parent_id")


def cascade_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascaded(spark, sf_dir).select("form_id", "parent_id", "output", F.aggregate("trace", F.lit(0), lambda s, t: s + t["n_matches"]).alias("n_matches"))


def cascade_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: an ordered cascade per variety, and how many concepts converge at each parent."""
    return rules.convergence_rate(rules.convergence(_cascaded(spark, sf_dir).withColumnRenamed("variety_id", "child_id")))


def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.closure(views.edges(spark, sf_dir))


def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.node_levels(views.edges(spark, sf_dir))


def tree_outgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.outgroups(views.edges(spark, sf_dir))


def leaf_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beam.leaf_beam(views.forms(spark, sf_dir), 5).withColumns({"log_score": F.round("log_score", 9), "probability": F.round("probability", 9)})


def beam_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beam.tie_count(beam.leaf_beam(views.forms(spark, sf_dir), 5), ["variety_id", "concept_id"])


def correspondence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.pairwise_correspondences(views.aligned(spark, sf_dir))


def correspondence_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.correspondence_contexts(views.aligned(spark, sf_dir))


def _leaves(spark: SparkSession, sf_dir: str) -> list[str]:
    """Leaves of the tree in child order; as many as there are varieties."""
    edges = views.edges(spark, sf_dir).where("child_id is not null")
    leaves = edges.join(edges.select(F.col("parent_id").alias("child_id")).distinct(), "child_id", "left_anti")
    return [r.child_id for r in leaves.orderBy("child_ordinal", "child_id").collect()]


def correspondence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.correspondence_sets(views.aligned(spark, sf_dir), _leaves(spark, sf_dir))


def correspondence_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.inventory_stats(correspondence_sets(spark, sf_dir))


def nearest_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = views.forms(spark, sf_dir)
    gold = forms.where("variety_id = 'Brand#25'")
    return evaluation.nearest_gold(forms.where("variety_id <> 'Brand#25'").select("form_id", "concept_id", "segments"), gold).withColumn("ned", F.round("ned", 9))


def distance_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_gold(spark, sf_dir)
    return evaluation.distribution(near, "ned", ["concept_id"]).select("concept_id", "n", *[F.round(c, 7).alias(c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max")])


def evaluated_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = views.forms(spark, sf_dir)
    best = beam.leaf_beam(forms.where("variety_id = 'Brand#24'"), 5).select("concept_id", "segments", "rank")
    found = evaluation.evaluate_targets(best, forms.where("variety_id = 'Brand#25'"))
    return found.withColumns({c: F.round(c, 9) for c in ("top_ned", "best_ned")})


def language_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.language_distance(views.forms(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


def held_out_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir).select(F.col("parent_id").alias("node_id"), F.col("child_id").alias("variety_id"))
    return evaluation.holdout(views.forms(spark, sf_dir).join(edges, "variety_id").select("node_id", "concept_id").distinct())


def repeated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.repeated_failures(views.calls(spark, sf_dir), 12, 2)


def window_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.window_saturation(views.calls(spark, sf_dir), 20, 3, ("schema:f3",), repeated=3)


def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.running_budget(views.calls(spark, sf_dir), 500.0, 300.0)


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.event_counts(views.events(spark, sf_dir), ("error",))


def seed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.seed_outcomes(views.trajectories(spark, sf_dir))


def schema_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.schema_variants(views.trajectories(spark, sf_dir), 1)


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.quality_gate(views.trajectories(spark, sf_dir))


def phonetic_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.forms(spark, sf_dir).select("form_id", selection.phonetic_segments(F.col("segments")).alias("segments"))


def variety_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.variety_counts(views.forms(spark, sf_dir))


def benchmark_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    daughters = [v for v in _leaves(spark, sf_dir) if v != "Brand#25"]
    return selection.benchmark_concepts(views.forms(spark, sf_dir), daughters, "Brand#25")


def searched_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pattern at each position."""
    forms = views.forms(spark, sf_dir).select("form_id", "segments")
    asked = [(["e", "d"], "any", True), (["r", "e"], "initial", True), (["e", "t"], "final", False), (["d", "w"], "any", False)]
    parts = [selection.search_forms(forms, p, at, kept).select("form_id", F.lit(f"{''.join(p)} {at} {kept}".lower()).alias("search")) for p, at, kept in asked]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def tree_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that lacks one group, against all varieties."""
    edges = views.edges(spark, sf_dir).where("parent_id <> 'g5'")
    return selection.reconcile_tree(edges, views.forms(spark, sf_dir))


def distance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper half of the distances, of which only Brand#1 has mirrors."""
    upper = language_distance(spark, sf_dir).select("taxon_a", "taxon_b", "distance")
    return selection.check_distances(upper.union(upper.where("taxon_a = 'Brand#1'").select("taxon_b", "taxon_a", "distance")))


def largest_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand, the concepts whose nearest form is furthest from gold."""
    near = nearest_gold(spark, sf_dir).join(views.forms(spark, sf_dir).select("form_id", F.col("variety_id").alias("node_id")), "form_id")
    return selection.largest_misses(near.groupBy("node_id", "concept_id").agg(F.min("ed").alias("ed")), 5)


def best_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beam.best_lexicon(beam.leaf_beam(views.forms(spark, sf_dir), 5))


def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.trajectory_summary(views.trajectories(spark, sf_dir))


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = events.stream_event_counts(events.read_events(spark, sf_dir))
    return events.drain_whole(stream, Scratch(spark).root, ["window_start", "node_id", "kind"])


QUERIES = {f.__name__: f for f in (cascade_convergence, wordlist_forms, compiled_rules, rule_results, rule_report, cascade_outputs, tree_closure, tree_levels, tree_outgroups, leaf_beam, beam_ties, correspondence_pairs, correspondence_contexts, correspondence_sets, correspondence_inventory, nearest_gold, distance_distribution, evaluated_targets, language_distance, held_out_concepts, repeated_failures, window_saturation, running_budget, event_counts, seed_outcomes, schema_variants, quality_gate, phonetic_forms, variety_counts, benchmark_concepts, searched_forms, tree_reconciliation, distance_violations, largest_misses, best_lexicon, trajectory_summary, stream_event_counts)}

_results = f"""WITH RECURSIVE {FORMS}, {RULES}, p AS (SELECT form_id, node_id || ':' || rule_ordinal AS rule_id, segments AS seg, target, replacement, lft, rgt, word_initial, word_final FROM v_forms, v_rules), {_rewrite_sql("p", "form_id, rule_id")},
r AS (SELECT form_id, rule_id, output, len(starts)::INTEGER AS n_matches, len(list_filter(range(0, greatest(len(seg) - len(target) + 1, 0)), lambda i: seg[i + 1:i + len(target)] = target))::INTEGER AS target_occurrences,
  CASE WHEN len(starts) > 0 THEN 'applied' WHEN target_occurrences > 0 THEN 'context' ELSE 'absent' END AS status, len(output) = 0 AS emptied FROM w WHERE pos >= len(seg))"""
_step = lambda k, source: f"x{k} AS (SELECT c.form_id, c.parent_id, c.seg, c.n, coalesce(target, ['\\0']) AS target, coalesce(replacement, []) AS replacement, coalesce(lft, []) AS lft, coalesce(rgt, []) AS rgt, coalesce(word_initial, false) AS word_initial, coalesce(word_final, false) AS word_final FROM {source} c LEFT JOIN v_rules ON node_id = parent_id AND rule_ordinal = {k}), {_rewrite_sql(f'x{k}', 'form_id, parent_id, n').replace('s AS (', f's{k} AS (', 1).replace('FROM s', f'FROM s{k}').replace('w AS (', f'w{k} AS (', 1).replace('FROM w ', f'FROM w{k} ')}, c{k} AS (SELECT form_id, parent_id, output AS seg, n + len(starts) AS n FROM w{k} WHERE pos >= len(seg))"
_cascade = f"WITH RECURSIVE {FORMS}, {EDGES}, {RULES}, c0 AS (SELECT form_id, parent_id, segments AS seg, 0 AS n FROM v_forms JOIN v_edges ON child_id = variety_id), {_step(1, 'c0')}, {_step(2, 'c1')}"
_sets = f"WITH {FORMS}, {PADDED}, cells AS (SELECT concept_id, cognate_set_id, col, variety_id, arg_max(coalesce(segment, chr(0)), form_id) AS seg FROM v_cols GROUP BY ALL), t AS (SELECT concept_id, [" + ", ".join(f"nullif(max(seg) FILTER (variety_id = '{v}'), chr(0))" for v in VARIETIES) + "] AS segments FROM cells GROUP BY concept_id, cognate_set_id, col), u AS (SELECT segments, concept_id, count(*) AS n FROM t WHERE len(list_filter(segments, lambda s: s IS NOT NULL)) > 0 GROUP BY ALL), sets AS (SELECT segments, sum(n)::BIGINT AS support, count(*) AS n_concepts, list(concept_id ORDER BY concept_id)[1:3] AS examples FROM u GROUP BY segments)"
_near = f"WITH {FORMS}, q AS (SELECT a.form_id, a.concept_id, a.segments, b.segments AS gold, levenshtein(array_to_string(a.segments, ''), array_to_string(b.segments, ''))::INTEGER AS ed, greatest(len(a.segments), len(b.segments)) AS l FROM v_forms a JOIN v_forms b ON a.concept_id = b.concept_id AND a.variety_id <> 'Brand#25' AND b.variety_id = 'Brand#25'), near AS (SELECT form_id, concept_id, segments, arg_min(gold, (ed / l, ed, gold)) AS nearest, arg_min(ed, (ed / l, ed, gold)) AS ed, round(min(ed / l), 9) AS ned FROM q GROUP BY ALL)"
_order = "PARTITION BY session_id ORDER BY ts, event_id"

_grammar = ", ".join(f"({i}, '{g[0]}', " + ", ".join(f"'{x}'" for x in g[1:5]) + f", {g[5]}, {g[6]}, " + (f"'{g[7]}'" if g[7] else "NULL") + ")" for i, g in enumerate(GRAMMAR))
_tokens = lambda c: f"CASE WHEN error IS NULL THEN list_filter(string_split(replace(replace({c}, 'A', a), 'B', b), ' '), lambda x: x <> '') END"
_compiled = f"""WITH g(i, dsl, t, r, l, x, first, last, error) AS (VALUES {_grammar}),
p AS (SELECT DISTINCT p_partkey % {len(GRAMMAR)} AS i, substr(p_name, 1, 1) AS a, substr(p_name, 2, 1) AS b FROM part WHERE substr(p_name, 1, 1) <> substr(p_name, 2, 1)),
d AS (SELECT replace(replace(dsl, 'A', a), 'B', b) AS dsl, {_tokens('t')} AS target, {_tokens('r')} AS replacement, {_tokens('l')} AS "left", {_tokens('x')} AS "right", first, last, error FROM p JOIN g USING (i))
SELECT DISTINCT dsl, 'rule-' || substr(sha256(dsl), 1, 12) AS rule_id, target, replacement, "left", "right", CASE WHEN error IS NULL THEN first END AS word_initial, CASE WHEN error IS NULL THEN last END AS word_final,
(1 + len(target) + len(replacement) + len("left") + len("right") + CASE WHEN error IS NULL THEN first::INTEGER + last::INTEGER END)::INTEGER AS complexity, error FROM d"""

ORACLES = {
    "wordlist_forms": f"WITH {FORMS} SELECT * FROM v_forms",
    "compiled_rules": _compiled,
    "rule_results": _results + " SELECT * FROM r",
    "rule_report": _results + " SELECT rule_id, count(*) FILTER (status = 'applied') AS n_applied, count(*) FILTER (status = 'context') AS n_context, count(*) FILTER (status = 'absent') AS n_absent, 0::BIGINT AS n_anchor, sum(n_matches)::BIGINT AS n_matches, count(*) FILTER (n_matches > 0) AS words_applied, 0::BIGINT AS anchors_matched, count(*) FILTER (status <> 'applied') AS exceptions FROM r GROUP BY rule_id",
    "cascade_outputs": _cascade + " SELECT form_id, parent_id, seg AS output, n::INTEGER AS n_matches FROM c2",
    "cascade_convergence": _cascade + ", k AS (SELECT c2.parent_id, concept_id, count(DISTINCT seg) AS o, count(DISTINCT variety_id) AS v FROM c2 JOIN v_forms USING (form_id) GROUP BY ALL) SELECT parent_id, count(*) AS n_concepts, count(*) FILTER (v = 1 OR o = 1) AS n_converging, count(*) FILTER (v <> 1 AND o <> 1) AS n_divergent, coalesce(list(concept_id ORDER BY concept_id) FILTER (v <> 1 AND o <> 1), [])[1:20] AS divergent_ids FROM k GROUP BY parent_id",
    "tree_closure": f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT *, descendant_id NOT IN (SELECT parent_id FROM v_edges) AS is_leaf FROM v_closure",
    "tree_levels": f"WITH RECURSIVE {EDGES}, {CLOSURE}, k AS (SELECT parent_id AS node_id, list(child_id ORDER BY child_ordinal, child_id) AS children FROM v_edges GROUP BY 1) SELECT node_id, max(depth) AS height, any_value(children) AS children FROM k JOIN v_closure ON ancestor_id = node_id GROUP BY node_id",
    "tree_outgroups": f"WITH RECURSIVE {EDGES}, {CLOSURE} SELECT a.descendant_id AS node_id, e.child_id AS clade_id, l.descendant_id AS leaf_id FROM v_closure a JOIN v_edges e ON e.parent_id = a.ancestor_id AND a.depth > 0 JOIN v_closure l ON l.ancestor_id = e.child_id AND l.descendant_id NOT IN (SELECT parent_id FROM v_edges) WHERE NOT EXISTS (SELECT 1 FROM v_closure o WHERE o.ancestor_id = e.child_id AND o.descendant_id = a.descendant_id)",
    "leaf_beam": f"WITH {FORMS}, {LEAF} SELECT variety_id, concept_id, segments, round(log_score, 9) AS log_score, rank, round(probability, 9) AS probability FROM v_leaf",
    "beam_ties": f"WITH {FORMS}, {LEAF}, n AS (SELECT *, lead(log_score) OVER (PARTITION BY variety_id, concept_id ORDER BY rank) AS nx, count(*) OVER (PARTITION BY variety_id, concept_id) AS n_candidates FROM v_leaf) SELECT variety_id, concept_id, n_candidates, coalesce(log_score - nx < 1e-9, false) AS tied FROM n WHERE rank = 1",
    "correspondence_pairs": f"WITH {FORMS}, {PADDED}, p AS (SELECT a.variety_id AS variety_a, b.variety_id AS variety_b, a.segment AS segment_a, b.segment AS segment_b, a.cognate_set_id || ':' || a.col AS example, count(*) AS n FROM v_cols a JOIN v_cols b ON a.cognate_set_id = b.cognate_set_id AND a.col = b.col AND a.variety_id < b.variety_id GROUP BY ALL) SELECT variety_a, variety_b, segment_a, segment_b, sum(n)::BIGINT AS n_columns, 0::BIGINT AS n_anchored, list(example ORDER BY example)[1:3] AS examples FROM p GROUP BY ALL",
    "correspondence_contexts": f"WITH {FORMS}, {PADDED} SELECT concept_id, cognate_set_id, variety_id, form_id, col, segment, lag(segment) OVER (PARTITION BY form_id ORDER BY col) AS previous, lead(segment) OVER (PARTITION BY form_id ORDER BY col) AS following FROM v_cols",
    "correspondence_sets": _sets + " SELECT * FROM sets",
    "correspondence_inventory": _sets + " SELECT count(*) AS n_sets, count(*) FILTER (support >= 2) AS n_supported, count(*) FILTER (support = 1) AS n_singletons FROM sets",
    "nearest_gold": _near + " SELECT form_id, concept_id, segments, nearest, ed, ned FROM near",
    "distance_distribution": _near + " SELECT concept_id, count(*) AS n, round(avg(ned), 7) AS mean, round(coalesce(stddev_samp(ned), 0), 7) AS sd, round(min(ned), 7) AS min, round(quantile_cont(ned, 0.25), 7) AS q1, round(quantile_cont(ned, 0.5), 7) AS median, round(quantile_cont(ned, 0.75), 7) AS q3, round(max(ned), 7) AS max FROM near GROUP BY concept_id",
    "evaluated_targets": f"""WITH {FORMS}, {LEAF}, g AS (SELECT concept_id, segments AS gold FROM v_forms WHERE variety_id = 'Brand#25'), b AS (SELECT * FROM v_leaf WHERE variety_id = 'Brand#24'),
p AS (SELECT g.concept_id, gold, segments, rank, levenshtein(array_to_string(segments, ''), array_to_string(gold, ''))::INTEGER AS ed, greatest(len(segments), len(gold)) AS l FROM g LEFT JOIN b ON b.concept_id = g.concept_id),
t AS (SELECT concept_id, min((ed / l, ed)) FILTER (rank = 1) AS t, min((ed / l, ed)) FILTER (ed IS NOT NULL) AS b, count(segments) = 0 AS missing, coalesce(bool_or(segments = gold AND rank = 1), false) AS top_exact, coalesce(bool_or(segments = gold), false) AS beam_exact FROM p GROUP BY concept_id)
SELECT concept_id, missing, top_exact, beam_exact, t[2] AS top_ed, round(t[1], 9) AS top_ned, b[2] AS best_ed, round(b[1], 9) AS best_ned FROM t""",
    "language_distance": f"WITH {FORMS}, s AS (SELECT variety_id, concept_id, list(DISTINCT cognate_set_id) AS sets FROM v_forms GROUP BY ALL) SELECT a.variety_id AS taxon_a, b.variety_id AS taxon_b, round(1 - avg(list_has_any(a.sets, b.sets)::INTEGER), 9) AS distance, count(*) AS n_concepts FROM s a JOIN s b ON a.concept_id = b.concept_id AND a.variety_id < b.variety_id GROUP BY ALL",
    "held_out_concepts": f"WITH {FORMS}, {EDGES}, d AS (SELECT DISTINCT parent_id AS node_id, concept_id FROM v_forms JOIN v_edges ON child_id = variety_id), o AS (SELECT *, (row_number() OVER (PARTITION BY node_id ORDER BY sha256(node_id || chr(0) || concept_id)))::INTEGER AS position, count(*) OVER (PARTITION BY node_id) AS n FROM d) SELECT node_id, concept_id, position, position > n - least(n - 1, round_even(n * 0.3, 0)) AS held_out FROM o",
    "repeated_failures": f"WITH {CALLS}, s AS (SELECT *, CASE WHEN rejected THEN tool || '|' || code ELSE '' END AS sig FROM v_calls), r AS (SELECT *, list(sig) OVER ({_order} ROWS 11 PRECEDING) AS recent FROM s), c AS (SELECT *, CASE WHEN sig = '' THEN 0 ELSE len(list_filter(recent, lambda x: x = sig)) END AS occurrences FROM r), f AS (SELECT *, sum((occurrences >= 2)::INTEGER) OVER (PARTITION BY session_id, sig ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM c) SELECT session_id, event_id, occurrences::INTEGER AS occurrences, CASE WHEN occurrences < 2 THEN NULL WHEN b = 1 THEN 'correct' ELSE 'stall' END AS action FROM f",
    "window_saturation": f"""WITH {CALLS}, s AS (SELECT *, CASE WHEN rejected THEN tool || '|' || code ELSE '' END AS sig FROM v_calls),
w AS (SELECT *, list(sig) OVER ({_order} ROWS 19 PRECEDING) AS recent, sum((rejected AND code <> 'schema:f3')::INTEGER) OVER ({_order} ROWS 19 PRECEDING)::BIGINT AS failures FROM s),
f AS (SELECT *, rejected AND failures >= 3 AND len(list_filter(recent, lambda x: x = sig)) < 3 AS saturated FROM w)
SELECT session_id, event_id, failures, saturated, CASE WHEN NOT saturated THEN NULL WHEN sum(saturated::INTEGER) OVER ({_order}) = 1 THEN 'correct' ELSE 'stall' END AS action FROM f""",
    "running_budget": f"""WITH {CALLS}, f AS (SELECT session_id, event_id, ts, (sum(cost::DECIMAL(20, 6)) OVER w)::DOUBLE AS spent, (sum(seconds::DECIMAL(20, 6)) OVER w)::DOUBLE AS elapsed FROM v_calls WINDOW w AS ({_order} ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, spent > 500.0 OR elapsed > 300.0 AS breached FROM f)
SELECT session_id, event_id, spent, elapsed, breached, breached AND sum(breached::INTEGER) OVER ({_order} ROWS UNBOUNDED PRECEDING) = 1 AS first_breach FROM b""",
    "event_counts": f"WITH {CALLS} SELECT 'n' || (session_id % 10) AS node_id, tool AS kind, count(*) AS n, tool = 'error' AS notable FROM v_calls GROUP BY ALL",
    "seed_outcomes": f"WITH {TRAJECTORIES} SELECT run_id, count(*) AS attempted, count(*) FILTER (completed) AS committed, count(*) FILTER (NOT completed) AS fallback, sum(tool_calls)::BIGINT AS tool_calls, sum(protocol_failures)::BIGINT AS protocol_failures, sum(n_rules)::BIGINT AS n_rules, coalesce(list_sort(list(DISTINCT split_part(failure, ':', 1)) FILTER (failure IS NOT NULL)), []) AS failures FROM v_traj GROUP BY run_id",
    "schema_variants": f"WITH {TRAJECTORIES} SELECT schema_hash, count(*) AS records, schema_hash = 1 AS is_current FROM v_traj GROUP BY schema_hash",
    "quality_gate": f"""WITH {TRAJECTORIES}, r AS (SELECT conv_id, list_filter([CASE WHEN NOT completed THEN 'incomplete' END, CASE WHEN n_steps = 0 THEN 'no step' END, CASE WHEN n_no_ops > 0 THEN 'no-op rule' END,
CASE WHEN n_inspections = 0 THEN 'no inspection' END, CASE WHEN protocol_failures > 1 AND protocol_failures / tool_calls > 0.25 THEN 'protocol failures' END, CASE WHEN n_tests < n_rules THEN 'fewer tests than rules' END,
CASE WHEN n_rules > 1 AND n_cascades = 0 THEN 'no cascade preview' END], lambda x: x IS NOT NULL) AS reasons FROM v_traj) SELECT conv_id, reasons, len(reasons) = 0 AS high_quality FROM r""",
    "phonetic_forms": f"WITH {FORMS} SELECT form_id, list_filter(segments, lambda x: x NOT IN ('+', '-')) AS segments FROM v_forms",
    "variety_counts": f"WITH {FORMS} SELECT variety_id, count(*) AS n_forms, count(DISTINCT concept_id) AS n_concepts FROM v_forms GROUP BY variety_id",
    "benchmark_concepts": f"WITH {FORMS}, d AS (SELECT * FROM v_forms WHERE variety_id <> 'Brand#25'), k AS (SELECT count(DISTINCT variety_id) AS k FROM d), g AS (SELECT concept_id, cognate_set_id FROM v_forms WHERE variety_id = 'Brand#25') SELECT concept_id, count(DISTINCT variety_id) = any_value(k) AS shared, count(DISTINCT variety_id) FILTER ((concept_id, cognate_set_id) IN (SELECT (concept_id, cognate_set_id) FROM g)) = any_value(k) AS fully_cognate FROM d, k GROUP BY concept_id",
    "searched_forms": "SELECT p_partkey AS form_id, 'ed any true' AS search FROM part WHERE contains(p_name, 'ed') UNION ALL SELECT p_partkey, 're initial true' FROM part WHERE starts_with(p_name, 're') UNION ALL SELECT p_partkey, 'et final false' FROM part WHERE ends_with(replace(p_name, ' ', ''), 'et') UNION ALL SELECT p_partkey, 'dw any false' FROM part WHERE contains(replace(p_name, ' ', ''), 'dw')",
    "tree_reconciliation": "SELECT DISTINCT p_brand AS variety_id, 'missing from the tree' AS violation FROM part WHERE regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER BETWEEN 21 AND 25",
    "distance_violations": f"WITH {FORMS}, s AS (SELECT DISTINCT variety_id, concept_id FROM v_forms) SELECT a.variety_id AS taxon_a, b.variety_id AS taxon_b, 'no mirror' AS violation FROM s a JOIN s b ON a.concept_id = b.concept_id AND a.variety_id < b.variety_id WHERE a.variety_id <> 'Brand#1' GROUP BY ALL UNION ALL SELECT a.v, b.v, 'missing' FROM (SELECT DISTINCT variety_id AS v FROM s) a JOIN (SELECT DISTINCT variety_id AS v FROM s) b ON a.v < b.v WHERE NOT EXISTS (SELECT 1 FROM s x JOIN s y ON x.concept_id = y.concept_id WHERE x.variety_id = a.v AND y.variety_id = b.v)",
    "largest_misses": _near
    + """, e AS (SELECT variety_id AS node_id, near.concept_id, min(ed) AS ed FROM near JOIN v_forms USING (form_id) GROUP BY ALL),
m AS (SELECT *, (row_number() OVER (PARTITION BY node_id ORDER BY ed DESC, concept_id))::INTEGER AS rank FROM e) SELECT * FROM m WHERE rank <= 5""",
    "best_lexicon": f"WITH {FORMS}, {LEAF} SELECT variety_id, concept_id, segments FROM v_leaf WHERE rank = 1",
    "trajectory_summary": f"WITH {TRAJECTORIES} SELECT count(*) AS records, count(*) FILTER (completed) AS completed, sum(tool_calls)::BIGINT AS tool_calls, sum(protocol_failures)::BIGINT AS protocol_failures, round(sum(protocol_failures) / sum(tool_calls), 9)::DOUBLE AS failure_rate, list_sort(list(DISTINCT model)) AS models, list_sort(list(DISTINCT split_part(failure, ':', 1)) FILTER (failure IS NOT NULL)) AS failure_types FROM v_traj",
    "stream_event_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, 'n' || (user_id % 10) AS node_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
}
