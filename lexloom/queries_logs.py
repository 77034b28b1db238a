"""Queries of run logs and streams over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom import queries as base
from lexloom.operators import evaluation, rules, runs, tree
from lexloom.plans.scratch import Scratch
from lexloom.sources import views
from lexloom.streaming import events

RUN_METRICS = ["attempted", "committed", "fallback", "tool_calls", "protocol_failures", "n_rules"]
SPREAD = ("mean", "sd", "min", "q1", "median", "q3", "max")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 7) for c in SPREAD})


def _evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation for each trajectory: distances from its counts; incomplete ones are fallbacks."""
    rows = views.trajectories(spark, sf_dir)
    return rows.select("conv_id", "run_id", "node_id", (~F.col("completed")).alias("fallback"), (F.col("protocol_failures") / F.col("tool_calls")).alias("top_ned"), F.when(F.col("conv_id") % 4 != 0, F.col("n_rules") / 4).alias("best_ned"))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics by run and node; runs before the third recorded no rate, and odd ones no support."""
    per = views.trajectories(spark, sf_dir).groupBy("run_id", "node_id").agg(F.count("*").alias("n"), F.count_if("completed").alias("c"), F.sum("n_rules").alias("divergent"))
    return per.select("run_id", "node_id", F.when(F.col("run_id") >= 3, F.col("c") / F.col("n")).alias("convergence_rate"), F.when(F.col("run_id") % 2 == 0, F.col("n") / 100).alias("branch_support"), "divergent")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = runs.seed_outcomes(views.trajectories(spark, sf_dir))
    return _rounded(runs.aggregate_sweep(outcomes, _evaluations(spark, sf_dir), RUN_METRICS, ["top_ned", "best_ned"]))


def failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failure_types(views.trajectories(spark, sf_dir))


def per_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.per_node_rows(views.trajectories(spark, sf_dir), _diagnostics(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("convergence_rate", "branch_support")})


def gold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.gold_summary(_evaluations(spark, sf_dir), ["top_ned", "best_ned"]))


def convergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.convergence_summary(_diagnostics(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("mean_rate", "mean_support")})


def metric_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of trajectories and of diagnostics, in one table."""
    own = evaluation.distributions(views.trajectories(spark, sf_dir), ["tool_calls", "protocol_failures", "anomaly_rate"], [])
    return _rounded(own.unionByName(evaluation.distributions(_diagnostics(spark, sf_dir), ["convergence_rate", "branch_support"], [])))


def _compiled(spark: SparkSession) -> DataFrame:
    return rules.compile_rules(views.rules(spark))


def confidence_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's rules at the nodes that trajectories give them, with a confidence from their number."""
    seen = views.trajectories(spark, sf_dir).select(F.col("node_id").alias("at"), (F.col("n_rules") / 10).alias("more")).distinct()
    law = _compiled(spark).join(seen, F.col("node_id") == F.col("at")).select("rule_id", "node_id", (F.col("confidence") * 0 + F.col("more")).alias("confidence"))
    return runs.confidence_spread(law).withColumn("spread", F.round("spread", 9))


def contradictory_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's rules, with each rule of a group turned at the root as well."""
    law = _compiled(spark).select("node_id", *["target", "left", "right", "word_initial", "word_final", "replacement"])
    turned = law.where("node_id <> 'root'").withColumns({"node_id": F.lit("root"), "replacement": F.array(F.lit("q"))})
    return runs.contradictory_mappings(law.unionByName(turned), views.edges(spark, sf_dir))


def unmentioned_correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.unmentioned_correspondences(_compiled(spark), tree.closure(views.edges(spark, sf_dir)))


def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.export_training_examples(views.trajectories(spark, sf_dir), max_anomaly_rate=0.5).select("conv_id", "node_id", "n_rules")


def _tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with JSON arguments that name concepts and forms here and there, as strings and numbers, or nothing that is known."""
    k = F.col("k").cast("string")
    named = F.concat(F.lit('{"concept_ids": ["c'), (F.col("k") % 50).cast("string"), F.lit('", "c\\u0037"], "c8": {"form_ids": [["'), k, F.lit('", "none"], '), k, F.lit('], "note": "c9", "n": 3}}'))
    arguments = F.when(F.col("k") % 13 == 0, '{"concept_ids": ["nowhere"]}').when(F.col("k") % 13 == 1, '{"concept_ids": ').otherwise(named)
    return views.calls(spark, sf_dir).withColumns({"arguments": arguments, "result": F.when(F.col("k") % 3 == 0, '{"relation": "outgroup"}').otherwise('{"relation": "active_child"}')})


def inspected_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = views.forms(spark, sf_dir)
    concepts = forms.select("concept_id").distinct()
    return runs.inspected_concepts(_tool_calls(spark, sf_dir), forms, concepts, ("view",))


def directionality_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = views.trajectories(spark, sf_dir).where("n_rules = 3").select(F.col("conv_id").alias("session_id"))
    return runs.directionality_evidence(_tool_calls(spark, sf_dir), claims, ("view", "click"))


def classified_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected calls; the places of the mistakes are made of their number."""
    k = (F.col("k") % 5).cast("string")
    places = F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("rules."), k, F.lit(".dsl")), F.lit("anomalies.0"), F.concat(F.lit("anomalies."), k)))
    errors = views.calls(spark, sf_dir).where("rejected").select(F.col("event_id").alias("error_id"), F.col("code").alias("kind"), places.alias("places"))
    codes = spark.createDataFrame([("schema:f1", "exploratory"), ("schema:f2:anomalies[],rules[].dsl", "exploratory")], "code string, category string")
    return runs.classify_errors(errors, codes)


def superseded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that select concepts and forms by the digits of their number; those that end in 9, or have an empty list, select everything."""
    k = F.col("k")
    digits = F.array_distinct(F.array(k % 3, k % 4))
    selected = {"concepts": F.when(k % 10 != 9, digits), "forms": F.when(k % 7 == 3, F.array(k % 2)).when(k % 7 == 5, F.array().cast("array<bigint>"))}
    calls = views.calls(spark, sf_dir).withColumns(selected | {"other": F.when(k % 2 == 0, "even")})
    return runs.superseded_calls(calls, ["concepts", "forms"], ("view", "click"))


def committed_rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the grammar's strings, written out, at the nodes of the tree they are dealt to."""
    strings = base.compiled_rules(spark, sf_dir).where("error is null")
    dealt = strings.withColumns({"node_id": F.concat(F.lit("g"), (F.length("dsl") % 5 + 1).cast("string")), "rule_ordinal": F.length("dsl")})
    return runs.committed_rule_rows(dealt)


def node_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the shortest form of their brands in each concept as their step, and the longest as the result, which one node lacks."""
    edges = views.edges(spark, sf_dir)
    nodes = edges.select(F.col("parent_id").alias("node_id")).distinct()
    below = views.forms(spark, sf_dir).join(edges.select(F.col("child_id").alias("variety_id"), F.col("parent_id").alias("node_id")), "variety_id")
    order = F.struct(F.size("segments"), F.col("form_id"))
    steps = below.groupBy("node_id", "concept_id").agg(F.min_by("segments", order).alias("segments"))
    results = below.where("node_id <> 'g2'").groupBy("node_id", "concept_id").agg(F.max_by("segments", order).alias("segments"))
    diagnostics = _diagnostics(spark, sf_dir).groupBy("node_id").agg(F.round(F.avg("convergence_rate"), 9).alias("convergence_rate"))
    gold = _evaluations(spark, sf_dir).groupBy("node_id").agg(F.count_if("fallback").alias("n_fallback"))
    asked = views.events(spark, sf_dir).where("kind in ('view', 'click')").groupBy(F.translate("node_id", "n", "g").alias("node_id")).agg(F.count("*").alias("n_evidence"))
    return runs.node_report(nodes, results, steps, runs.committed_rule_rows(_compiled(spark)), diagnostics, gold, asked)


def stream_failure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions on the stream of calls, as far as its watermark, ten minutes behind the last call, has come."""
    stream = events.stream_failure_windows(events.read_calls(spark, sf_dir), 12, 2, 4, ("schema:f3",), delay="10 minutes", idle="30 days")
    return events.drain(stream, Scratch(spark).root)


QUERIES = {
    f.__name__: f
    for f in (
        sweep, failure_types, per_node_rows, gold_summary, convergence_summary, metric_distributions, confidence_spread, contradictory_mappings, unmentioned_correspondences,
        training_examples, inspected_concepts, directionality_evidence, classified_errors, superseded_calls, committed_rule_rows, node_report, stream_failure_windows,
    )
}

_spread = "count(*) AS n, round(avg(value), 7) AS mean, round(coalesce(stddev_samp(value), 0), 7) AS sd, round(min(value), 7) AS min, round(quantile_cont(value, 0.25), 7) AS q1, round(quantile_cont(value, 0.5), 7) AS median, round(quantile_cont(value, 0.75), 7) AS q3, round(max(value), 7) AS max"
_long = lambda table, metrics, keys="": " UNION ALL ".join(f"SELECT {keys}'{m}' AS metric, {m}::DOUBLE AS value FROM {table} WHERE {m} IS NOT NULL" for m in metrics)
_seeds = f"WITH {base.TRAJECTORIES}, o AS (SELECT count(*) AS attempted, count(*) FILTER (completed) AS committed, count(*) FILTER (NOT completed) AS fallback, sum(tool_calls) AS tool_calls, sum(protocol_failures) AS protocol_failures, sum(n_rules) AS n_rules FROM v_traj GROUP BY run_id), v_eval AS (SELECT conv_id, node_id, NOT completed AS fallback, protocol_failures / tool_calls AS top_ned, CASE WHEN conv_id % 4 <> 0 THEN n_rules / 4 END AS best_ned FROM v_traj), kept AS (SELECT * FROM v_eval WHERE NOT fallback)"
_diag = f"WITH {base.TRAJECTORIES}, v_diag AS (SELECT run_id, node_id, CASE WHEN run_id >= 3 THEN count(*) FILTER (completed) / count(*) END AS convergence_rate, CASE WHEN run_id % 2 = 0 THEN count(*) / 100 END AS branch_support, sum(n_rules)::BIGINT AS divergent FROM v_traj GROUP BY run_id, node_id)"
_graded = ["top_ned", "best_ned"]
_digits = "list_distinct([k % 3, k % 4])"
_parsed = ", ".join(f"('{r[0]}', '{r[2]}')" for r in views.RULES)

ORACLES = {
    "sweep": f"""{_seeds} SELECT 'run' AS scope, NULL::VARCHAR AS node_id, metric, {_spread} FROM ({_long('o', RUN_METRICS)}) GROUP BY metric
UNION ALL SELECT 'all', NULL, metric, {_spread} FROM ({_long('kept', _graded)}) GROUP BY metric UNION ALL SELECT 'node', node_id, metric, {_spread} FROM ({_long('kept', _graded, 'node_id, ')}) GROUP BY ALL
UNION ALL SELECT 'excluded', NULL, 'fallbacks', count(*) FILTER (fallback), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM v_eval""",
    "failure_types": f"WITH {base.TRAJECTORIES} SELECT split_part(failure, ':', 1) AS failure_type, count(*) AS n FROM v_traj WHERE failure IS NOT NULL GROUP BY 1",
    "per_node_rows": f"{_diag} SELECT t.conv_id, t.run_id, t.node_id, completed, tool_calls, protocol_failures, round(convergence_rate, 9) AS convergence_rate, round(branch_support, 9) AS branch_support, divergent FROM v_traj t LEFT JOIN v_diag d ON d.run_id = t.run_id AND d.node_id = t.node_id",
    "gold_summary": f"{_seeds} SELECT NULL::VARCHAR AS node_id, metric, {_spread} FROM ({_long('kept', _graded)}) GROUP BY metric UNION ALL SELECT node_id, metric, {_spread} FROM ({_long('kept', _graded, 'node_id, ')}) GROUP BY ALL",
    "convergence_summary": f"{_diag} SELECT count(*) AS n_nodes, round(avg(convergence_rate), 9) AS mean_rate, count(*) FILTER (convergence_rate IS NULL) AS rate_unrecorded, round(avg(branch_support), 9) AS mean_support, count(*) FILTER (branch_support IS NULL) AS support_unrecorded, sum(divergent)::BIGINT AS n_divergent FROM v_diag",
    "metric_distributions": f"{_diag} SELECT metric, {_spread} FROM ({_long('v_traj', ['tool_calls', 'protocol_failures', 'anomaly_rate'])} UNION ALL {_long('v_diag', ['convergence_rate', 'branch_support'])}) GROUP BY metric",
    "confidence_spread": f"""WITH {base.TRAJECTORIES}, r(node_id, dsl) AS (VALUES {_parsed}), s AS (SELECT DISTINCT node_id, n_rules / 10 AS c FROM v_traj)
SELECT 'rule-' || substr(sha256(dsl), 1, 12) AS rule_id, count(DISTINCT r.node_id) AS n_nodes, round(max(c) - min(c), 9) AS spread FROM r JOIN s ON s.node_id = r.node_id GROUP BY dsl HAVING count(DISTINCT r.node_id) >= 2 AND max(c) - min(c) >= 0.25""",
    "contradictory_mappings": f"""WITH {base.EDGES}, g AS (SELECT DISTINCT parent_id AS n FROM v_edges WHERE parent_id <> 'root'), r(node_id, target, env, replacement) AS (VALUES ('g1', 'i', '_ n', ['e']), ('g2', 'b', '# _', ['p']), ('g3', 'r', '_ #', []::VARCHAR[]), ('g4', 'w', '+ _', ['v']), ('g5', 'd', '', ['t']), ('g5', 'd', '_ a', ['r'])),
p AS (SELECT target, env, ['q'] AS replacement FROM r UNION ALL VALUES ('d', '', ['t']), ('l l', '', ['l']))
SELECT 'root' AS parent_id, node_id AS child_id, [r.target] AS target, p.replacement AS parent_to, r.replacement AS child_to FROM r JOIN g ON n = node_id JOIN p ON p.target = r.target AND p.env = r.env WHERE p.replacement <> r.replacement""",
    "unmentioned_correspondences": f"""WITH {base.EDGES}, g AS (SELECT DISTINCT parent_id AS n FROM v_edges WHERE parent_id <> 'root'), r(node_id, target, replacement) AS (VALUES ('g1', ['i'], ['e']), ('g2', ['b'], ['p']), ('g3', ['r'], []::VARCHAR[]), ('g4', ['w'], ['v']), ('g5', ['d'], ['r']))
SELECT 'root' AS node_id, target, replacement, [node_id] AS established_at FROM r JOIN g ON n = node_id""",
    "training_examples": f"WITH {base.TRAJECTORIES}, q AS ({base.ORACLES['quality_gate'].replace('WITH ' + base.TRAJECTORIES + ', ', 'WITH ')}) SELECT conv_id, node_id, n_rules FROM v_traj WHERE completed AND anomaly_rate <= 0.5 AND conv_id IN (SELECT conv_id FROM q WHERE high_quality)",
    "inspected_concepts": f"""WITH {base.CALLS}, {base.FORMS}, d AS (SELECT DISTINCT concept_id FROM v_forms), n AS (SELECT * FROM v_calls WHERE k % 13 > 1)
SELECT DISTINCT session_id, concept_id FROM n JOIN d ON concept_id = 'c' || (k % 50) OR concept_id = 'c7' UNION SELECT session_id, concept_id FROM n JOIN v_forms ON form_id = k UNION SELECT session_id, concept_id FROM v_calls, d WHERE tool = 'view' AND k % 13 <= 1""",
    "directionality_evidence": f"""WITH {base.CALLS}, {base.TRAJECTORIES}, e AS (SELECT session_id, count(*) AS calls, count(*) FILTER (k % 3 = 0) AS outgroup_calls FROM v_calls WHERE tool IN ('view', 'click') GROUP BY 1), c AS (SELECT conv_id AS session_id, count(*) AS claims FROM v_traj WHERE n_rules = 3 GROUP BY 1)
SELECT session_id, coalesce(calls, 0) AS calls, coalesce(outgroup_calls, 0) AS outgroup_calls, coalesce(claims, 0) AS claims FROM e FULL JOIN c USING (session_id)""",
    "classified_errors": f"""WITH {base.CALLS}, e AS (SELECT event_id AS error_id, code || CASE WHEN k % 4 = 0 THEN '' ELSE ':anomalies[],rules[].dsl' END AS code FROM v_calls WHERE rejected) SELECT error_id, code, CASE WHEN code IN ('schema:f1', 'schema:f2:anomalies[],rules[].dsl') THEN 'exploratory' ELSE 'protocol' END AS category FROM e""",
    "superseded_calls": f"""WITH {base.CALLS}, c AS (SELECT session_id, event_id, ts, tool, k % 2 = 0 AS other, k % 10 = 9 AS whole, {_digits} AS d, CASE WHEN k % 7 = 3 THEN k % 2 END AS form FROM v_calls WHERE tool IN ('view', 'click'))
SELECT a.session_id, a.event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS superseded_by FROM c a JOIN c b ON a.session_id = b.session_id AND a.tool = b.tool AND a.other = b.other AND (a.ts, a.event_id) < (b.ts, b.event_id)
  AND (b.whole OR (NOT a.whole AND list_has_all(b.d, a.d))) AND (b.form IS NULL OR coalesce(a.form = b.form, false)) GROUP BY ALL""",
    "committed_rule_rows": f"""WITH c AS ({base.ORACLES['compiled_rules']}) SELECT 'g' || (length(dsl) % 5 + 1) AS node_id, length(dsl)::INTEGER AS rule_ordinal, rule_id, array_to_string(target, ' ') || ' > ' || CASE WHEN len(replacement) = 0 THEN 'Ø' ELSE array_to_string(replacement, ' ') END AS correspondence,
trim(CASE WHEN word_initial THEN '# ' ELSE '' END || array_to_string(list_append("left", '_'), ' ') || ' ' || array_to_string("right", ' ') || CASE WHEN word_final THEN ' #' ELSE '' END) AS environment FROM c WHERE error IS NULL""",
    "node_report": f"""{_diag}, {base.EDGES}, {base.FORMS}, p AS (SELECT node_id, count(*) AS n, count(*) FILTER (NOT completed) AS f FROM v_traj GROUP BY 1), d AS (SELECT node_id, round(avg(convergence_rate), 9) AS convergence_rate FROM v_diag GROUP BY 1),
r(node_id, rules) AS (VALUES ('root', ['d > t', 'l l > l']), ('g1', ['i > e']), ('g2', ['b > p']), ('g3', ['r > Ø']), ('g4', ['w > v']), ('g5', ['d > t', 'd > r'])), i AS (SELECT DISTINCT parent_id AS node_id FROM v_edges),
w AS (SELECT parent_id AS node_id, concept_id, segments, (len(segments), form_id) AS o FROM v_forms JOIN v_edges ON child_id = variety_id),
b AS (SELECT node_id, concept_id, CASE WHEN node_id = 'g2' THEN arg_min(segments, o) ELSE arg_max(segments, o) END AS segments FROM w GROUP BY node_id, concept_id),
bf AS (SELECT node_id, list(concept_id || ': ' || array_to_string(segments, ' ') ORDER BY concept_id) AS best_forms FROM b GROUP BY 1),
ev AS (SELECT 'g' || (user_id % 10) AS node_id, count(*) AS n_evidence FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT node_id, coalesce(rules, []) AS rules, coalesce(best_forms, []) AS best_forms, convergence_rate, f AS n_fallback, n_evidence FROM i LEFT JOIN r USING (node_id) LEFT JOIN p USING (node_id) LEFT JOIN d USING (node_id) LEFT JOIN bf USING (node_id) LEFT JOIN ev USING (node_id)""",
    "stream_failure_windows": f"""WITH {base.CALLS}, s AS (SELECT *, CASE WHEN rejected THEN tool || '|' || code ELSE '' END AS sig FROM v_calls),
r AS (SELECT *, list(sig) OVER ({base._order} ROWS 11 PRECEDING) AS recent, sum((rejected AND code <> 'schema:f3')::INTEGER) OVER ({base._order} ROWS 11 PRECEDING)::INTEGER AS failures FROM s),
c AS (SELECT *, CASE WHEN sig = '' THEN 0 ELSE len(list_filter(recent, lambda x: x = sig)) END::INTEGER AS occurrences FROM r),
m AS (SELECT *, occurrences >= 2 AS again, rejected AND failures >= 4 AND occurrences < 2 AS crowded FROM c),
f AS (SELECT *, sum(again::INTEGER) OVER (PARTITION BY session_id, sig ORDER BY ts, event_id) AS n_again, sum(crowded::INTEGER) OVER ({base._order}) AS n_crowded FROM m)
SELECT session_id, event_id, occurrences, failures, CASE WHEN again THEN 'repeated' ELSE 'window' END AS reason, CASE WHEN (CASE WHEN again THEN n_again ELSE n_crowded END) > 1 THEN 'stall' ELSE 'correct' END AS action FROM f
WHERE (again OR crowded) AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 600000 FROM v_calls)""",
}
