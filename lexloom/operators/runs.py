"""Analytics over session logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lexloom.operators.evaluation import distributions
from lexloom.plans.products import paired
from lexloom.plans.scratch import Scratch


def _order(calls: DataFrame):
    return Window.partitionBy("session_id").orderBy("ts", "event_id")


def _repeats(calls: DataFrame, width: int) -> DataFrame:
    """Add ``occurrences``: how often a rejected call's own (tool, code) was rejected among the last ``width`` calls; 0 for others."""
    signature = F.when(F.col("rejected"), F.concat_ws("|", "tool", "code")).otherwise("")
    counted = calls.withColumn("sig", signature).withColumn("recent", F.collect_list("sig").over(_order(calls).rowsBetween(-(width - 1), 0)))
    return counted.withColumn("occurrences", F.when(F.col("sig") == "", 0).otherwise(F.size(F.filter("recent", lambda x: x == F.col("sig"))))).drop("recent")


def repeated_failures(calls: DataFrame, width: int, least: int) -> DataFrame:
    """Per call: how often its own (tool, code) failed among the last ``width`` calls; the first flag corrects, later ones stall."""
    counted = _repeats(calls, width)
    flag = (F.col("occurrences") >= least).cast("int")
    before = F.sum(flag).over(Window.partitionBy("session_id", "sig").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    action = F.when(flag == 0, F.lit(None)).when(before == 1, "correct").otherwise("stall")
    return counted.withColumn("action", action).select("session_id", "event_id", "occurrences", "action")


def window_saturation(calls: DataFrame, width: int, least: int, exploratory: tuple[str, ...] = (), repeated: int | None = None) -> DataFrame:
    """Per call: protocol failures among the last ``width`` calls of the session, whether the call is met for them, and how.

    Rejections with a code of ``exploratory`` are no failures of protocol. Only a rejected call is met: with a
    correction when ``least`` of the window failed for the first time, later with a stall. Where ``repeated`` is given,
    a call whose own signature occurs so often is met for that instead (:func:`repeated_failures`).
    """
    protocol = F.col("rejected") & ~F.coalesce(F.col("code").isin(*exploratory), F.lit(False))
    failures = F.sum(protocol.cast("int")).over(_order(calls).rowsBetween(-(width - 1), 0))
    flagged = _repeats(calls, width).withColumn("failures", failures)
    met = F.col("rejected") & (F.col("failures") >= least)
    if repeated is not None:
        met = met & (F.col("occurrences") < repeated)
    flagged = flagged.select("session_id", "event_id", "ts", "failures", met.alias("saturated"))
    before = F.sum(F.col("saturated").cast("int")).over(_order(calls).rowsBetween(Window.unboundedPreceding, 0))
    action = F.when(~F.col("saturated"), F.lit(None)).when(before == 1, "correct").otherwise("stall")
    return flagged.withColumn("action", action).drop("ts")


def running_budget(calls: DataFrame, limit: float, seconds: float | None = None) -> DataFrame:
    """Cumulative cost and duration within a session, whether either is above its limit, and whether it is so for the first time."""
    so_far = _order(calls).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.col(c).cast("decimal(20,6)")).over(so_far).cast("double")
    timed = calls if "seconds" in calls.columns else calls.withColumn("seconds", F.lit(0.0))
    out = timed.select("session_id", "event_id", "ts", total("cost").alias("spent"), total("seconds").alias("elapsed"))
    over = F.col("spent") > limit
    if seconds is not None:
        over = over | (F.col("elapsed") > seconds)
    out = out.withColumn("breached", over)
    first = F.col("breached") & (F.sum(F.col("breached").cast("int")).over(_order(calls).rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return out.withColumn("first_breach", first).drop("ts")


def event_counts(events: DataFrame, notable: tuple[str, ...] = ()) -> DataFrame:
    """Events ``node_id, kind`` by node and kind, and whether the kind is notable."""
    return events.groupBy("node_id", "kind").agg(F.count("*").alias("n")).withColumn("notable", F.col("kind").isin(*notable))


def seed_outcomes(trajectories: DataFrame) -> DataFrame:
    """One row for each run: attempted and completed nodes, those left to the fallback, calls, failures, rules, and failure types."""
    kinds = F.array_sort(F.collect_set(F.substring_index("failure", ":", 1)))
    return trajectories.groupBy("run_id").agg(
        F.count("*").alias("attempted"), F.count_if("completed").alias("committed"), F.count_if(~F.col("completed")).alias("fallback"),
        F.sum("tool_calls").alias("tool_calls"), F.sum("protocol_failures").alias("protocol_failures"), F.sum("n_rules").alias("n_rules"), kinds.alias("failures"),
    )


def schema_variants(trajectories: DataFrame, current: int) -> DataFrame:
    return trajectories.groupBy("schema_hash").agg(F.count("*").alias("records")).withColumn("is_current", F.col("schema_hash") == current)


def quality_gate(trajectories: DataFrame, most_rate: float = 0.25) -> DataFrame:
    """``conv_id, reasons, high_quality``: reasons against each trajectory; it passes if there are none."""
    rate = F.try_divide("protocol_failures", "tool_calls")
    reasons = {
        "incomplete": ~F.col("completed"),
        "no step": F.col("n_steps") == 0,
        "no-op rule": F.col("n_no_ops") > 0,
        "no inspection": F.col("n_inspections") == 0,
        "protocol failures": (F.col("protocol_failures") > 1) & (rate > most_rate),
        "fewer tests than rules": F.col("n_tests") < F.col("n_rules"),
        "no cascade preview": (F.col("n_rules") > 1) & (F.col("n_cascades") == 0),
    }
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in reasons.items()]))
    return trajectories.select("conv_id", found.alias("reasons")).withColumn("high_quality", F.size("reasons") == 0)


def confidence_spread(rules: DataFrame, least: float = 0.25) -> DataFrame:
    """Rules at two or more nodes whose confidence differs by ``least`` or more."""
    per = rules.groupBy("rule_id").agg(F.count_distinct("node_id").alias("n_nodes"), (F.max("confidence") - F.min("confidence")).alias("spread"))
    return per.where((F.col("n_nodes") >= 2) & (F.col("spread") >= least))


def contradictory_mappings(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """Rules of a parent and a child with one target and environment, and different replacements."""
    keys = ["target", "left", "right", "word_initial", "word_final"]
    up, down = rules.select(F.col("node_id").alias("parent_id"), *keys, F.col("replacement").alias("parent_to")), rules.select(F.col("node_id").alias("child_id"), *keys, F.col("replacement").alias("child_to"))
    return edges.select("parent_id", "child_id").join(up, "parent_id").join(down, ["child_id", *keys]).where(F.col("parent_to") != F.col("child_to")).select("parent_id", "child_id", "target", "parent_to", "child_to")


def trajectory_summary(trajectories: DataFrame) -> DataFrame:
    """One row: records, completed ones, calls, protocol failures, failures a call (null without calls), models and failure types."""
    calls, failures = F.sum("tool_calls"), F.sum("protocol_failures")
    return trajectories.agg(
        F.count("*").alias("records"), F.count_if("completed").alias("completed"), calls.alias("tool_calls"), failures.alias("protocol_failures"),
        F.round(F.try_divide(failures, calls), 9).alias("failure_rate"), F.array_sort(F.collect_set("model")).alias("models"),
        F.array_sort(F.collect_set(F.substring_index("failure", ":", 1))).alias("failure_types"),
    )


def failure_types(trajectories: DataFrame) -> DataFrame:
    """``failure_type, n``: the text before the first colon of each failure."""
    return trajectories.where("failure is not null").groupBy(F.substring_index("failure", ":", 1).alias("failure_type")).agg(F.count("*").alias("n"))


def aggregate_sweep(outcomes: DataFrame, evaluations: DataFrame, metrics: list[str], graded: list[str]) -> DataFrame:
    """``scope, node_id, metric`` and a distribution: run metrics over runs, evaluations over all and by node.

    Evaluations of fallback nodes (``fallback``) are excluded; their number is the metric ``fallbacks`` of scope excluded.
    """
    kept = evaluations.where(~F.col("fallback"))
    runs = distributions(outcomes, metrics, []).select(F.lit("run").alias("scope"), F.lit(None).cast("string").alias("node_id"), "*")
    whole = distributions(kept, graded, []).select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("node_id"), "*")
    by_node = distributions(kept, graded, ["node_id"]).select(F.lit("node").alias("scope"), "*")
    left = evaluations.agg(F.count_if("fallback").alias("n")).select(F.lit("excluded").alias("scope"), F.lit(None).cast("string").alias("node_id"), F.lit("fallbacks").alias("metric"), "n")
    return runs.unionByName(whole).unionByName(by_node).unionByName(left, allowMissingColumns=True)


def per_node_rows(trajectories: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Trajectories with the diagnostics of their run and node; null where there are none."""
    return trajectories.select("conv_id", "run_id", "node_id", "completed", "tool_calls", "protocol_failures").join(diagnostics, ["run_id", "node_id"], "left")


def gold_summary(evaluations: DataFrame, metrics: list[str]) -> DataFrame:
    """Distributions of metrics over evaluations that are no fallbacks: of all (``node_id`` null) and by node."""
    kept = evaluations.where(~F.col("fallback"))
    return distributions(kept, metrics, []).withColumn("node_id", F.lit(None).cast("string")).unionByName(distributions(kept, metrics, ["node_id"]))


def convergence_summary(diagnostics: DataFrame) -> DataFrame:
    """One row: means over the nodes that recorded a value, and how many did not."""
    rate, support = F.col("convergence_rate"), F.col("branch_support")
    return diagnostics.agg(
        F.count("*").alias("n_nodes"), F.avg(rate).alias("mean_rate"), F.count_if(rate.isNull()).alias("rate_unrecorded"),
        F.avg(support).alias("mean_support"), F.count_if(support.isNull()).alias("support_unrecorded"), F.sum("divergent").alias("n_divergent"),
    )


def unmentioned_correspondences(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """``node_id, target, replacement, established_at``: a change of a node below that no rule of the node has.

    ``paths`` is the closure of the tree; ``established_at`` are the nodes below, in order.
    """
    own = rules.select("node_id", "target", "replacement").distinct()
    above = paths.where("depth > 0").select(F.col("ancestor_id").alias("_up"), F.col("descendant_id").alias("node_id")).join(rules.select(F.col("node_id").alias("_up")).distinct(), "_up", "left_semi")
    asked = own.join(above, "node_id").select(F.col("_up").alias("node_id"), "target", "replacement", F.col("node_id").alias("_below"))
    return asked.join(own, ["node_id", "target", "replacement"], "left_anti").groupBy("node_id", "target", "replacement").agg(F.array_sort(F.collect_set("_below")).alias("established_at"))


def export_training_examples(trajectories: DataFrame, include_incomplete: bool = False, gate: bool = True, max_anomaly_rate: float | None = None) -> DataFrame:
    """Trajectories fit for training: complete, past the quality gate, of few anomalies. An unrecorded rate passes no limit."""
    kept = trajectories if include_incomplete else trajectories.where("completed")
    if max_anomaly_rate is not None:
        kept = kept.where(F.col("anomaly_rate") <= max_anomaly_rate)
    if gate:
        kept = kept.join(quality_gate(trajectories).where("high_quality").select("conv_id"), "conv_id", "left_semi")
    return kept


def named_values(calls: DataFrame) -> DataFrame:
    """``session_id, event_id, key, value``: strings and numbers anywhere in the calls' JSON ``arguments``, each under its nearest key.

    Values in lists stand under the list's key. Arguments are taken apart level by level, all calls at once, as variants;
    what is no JSON, and null, names nothing.
    """
    scratch = Scratch(calls.sparkSession)
    level = scratch.save(calls.select("session_id", "event_id", F.lit(None).cast("string").alias("_key"), F.col("arguments").alias("text")).distinct())
    leaves = []
    while True:
        parsed = level.select("session_id", "event_id", "_key", F.try_parse_json("text").alias("v")).where("v is not null")
        inner = parsed.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("v").outer()))
        found = inner.select("session_id", "event_id", F.coalesce("key", "_key").alias("_key"), F.to_json("value").alias("text")).distinct()
        found = scratch.save(found)
        nested = F.col("text").rlike(r"^[\[{]")
        value = F.try_variant_get(F.try_parse_json("text"), "$", "string")
        leaves.append(found.where(~nested).select("session_id", "event_id", F.col("_key").alias("key"), value.alias("value")).where("value is not null"))
        level = found.where(nested)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, leaves)


def inspected_concepts(
    calls: DataFrame, forms: DataFrame, concepts: DataFrame, whole: tuple[str, ...] = (),
    concept_keys: tuple[str, ...] = ("concept_id", "concept_ids"), form_keys: tuple[str, ...] = ("form_id", "form_ids", "supporting_form_ids"),
) -> DataFrame:
    """``session_id, concept_id``: concepts that a session's calls name in their JSON ``arguments``, however deep.

    Strings and numbers under ``concept_keys`` count if they are ids of concepts, those under ``form_keys`` if they are ids of
    forms, whose concept counts then; others are dropped. A call of a tool in ``whole`` that names none looks at all concepts.
    """
    scratch = Scratch(calls.sparkSession)
    # Equal arguments name the same concepts; each text is taken apart once.
    digest = F.sha2("arguments", 256)
    own_calls = calls.select("session_id", "event_id", "tool", digest.alias("_d"))
    texts = calls.select(digest.alias("_d"), "arguments").dropDuplicates(["_d"])
    named = named_values(texts.select(F.col("_d").alias("session_id"), F.lit(None).cast("long").alias("event_id"), "arguments")).select(F.col("session_id").alias("_d"), "key", "value")
    ids = concepts.select("concept_id").distinct()
    by_concept = named.where(F.col("key").isin(*concept_keys)).withColumnRenamed("value", "concept_id").join(ids, "concept_id")
    own = forms.select(F.col("form_id").cast("string").alias("value"), "concept_id").distinct()
    by_form = named.where(F.col("key").isin(*form_keys)).join(own, "value")
    found = scratch.save(by_concept.select("_d", "concept_id").unionByName(by_form.select("_d", "concept_id")).distinct())
    open_ = own_calls.where(F.col("tool").isin(*whole)).join(found, "_d", "left_anti").select("session_id").distinct()
    # The result of a call without names is every concept.
    everything = paired(open_, ids).select("session_id", "concept_id")
    told = own_calls.select("session_id", "_d").distinct().join(found, "_d").select("session_id", "concept_id")
    return told.unionByName(everything).distinct()


def directionality_evidence(calls: DataFrame, claims: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """``session_id, calls, outgroup_calls, claims``: evidence calls, those that returned an out-group, and claims of a direction.

    ``calls`` hold ``session_id, tool, result`` (JSON), ``claims`` a row each; sessions with any are listed.
    """
    asked = calls.where(F.col("tool").isin(*tools))
    outside = F.get_json_object("result", "$.relation") == "outgroup"
    per = asked.groupBy("session_id").agg(F.count("*").alias("calls"), F.count_if(F.coalesce(outside, F.lit(False))).alias("outgroup_calls"))
    claimed = claims.groupBy("session_id").agg(F.count("*").alias("claims"))
    both = per.join(claimed, "session_id", "full")
    return both.select("session_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "outgroup_calls", "claims")])


def classify_errors(errors: DataFrame, codes: DataFrame) -> DataFrame:
    """``error_id, code, category`` of ``errors(error_id, kind, places)``.

    The code is the kind and, where the error has places in the arguments, these in order with array indexes
    collapsed, so that one mistake has one code. ``codes(code, category)`` is short; a code it lacks is a
    matter of protocol.
    """
    collapsed = F.array_sort(F.array_distinct(F.transform("places", lambda p: F.regexp_replace(p, r"\.?\d+", "[]"))))
    code = F.when(F.size("places") > 0, F.concat("kind", F.lit(":"), F.array_join(collapsed, ","))).otherwise(F.col("kind"))
    return errors.select("error_id", code.alias("code")).join(codes, "code", "left").select("error_id", "code", F.coalesce("category", F.lit("protocol")).alias("category"))


def superseded_calls(calls: DataFrame, selections: list[str], tools: tuple[str, ...]) -> DataFrame:
    """``session_id, event_id, superseded_by``: calls of ``tools`` that a later one of the session includes, with the first such.

    Each selection (an array; null and empty are everything) must be part of the later call's, and ``other``
    equal. A later call that restricts some selections must hold all that the earlier one names there, its rarest name
    among them, so calls meet only over that name; later calls that restrict nothing come from one window.
    """
    who = ["session_id", "tool", "other"]
    own = calls.where(F.col("tool").isin(*tools)).select(
        *who, F.struct("ts", "event_id").alias("at"), *[F.when(F.size(s) > 0, F.array_distinct(s)).alias(s) for s in selections]
    )
    bits = sum(F.when(F.col(s).isNotNull(), 1 << i).otherwise(0) for i, s in enumerate(selections))
    own = own.withColumn("limits", bits)
    # Names in each selection, with the call's own limits.
    named = [own.select(*who, "at", "limits", F.lit(i).alias("i"), F.explode(F.col(s).cast("array<string>")).alias("name")) for i, s in enumerate(selections)]
    names = named[0]
    for more in named[1:]:
        names = names.unionByName(more)
    key = [*who, "limits", "i", "name"]
    frequent = names.groupBy(*key).agg(F.count("*").alias("n"))
    # An earlier call asks for each way in which a later one may be limited: the selections of both, at least one.
    ways = F.explode(F.filter(F.sequence(F.lit(1), F.lit((1 << len(selections)) - 1)), lambda w: w.bitwiseAND(F.col("limits")) == w)).alias("way")
    asked = names.select(*who, "at", "i", "name", ways).where(F.expr("shiftright(way, i)").bitwiseAND(1) == 1).withColumnRenamed("way", "limits")
    same = lambda a, b, cols: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
    sized = asked.alias("a").join(frequent.alias("f"), same("a", "f", key), "left").select("a.*", F.coalesce("f.n", F.lit(0)).alias("n"))
    rarest = sized.groupBy(*who, "at", "limits").agg(F.min(F.struct("n", "i", "name")).alias("r")).where("r.n > 0").select(*who, "at", "limits", "r.i", "r.name")
    later = names.select(*key, F.col("at").alias("later_at"))
    met = rarest.alias("a").join(later.alias("b"), same("a", "b", key) & (F.col("a.at") < F.col("b.later_at"))).select(*[f"a.{c}" for c in who], "a.at", "a.limits", "b.later_at")
    earlier = own.alias("o").join(met.alias("m"), same("o", "m", [*who, "at"])).select("m.*", *[F.col(f"o.{s}").alias(f"_{s}") for s in selections])
    both = earlier.alias("e").join(own.drop("limits").withColumnRenamed("at", "later_at").alias("l"), same("e", "l", [*who, "later_at"]))
    holds = reduce(lambda x, y: x & y, [F.col(f"l.{s}").isNull() | (F.size(F.array_except(f"e._{s}", f"l.{s}")) == 0) for s in selections])
    limited = both.where(holds).select(*[f"e.{c}" for c in who], "e.at", "e.later_at")
    after = Window.partitionBy(*who).orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    free = own.select(*who, "at", F.first(F.when(F.col("limits") == 0, F.col("at")), ignorenulls=True).over(after).alias("later_at")).where("later_at is not null")
    first = limited.unionByName(free).groupBy(*who, "at").agg(F.min("later_at").alias("later_at"))
    return first.select("session_id", "at.event_id", F.col("later_at.event_id").alias("superseded_by"))


def committed_rule_rows(rules: DataFrame) -> DataFrame:
    """``node_id, rule_ordinal, rule_id, correspondence, environment``: compiled rules written out, a deletion as ``Ø``."""
    text = lambda c: F.array_join(c, " ")
    to = F.when(F.size("replacement") == 0, "Ø").otherwise(text("replacement"))
    sides = [F.when(F.col("word_initial"), "#"), F.nullif(text("left"), F.lit("")), F.lit("_"), F.nullif(text("right"), F.lit("")), F.when(F.col("word_final"), "#")]
    return rules.where("error is null").select("node_id", "rule_ordinal", "rule_id", F.concat(text("target"), F.lit(" > "), to).alias("correspondence"), F.concat_ws(" ", *sides).alias("environment"))


def node_report(
    nodes: DataFrame, results: DataFrame, steps: DataFrame, rules: DataFrame, diagnostics: DataFrame, evaluations: DataFrame, evidence: DataFrame | None = None
) -> DataFrame:
    """One row for each node: its rules, its best forms, diagnostics, gold and evidence.

    ``results`` and ``steps`` hold ``node_id, concept_id, segments``: a node's best forms are those of the result, or those of
    its step where the result has none; they come as ``concept: segments``, in the order of concepts. ``rules`` are rows of
    :func:`committed_rule_rows`; the other tables have one row a node.
    """
    written = rules.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_ordinal", "correspondence"))), lambda r: r["correspondence"]).alias("rules"))
    told = F.concat("concept_id", F.lit(": "), F.array_join("segments", " "))
    # A node has a form for each concept.
    forms = lambda df, name: df.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("concept_id", told.alias("t")))), lambda x: x["t"]).alias(name))
    tables = [forms(results, "_result"), forms(steps, "_step"), written, diagnostics, evaluations] + ([evidence] if evidence is not None else [])
    joined = reduce(lambda a, b: a.join(b, "node_id", "left"), tables, nodes.select("node_id"))
    others = [c for df in tables[3:] for c in df.columns if c != "node_id"]
    none = F.array().cast("array<string>")
    return joined.select("node_id", F.coalesce("rules", none).alias("rules"), F.coalesce("_result", "_step", none).alias("best_forms"), *others)
