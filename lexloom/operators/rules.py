"""Ordered sound-change rules over token arrays, as regular expressions over encoded forms.

A form is encoded as one string in which each token, and the start, is followed by a separator. A rule becomes
a pattern of literal tokens with its context in look-arounds, so one built-in replacement finds the leftmost
matches that do not overlap, judges contexts on the input, and rewrites. Tokens hold neither U+001E nor U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EMPTY = ("", "Ø", "∅")
SEPARATOR, MARK = "\x1f", "\x1e"
#: Rules that are tried on every form, at most; they are written by hand.
MOST_RULES = 1000
PARTS = ("target", "replacement", "left", "right", "word_initial", "word_final")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _split(text: Column) -> Column:
    return F.when(text.isin(*EMPTY), F.array().cast("array<string>")).otherwise(F.split(text, r"(?U)\s+"))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Parse ``dsl`` into ``target, replacement, left, right`` (token arrays), edge flags, ``rule_id`` and ``error``.

    ``target > replacement / left _ right``. A ``#`` that begins the left or ends the right side binds to the
    word's edge; an empty replacement, ``Ø`` or ``∅`` deletes. ``error`` is null for a valid rule, else the
    first mistake: arrow (not one ``>``), slash (more than one), focus (not one ``_``), edge (``#`` inside a
    side), context (a side that is ``Ø``), target (none), marker (``#`` or ``_`` in a changed part), no-op. A
    null rule has no arrow. With a column ``source_child_ids`` the id depends on it too.
    """
    dsl = _stripped(F.coalesce("dsl", F.lit("")))
    slash = F.locate("/", dsl)
    out = rules.withColumns({
        "_dsl": dsl,
        "_change": F.when(slash > 0, F.substring(dsl, F.lit(1), slash - 1)).otherwise(dsl),
        "_context": F.when(slash > 0, F.substring(dsl, slash + 1, F.length(dsl))),
    })
    out = out.withColumns({
        "_target": _stripped(F.split_part("_change", F.lit(">"), F.lit(1))),
        "_to": _stripped(F.split_part("_change", F.lit(">"), F.lit(2))),
        "_before": _stripped(F.split_part(F.coalesce("_context", F.lit("")), F.lit("_"), F.lit(1))),
        "_after": _stripped(F.split_part(F.coalesce("_context", F.lit("")), F.lit("_"), F.lit(2))),
    })
    out = out.withColumns({"word_initial": F.col("_before").startswith("#"), "word_final": F.col("_after").endswith("#")})
    out = out.withColumns({
        "_before": _stripped(F.when(F.col("word_initial"), F.substring("_before", F.lit(2), F.length("_before"))).otherwise(F.col("_before"))),
        "_after": _stripped(F.when(F.col("word_final"), F.substring("_after", F.lit(1), F.length("_after") - 1)).otherwise(F.col("_after"))),
    })
    out = out.withColumns({"target": _split(F.col("_target")), "replacement": _split(F.col("_to")), "left": _split(F.col("_before")), "right": _split(F.col("_after"))})
    given = F.col("_context").isNotNull()
    error = (
        F.when(_count(F.col("_dsl"), ">") != 1, "arrow")
        .when(given & F.col("_context").contains("/"), "slash")
        .when(given & (_count(F.col("_context"), "_") != 1), "focus")
        .when(F.concat("_before", "_after").contains("#"), "edge")
        .when(F.col("_before").isin(*EMPTY[1:]) | F.col("_after").isin(*EMPTY[1:]), "context")
        .when(F.size("target") == 0, "target")
        .when(F.concat("_target", "_to").rlike("[#_]"), "marker")
        .when(F.col("target") == F.col("replacement"), "no-op")
    )
    named = F.col("_dsl")
    if "source_child_ids" in rules.columns:
        named = F.when(F.col("source_child_ids").isNull(), named).otherwise(F.concat_ws("\0", "_dsl", "source_child_ids"))
    out = out.withColumns({"rule_id": F.concat(F.lit("rule-"), F.substring(F.sha2(named, 256), 1, 12)), "error": error})
    return out.drop("_dsl", "_change", "_context", "_target", "_to", "_before", "_after")


def complexity() -> Column:
    """1, the lengths of all parts, and the edges."""
    return F.lit(1) + F.size("target") + F.size("replacement") + F.size("left") + F.size("right") + F.col("word_initial").cast("int") + F.col("word_final").cast("int")


def encode(segments: Column) -> Column:
    return F.concat(F.lit(SEPARATOR), F.array_join(F.transform(segments, lambda t: F.concat(t, F.lit(SEPARATOR))), ""))


def decode(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATOR), lambda t: t != "")


def _literal(tokens: Column) -> Column:
    """Tokens as a pattern that matches them and their separators."""
    joined = F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit(SEPARATOR))), "")
    return F.concat(F.lit("\\Q"), F.replace(joined, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def patterns(rule: Column | None = None) -> Column:
    """``struct(find, at, any, to)`` of a compiled rule: what is replaced, where it matches, where its target is, and by what."""
    part = (lambda c: F.col(c)) if rule is None else (lambda c: rule[c])
    target = _literal(part("target"))
    before = F.concat(
        F.when(part("word_initial"), f"(?<=\\A{SEPARATOR})").otherwise(""),
        F.when(F.size(part("left")) > 0, F.concat(F.lit(f"(?<={SEPARATOR}"), _literal(part("left")), F.lit(")"))).otherwise(f"(?<={SEPARATOR})"),
    )
    after = F.concat(F.when(F.size(part("right")) > 0, F.concat(F.lit("(?="), _literal(part("right")), F.lit(")"))).otherwise(""), F.when(part("word_final"), "(?=\\z)").otherwise(""))
    written = F.array_join(F.transform(part("replacement"), lambda t: F.concat(t, F.lit(SEPARATOR))), "")
    return F.struct(
        F.concat(before, target, after).alias("find"),
        F.concat(before, F.lit("(?="), target, after, F.lit(")")).alias("at"),
        F.concat(F.lit(f"(?<={SEPARATOR})(?="), target, F.lit(")")).alias("any"),
        F.replace(F.replace(written, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")).alias("to"),
    )


def _places(text: Column, pattern: Column) -> Column:
    """Numbers, from 0, of the tokens at which a pattern of no width matches."""
    marked = F.split(F.substring(F.regexp_replace(text, pattern, F.lit(MARK)), F.lit(2), F.length(text) * 2), SEPARATOR)
    return F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: F.get(marked, i).startswith(MARK))


def _every_rule(rules: DataFrame) -> Column:
    """Valid rules as one array; they are few, which is checked."""
    found = rules.where("error is null").select("rule_id", *PARTS, patterns().alias("p")).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules to try on every form")
    tokens = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    each = [F.struct(F.lit(r.rule_id).alias("rule_id"), tokens(r.target).alias("target"), tokens(r.replacement).alias("replacement"), *[F.lit(r.p[k]).alias(k) for k in ("find", "at", "any", "to")]) for r in found]
    return F.array(*each)


def apply_rule(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """Each form under each valid rule: ``rule_id, output, spans, n_matches, target_occurrences, status, emptied``.

    ``status``: applied, context (the target occurs, but never in its context) or absent. ``spans`` are the
    starts of all matches in the input; of overlapping ones the leftmost are replaced. ``emptied`` tells
    whether nothing is left.
    """
    each = forms.withColumn("_form", encode(F.col("segments"))).select("*", F.explode(_every_rule(rules)).alias("_p"))
    found = each.withColumns({
        "rule_id": F.col("_p.rule_id"),
        "output": decode(F.regexp_replace("_form", F.col("_p.find"), F.col("_p.to"))),
        "n_matches": F.regexp_count("_form", F.col("_p.at")),
        "target_occurrences": F.regexp_count("_form", F.col("_p.any")),
    })
    spans = F.when(F.col("n_matches") > 0, _places(F.col("_form"), F.col("_p.at"))).otherwise(F.array().cast("array<int>"))
    status = F.when(F.col("n_matches") > 0, "applied").when(F.col("target_occurrences") > 0, "context").otherwise("absent")
    return found.select(*forms.columns, "rule_id", "output", spans.alias("spans"), "n_matches", "target_occurrences", status.alias("status"), (F.size("output") == 0).alias("emptied"))


def apply_cascade(forms: DataFrame, rules: DataFrame, node: str = "node_id", child: str | None = None) -> DataFrame:
    """Ordered rules of each form's ``node``; each sees the output of the one before.

    With ``child``, a rule whose ``source_child_ids`` lacks the form's child is passed over. Adds ``output``
    and ``trace`` (an array of ``rule_id, input, output, n_matches, n_targets, confidence``). A node without
    rules returns its forms unchanged, with an empty trace.
    """
    scope = F.col("source_child_ids") if "source_child_ids" in rules.columns else F.lit(None).cast("array<string>")
    confidence = F.col("confidence") if "confidence" in rules.columns else F.lit(1.0)
    rule = F.struct("rule_ordinal", "rule_id", patterns().alias("p"), scope.alias("scope"), confidence.cast("double").alias("confidence"))
    cascades = rules.where("error is null").groupBy(F.col("node_id").alias(node)).agg(F.array_sort(F.collect_list(rule)).alias("_cascade"))
    step = "struct<rule_id:string,input:string,output:string,n_matches:int,n_targets:int,confidence:double>"
    start = F.struct(F.col("_form").alias("now"), F.array().cast(f"array<{step}>").alias("trace"))

    def merge(state: Column, r: Column) -> Column:
        out = F.regexp_replace(state["now"], r["p"]["find"], r["p"]["to"])
        row = F.struct(r["rule_id"].alias("rule_id"), state["now"].alias("input"), out.alias("output"), F.regexp_count(state["now"], r["p"]["at"]).alias("n_matches"), F.regexp_count(state["now"], r["p"]["any"]).alias("n_targets"), r["confidence"].alias("confidence"))
        return F.struct(out.alias("now"), F.concat(state["trace"], F.array(row)).alias("trace"))

    own = F.col("_cascade")
    if child:
        own = F.filter(own, lambda r: r["scope"].isNull() | F.array_contains(r["scope"], F.col(child)))
    joined = forms.join(cascades, node, "left").withColumn("_form", encode(F.col("segments")))
    done = joined.withColumn("_d", F.when(F.col("_cascade").isNull(), start).otherwise(F.aggregate(own, start, merge)))
    trace = F.transform("_d.trace", lambda t: F.struct(t["rule_id"].alias("rule_id"), decode(t["input"]).alias("input"), decode(t["output"]).alias("output"), t["n_matches"].alias("n_matches"), t["n_targets"].alias("n_targets"), t["confidence"].alias("confidence")))
    return done.select(*forms.columns, decode(F.col("_d.now")).alias("output"), trace.alias("trace"))


def anchor_match(results: DataFrame, anchors: DataFrame) -> DataFrame:
    """Results with ``anchor_ids, matched_anchor_ids`` and a status that may be ``anchor``.

    ``anchors(concept_id, form_id, segments)`` are expected of the forms of their concept. One matches if the
    rule fired and its output is the anchor's form; a rule that fired and matches none has status ``anchor``.
    """
    per = anchors.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct(F.col("form_id").alias("id"), "segments"))).alias("_anchors"))
    joined = results.join(per, "concept_id", "left").withColumn("_anchors", F.coalesce("_anchors", F.slice("_anchors", 1, 0), F.array().cast("array<struct<id:bigint,segments:array<string>>>")))
    ids = lambda a: F.transform(a, lambda x: x["id"])
    matched = F.when(F.col("n_matches") > 0, ids(F.filter("_anchors", lambda a: a["segments"] == F.col("output")))).otherwise(F.slice(ids(F.col("_anchors")), 1, 0))
    out = joined.withColumns({"anchor_ids": ids(F.col("_anchors")), "matched_anchor_ids": matched})
    missed = (F.col("status") == "applied") & (F.size("anchor_ids") > 0) & (F.size("matched_anchor_ids") == 0)
    return out.withColumn("status", F.when(missed, "anchor").otherwise(F.col("status"))).drop("_anchors")


def rule_report(results: DataFrame) -> DataFrame:
    """Per rule: results by status, matches, words applied, anchors matched, and exceptions (all that is not applied)."""
    anchored = F.size("matched_anchor_ids") if "matched_anchor_ids" in results.columns else F.lit(0)
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("applied", "context", "absent", "anchor")]
    return results.groupBy("rule_id").agg(*counts, F.sum("n_matches").alias("n_matches"), F.count_if(F.col("n_matches") > 0).alias("words_applied"), F.sum(anchored.cast("long")).alias("anchors_matched"), F.count_if(F.col("status") != "applied").alias("exceptions"))


def scope_rules(rules: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node_id, child_id`` and the rule's columns for each child a rule applies to, and ``node_id, rule_id, child_id`` of unknown children.

    A rule without ``source_child_ids`` applies to all children of its node, at confidence 1.
    """
    children = edges.select(F.col("parent_id").alias("node_id"), "child_id")
    named = rules.where("source_child_ids is not null").select("*", F.explode("source_child_ids").alias("child_id"))
    every = rules.where("source_child_ids is null").withColumn("confidence", F.lit(1.0)).join(children, "node_id").select(*rules.columns, "child_id")
    known = named.join(children, ["node_id", "child_id"], "left_semi").select(*rules.columns, "child_id")
    return known.unionByName(every), named.join(children, ["node_id", "child_id"], "left_anti").select("node_id", "rule_id", "child_id")


def contrast_reductions(cascaded: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rule_id, deletes, merges`` of the rules that remove a distinction from the forms they get.

    ``cascaded`` holds ``keys, trace``. The image of a match is the replacement; a token outside all matches
    is its own. Two different sources of one image that is not empty are a merger; an empty replacement is a
    deletion. Only rules that fired count.
    """
    parts = rules.where("error is null").groupBy("rule_id").agg(F.first("target").alias("target"), F.first("replacement").alias("replacement"), F.first(patterns()).alias("p"))
    steps = cascaded.select(*keys, F.explode("trace").alias("t")).select(*keys, F.col("t.rule_id").alias("rule_id"), F.col("t.input").alias("input"), F.col("t.n_matches").alias("n"))
    steps = steps.groupBy(*keys, "rule_id", "input", "n").count().join(parts, "rule_id")  # equal inputs give equal images
    spans = _places(encode(F.col("input")), F.col("p.at"))
    steps = steps.withColumn("_spans", F.when(F.col("n") > 0, spans).otherwise(F.array().cast("array<int>")))
    covered = lambda i: F.exists("_spans", lambda s: (i >= s) & (i < s + F.size("target")))
    every = F.when(F.size("input") > 0, F.sequence(F.lit(0), F.size("input") - 1)).otherwise(F.array().cast("array<int>"))
    outside = F.transform(F.filter(every, lambda i: ~covered(i)), lambda i: F.array(F.get("input", i)))
    own = F.transform(F.array_distinct(outside), lambda t: F.struct(t.alias("source"), t.alias("image")))
    fired = F.when(F.col("n") > 0, F.array(F.struct(F.col("target").alias("source"), F.col("replacement").alias("image"))))
    images = steps.select(*keys, "rule_id", "replacement", (F.col("n") > 0).alias("fired"), F.explode(F.concat(own, F.coalesce(fired, F.slice(own, 1, 0)))).alias("m"))
    per = images.groupBy(*keys, "rule_id", F.col("m.image").alias("image")).agg(F.count_distinct("m.source").alias("n"), F.max("fired").alias("fired"), F.max(F.size("replacement")).alias("length"))
    whole = per.groupBy(*keys, "rule_id").agg(F.bool_or("fired").alias("fired"), F.bool_or((F.size("image") > 0) & (F.col("n") > 1)).alias("merges"), (F.max("length") == 0).alias("deletes"))
    return whole.where(F.col("fired") & (F.col("merges") | F.col("deletes"))).select(*keys, "rule_id", "deletes", "merges")


def attesting_nodes(reductions: DataFrame, rules: DataFrame, evidence: DataFrame, most: int = 10) -> DataFrame:
    """``node_id, rule_id, n_nodes, n_observed, nodes``: who still shows what a rule discards.

    ``evidence(parent_id, node_id, kind, segments)``: forms of the nodes visible at ``parent_id``. A node
    attests a rule if one of its forms holds the rule's target; ``nodes`` are the first ``most`` by id.
    """
    asked = reductions.select("node_id", "rule_id").distinct().join(rules.groupBy("rule_id").agg(F.first(patterns()["any"]).alias("any")), "rule_id")
    seen = evidence.groupBy("parent_id", "node_id", "kind", "segments").count()
    found = seen.withColumnRenamed("node_id", "witness").join(asked.withColumnRenamed("node_id", "parent_id"), "parent_id").where(F.regexp_count(encode(F.col("segments")), F.col("any")) > 0)
    witnesses = found.select("parent_id", "rule_id", "witness", "kind").distinct()
    per = witnesses.groupBy("parent_id", "rule_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "observed").alias("n_observed"), F.array_sort(F.collect_set("witness")).alias("nodes"))
    return per.select(F.col("parent_id").alias("node_id"), "rule_id", "n_nodes", "n_observed", F.slice("nodes", 1, most).alias("nodes"))


def convergence(outputs: DataFrame) -> DataFrame:
    """Per parent and concept: distinct outputs over the children; a concept with one child converges."""
    per = outputs.groupBy("parent_id", "concept_id").agg(F.count_distinct("output").alias("n_outputs"), F.count_distinct("child_id").alias("n_children"))
    return per.withColumn("converges", (F.col("n_children") == 1) | (F.col("n_outputs") == 1))


def convergence_rate(per_concept: DataFrame, most: int = 20) -> DataFrame:
    """Per parent: concepts, converging and divergent ones, and the first ``most`` divergent ids."""
    divergent = F.array_sort(F.collect_list(F.when(~F.col("converges"), F.col("concept_id"))))
    return per_concept.groupBy("parent_id").agg(F.count("*").alias("n_concepts"), F.count_if("converges").alias("n_converging"), F.count_if(~F.col("converges")).alias("n_divergent"), F.slice(divergent, 1, most).alias("divergent_ids"))


def match_validations(commits: DataFrame, validations: DataFrame) -> DataFrame:
    """Each committed rule with the test that backs it: ``node_id, rule_id, call_id, kind, ambiguous``.

    Both tables hold the parts of a rule, its ``scope`` (child ids) and ``overlay``; tests also ``call_id, seq,
    kind, verdict``. They match by structure, scope as a set, and overlay. A cascade beats a single test, then
    the latest wins; matches of the winning kind that disagree in ``verdict`` are ambiguous.
    """
    key = F.xxhash64(*PARTS, F.array_sort("scope"), F.coalesce("overlay", F.lit("")))
    tests = validations.select("node_id", key.alias("_key"), "call_id", "seq", "kind", "verdict")
    order = F.struct((F.col("kind") == "cascade").alias("c"), "seq", "call_id", "kind")
    best = tests.groupBy("node_id", "_key").agg(
        F.max(order).alias("_best"),
        F.count_distinct(F.when(F.col("kind") == "cascade", F.col("verdict"))).alias("_c"),
        F.count_distinct(F.when(F.col("kind") != "cascade", F.col("verdict"))).alias("_s"),
    )
    joined = commits.withColumn("_key", key).join(best, ["node_id", "_key"], "left")
    ambiguous = F.coalesce(F.when(F.col("_best.c"), F.col("_c") > 1).otherwise(F.col("_s") > 1), F.lit(False))
    return joined.select("node_id", "rule_id", F.col("_best.call_id").alias("call_id"), F.col("_best.kind").alias("kind"), ambiguous.alias("ambiguous"))


def invert(rules: DataFrame) -> DataFrame:
    """Rules of each node in reverse order with target and replacement swapped; deletions cannot be inverted and become errors."""
    swapped = rules.withColumns({"_t": F.col("target"), "target": F.col("replacement"), "rule_ordinal": -F.col("rule_ordinal")})
    back = swapped.withColumn("replacement", F.col("_t")).drop("_t")
    return back.withColumn("error", F.when(F.size("target") == 0, F.coalesce("error", F.lit("not invertible"))).otherwise(F.col("error")))
