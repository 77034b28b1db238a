"""Queries of readers, checks, selections and trees over the wordlist views, and their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom import queries as base
from lexloom.operators import alignment, beam, checks, selection, tree
from lexloom.plans.scratch import Scratch
from lexloom.sources import views, wordlists
from lexloom.sources.tables import table
from lexloom.streaming import events as events_stream

GOLD, ANCHOR = "Brand#25", "Brand#24"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Readers: the views write the files, in the shared folder, and the readers read them back.

def _datasets(spark: SparkSession, sf_dir: str) -> str:
    """Write the CSV tables of both datasets; returns the folder that holds a folder for each dataset.

    The datasets differ in layout: columns of one are in reverse order and among others, one of which holds commas, quotes
    and line breaks; the other lacks columns that it does not use. A table of a dataset is one file, ordered by id.
    """
    root = Scratch(spark).root
    raw = F.concat(F.lit('a "raw", '), F.col("ID"), F.lit("\nform"))
    for name, df in views.cldf(spark, sf_dir).items():
        df = df.withColumns({"Alignment": F.when(F.col("ID").endswith("2c"), F.lit(" a  - b")), "Form": raw} if name == "cognates" else {"Form": raw})
        wide = df.where("dataset = 'alpha'").select(*reversed([c for c in df.columns if c != "dataset"]), F.lit("x").alias("Other"))
        narrow = df.where("dataset = 'beta'").drop("dataset", "Form", "Phonemic_Segments", "Concepticon_Gloss")
        narrow = narrow.withColumnRenamed("Family", "family")
        for dataset, rows in (("alpha", wide), ("beta", narrow)):
            place = f"{root}/{dataset}/cldf" if dataset == "beta" else f"{root}/{dataset}"
            rows.coalesce(1).sortWithinPartitions("ID").write.options(header=True, escape='"').csv(f"{place}/{name}.csv")
    return root


def _overrides(spark: SparkSession) -> DataFrame:
    rows = [("alpha", "1", None, "code1", "r1"), ("beta", None, "Brand#2", "code2", "r2"), ("alpha", "3", None, "code3", "r3"), ("alpha", None, "Brand#3", "code3b", "r4"), ("gamma", "4", None, "code4", "r5")]
    return spark.createDataFrame(rows, "dataset_id string, source_language_id string, name string, tree_glottocode string, rule_id string")


def _wordlist(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return wordlists.read_wordlist(spark, _datasets(spark, sf_dir), _overrides(spark))


def read_wordlist_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wordlist(spark, sf_dir)["forms"].drop("source_file")


def read_wordlist_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wordlist(spark, sf_dir)["memberships"].drop("sources", "doubt", "comment", "source_file")


def read_wordlist_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _wordlist(spark, sf_dir)["rejects"].drop("slices")
    return found.withColumn("source_file", F.regexp_extract("source_file", r"^(.*\.csv)/", 1))


def read_wordlist_varieties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wordlist(spark, sf_dir)["varieties"]


def read_wordlist_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wordlist(spark, sf_dir)["concepts"]


def tokenized_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlists.tokenize_segments(views.cldf(spark, sf_dir)["forms"]).select("ID", "segments", "segment_source")


def collected_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {k: v.withColumnRenamed("dataset", "dataset_id") for k, v in views.cldf(spark, sf_dir).items()}
    found = wordlists.collect_memberships(tables["forms"], tables["cognates"])
    return found.select("dataset_id", "form_id", "membership_id", "cognate_set_id", "slices", "source_table")


def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wordlist as nested JSON, one line for each group of varieties, written and read back."""
    form = F.struct(F.col("form_id").cast("string").alias("form_id"), "concept_id", "segments", "cognate_set_id")
    lexicons = views.forms(spark, sf_dir).groupBy("variety_id").agg(F.collect_list(form).alias("forms"))
    rows = lexicons.select(F.struct("variety_id", F.col("variety_id").alias("name"), "forms").alias("l"))
    none = F.array().cast("array<struct<concept_id:string,gloss:string>>")
    payload = rows.groupBy(F.col("l.variety_id")).agg(F.collect_list("l").alias("lexicons")).select("variety_id", "lexicons", none.alias("concepts"))
    root = Scratch(spark).root
    # One document a file: each variety has a folder of its own.
    payload.repartition("variety_id").write.partitionBy("variety_id").json(f"{root}/payload")
    return wordlists.read_payload(spark, f"{root}/payload/*/*.json")["forms"]


def lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage rows: each brand descends from the gold one through a branch of its group; some lack a branch."""
    brands = views.edges(spark, sf_dir).where("parent_id <> 'root'")
    branch = F.when(F.col("child_ordinal") % 7 != 0, F.col("parent_id"))
    rows = brands.select(F.when(F.col("child_ordinal") % 5 == 0, "beta").otherwise("alpha").alias("dataset"), F.lit(GOLD).alias("target_variety_id"), branch.alias("branch_id"), F.col("child_id").alias("descendant_variety_id"), F.lit("view").alias("evidence"))
    path = f"{Scratch(spark).root}/lineages"
    rows.write.option("header", True).csv(path)
    return wordlists.read_lineages(spark, path, "alpha", "target")


def anchor_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of one brand as the anchors of its group, written as a map from nodes and read back."""
    form = F.struct(F.col("form_id").cast("string").alias("form_id"), "concept_id", "segments", F.lit("view").alias("provenance"))
    rows = views.forms(spark, sf_dir).where(F.col("variety_id") == ANCHOR).groupBy(F.lit("g5").alias("node")).agg(F.collect_list(form).alias("forms"))
    path = f"{Scratch(spark).root}/anchors"
    rows.select(F.lit("1.0").alias("schema_version"), F.map_from_arrays(F.array("node"), F.array("forms")).alias("anchors")).write.json(path)
    return wordlists.read_anchors(spark, path)


def _event_files(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines in five files, in order, some lines cut short and some no objects; returns their folder."""
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))).alias("line"), "event_id")
    line = F.when(F.col("event_id") % 50 == 0, F.expr("substring(line, 1, length(line) - 3)")).when(F.col("event_id") % 77 == 0, "[1]").otherwise(F.col("line"))
    rows = rows.select(line.alias("value"), (F.col("event_id") % 5).alias("part"), "event_id")
    path = f"{Scratch(spark).root}/events"
    rows.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    return path


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of the event lines, by kind, and the number of bad lines."""
    events, bad = wordlists.read_events(spark, _event_files(spark, sf_dir), "event_id long, kind string")
    return events.groupBy("kind").agg(F.count("*").alias("n")).unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n")))


def bad_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bad lines by file and line."""
    bad = wordlists.read_events(spark, _event_files(spark, sf_dir), "event_id long, kind string")[1]
    return bad.select(F.regexp_extract("source_file", r"part=(\d+)", 1).cast("long").alias("part"), "source_row", "value")


def streamed_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event lines as a stream of one file a micro-batch, good and bad ones; counts by kind, null for bad lines."""
    good, bad = events_stream.stream_json_lines(spark, _event_files(spark, sf_dir), "event_id long, kind string", Scratch(spark).root, files_a_batch=1)
    return good.groupBy("kind").agg(F.count("*").alias("n")).unionByName(bad.agg(F.lit(None).cast("string").alias("kind"), F.count("*").alias("n")))


def run_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the runs in folders of their own, of which some left no result."""
    root, rows = Scratch(spark).root, views.trajectories(spark, sf_dir)
    runs = [r.run_id for r in rows.select("run_id").distinct().collect()]  # seven, by the view
    for run in runs:
        own = rows.where(F.col("run_id") == run)
        own.select("conv_id", "node_id", "completed").write.json(f"{root}/run-{run}/trajectories.jsonl")
        if run % 3:
            own.agg(F.count("*").alias("n_nodes")).write.json(f"{root}/run-{run}/result.json")
    found = wordlists.read_runs(spark, root, "conv_id long, node_id string, completed boolean", "n_nodes long")
    return found.select("run", "conv_id", "node_id", "completed", F.col("result.n_nodes").alias("n_nodes"))


def trajectory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as JSON lines, written and read strictly."""
    root = Scratch(spark).root
    wordlists.write_tables({"trajectories": views.trajectories(spark, sf_dir).select("conv_id", "run_id", "node_id", "completed", "tool_calls")}, root)
    return wordlists.read_trajectories(spark, f"{root}/trajectories", "conv_id long, run_id long, node_id string, completed boolean, tool_calls long")


# Judgements of the views: every form has its set; of 'alpha' wordlists the CSV tables have more.

def _memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole-form judgement for each form, and for every third a slice of its first morpheme."""
    forms = views.forms(spark, sf_dir)
    none = F.array().cast("array<int>")
    whole = forms.select("form_id", F.concat(F.lit("m"), F.col("form_id").cast("string")).alias("membership_id"), "cognate_set_id", F.lit("whole_form").alias("scope"), F.lit("asserted").alias("interpretation"), none.alias("segment_indices"))
    first = F.sequence(F.lit(0), F.array_position("segments", "+").cast("int") - 2)
    part = forms.where("form_id % 3 = 0").select("form_id", F.concat(F.lit("s"), F.col("form_id").cast("string")).alias("membership_id"), F.concat("cognate_set_id", F.lit("s")).alias("cognate_set_id"), F.lit("segment_slice").alias("scope"), F.lit("partial_cognate").alias("interpretation"), first.alias("segment_indices"))
    return whole.unionByName(part)


MEMBERS = """v_members AS (SELECT form_id, 'm' || form_id AS membership_id, cognate_set_id, 'whole_form' AS scope, 'asserted' AS interpretation, []::INTEGER[] AS segment_indices FROM v_forms
  UNION ALL SELECT form_id, 's' || form_id, cognate_set_id || 's', 'segment_slice', 'partial_cognate', range(0, list_position(segments, '+') - 1)::INTEGER[] FROM v_forms WHERE form_id % 3 = 0)"""


def membership_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.membership_segments(views.forms(spark, sf_dir), _memberships(spark, sf_dir))


def cognate_sets_of_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of the even forms; the odd ones have their own set, and every fifth of them none."""
    own = F.when(F.col("form_id") % 5 != 0, F.col("cognate_set_id"))
    return selection.cognate_sets_of_form(views.forms(spark, sf_dir).withColumn("cognate_set_id", own), _memberships(spark, sf_dir).where("form_id % 2 = 0"))


def alignment_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _memberships(spark, sf_dir).where("form_id % 4 <> 0")
    return alignment.alignment_inputs(views.forms(spark, sf_dir), judged)


def form_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation once: forms that meet twice, strangers, and judgements bent in each way."""
    forms = views.forms(spark, sf_dir)
    forms = forms.unionByName(forms.where("form_id % 31 = 0"))
    m, id_ = _memberships(spark, sf_dir), F.col("form_id")
    bent = F.when(F.col("scope") == "segment_slice", F.when(id_ % 9 == 0, F.array(F.lit(99))).when(id_ % 21 == 0, F.array(F.lit(4))).otherwise(F.col("segment_indices"))).when(id_ % 41 == 0, F.array(F.lit(0))).otherwise(F.col("segment_indices"))
    read = F.when((F.col("scope") == "segment_slice") & (id_ % 15 == 0), "asserted").otherwise(F.col("interpretation"))
    varieties = forms.select("variety_id").where("variety_id <> 'Brand#7'").distinct()
    return checks.check_forms(forms, m.withColumns({"segment_indices": bent, "interpretation": read}), varieties)


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = views.forms(spark, sf_dir)
    varieties, concepts = forms.select("variety_id").distinct(), forms.select("concept_id").distinct()
    varieties = varieties.unionByName(varieties.where("variety_id like '%1'"))
    concepts = concepts.unionByName(concepts.where("concept_id like '%7'"))
    bindings = forms.where("form_id % 97 = 0").select(F.col("variety_id").alias("source_variety_id"))
    return checks.check_unique_ids(varieties, concepts, bindings)


def alignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that lack their last column here and there, and views of alignments that are not there."""
    members = views.aligned(spark, sf_dir).withColumn("alignment_id", F.col("cognate_set_id"))
    bent = members.withColumn("aligned", F.when(F.col("form_id") % 19 == 0, F.slice("aligned", F.lit(1), F.size("aligned") - 1)).otherwise(F.col("aligned")))
    pairwise = views.forms(spark, sf_dir).select(F.col("cognate_set_id").alias("alignment_id"))
    return checks.check_alignments(bent, pairwise)


def beam_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf beams of four, checked as beams of three, some of them bent."""
    found = beam.leaf_beam(views.forms(spark, sf_dir), 4)
    bent = F.when(F.col("concept_id").endswith("3") & (F.col("rank") == 1), F.col("probability") / 2).otherwise(F.col("probability"))
    return checks.check_beam(found.withColumn("probability", bent), ["variety_id", "concept_id"], 3)


def _keyed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the tree by key; some labels are missing, some meet twice."""
    edges = views.edges(spark, sf_dir)
    nodes = edges.select(F.col("child_id").alias("node_key"), F.col("parent_id").alias("parent_key"), "child_ordinal").union(edges.where("parent_id = 'root'").select("parent_id", F.lit(None).cast("string"), F.lit(1)).distinct())
    key = F.col("node_key")
    label = F.when(key.endswith("4"), None).when(key == "Brand#12", "Brand#11").when(key == "g3", "g2").when(key == "root", "").otherwise(key)
    return nodes.withColumn("label", label)


def leaf_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_tree_leaves(_keyed_nodes(spark, sf_dir))


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.assign_node_ids(_keyed_nodes(spark, sf_dir)).select("node_key", "node_id")


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand of the last two groups bound somewhere: to its group, to the root, or to a leaf."""
    edges = views.edges(spark, sf_dir).where("parent_id in ('g4', 'g5')")
    node = F.when(F.col("child_ordinal") % 3 == 0, F.col("parent_id")).when(F.col("child_ordinal") % 3 == 1, "root").otherwise(F.lit("Brand#1"))
    return edges.select(node.alias("node_id"), F.when(F.col("child_ordinal") % 2 == 0, "anchor").otherwise("target").alias("role"), F.col("child_id").alias("source_variety_id"))


BINDINGS = "v_bind AS (SELECT CASE n % 3 WHEN 0 THEN 'g' || ceil(n / 5)::INTEGER WHEN 1 THEN 'root' ELSE 'Brand#1' END AS node_id, CASE WHEN n % 2 = 0 THEN 'anchor' ELSE 'target' END AS role, child_id AS source_variety_id FROM v_brands WHERE n > 15)"


def binding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches named by number: their descendants spread over several children of the root, or two meet in one."""
    edges = views.edges(spark, sf_dir)
    lineage = edges.where("parent_id <> 'root'").select(F.lit("root").alias("node_id"), F.concat(F.lit("b"), F.col("child_ordinal") % 3).alias("branch_id"), F.col("child_id").alias("descendant_id"))
    deep = edges.where("parent_id = 'g2'").select(F.lit("g2").alias("node_id"), F.col("child_id").alias("branch_id"), F.col("child_id").alias("descendant_id"))
    return checks.check_bindings(_bindings(spark, sf_dir), lineage.unionByName(deep), tree.closure(edges), edges, views.forms(spark, sf_dir))


def anchor_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms, id_ = views.forms(spark, sf_dir), F.col("form_id")
    anchors = forms.where(F.col("variety_id") == ANCHOR).select(F.when(id_ % 2 == 0, "g5").otherwise("g9").alias("node_id"), "form_id", F.when(id_ % 3 == 0, "c0").otherwise(F.col("concept_id")).alias("concept_id"), F.when(id_ % 5 == 0, " ").otherwise("view").alias("provenance"))
    edges = views.edges(spark, sf_dir)
    return checks.check_anchors(anchors, edges.select(F.col("parent_id").alias("node_id")).distinct(), forms)


def target_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    varieties = views.forms(spark, sf_dir).select("variety_id").distinct().where("variety_id not in ('Brand#17', 'Brand#19')")
    return checks.check_target_leakage(_bindings(spark, sf_dir), varieties, views.edges(spark, sf_dir))


def selected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = views.forms(spark, sf_dir)
    bindings = spark.createDataFrame([(GOLD,)], "source_variety_id string")
    concepts = forms.select("concept_id").distinct().where("concept_id not in ('c1', 'c2', 'c3')")
    return selection.select_evidence(forms, forms.select("variety_id").distinct(), concepts, bindings).select("form_id", "variety_id", "concept_id")


def bound_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.bind_historical_forms(_bindings(spark, sf_dir), views.forms(spark, sf_dir))


def merged_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = bound_forms(spark, sf_dir).where("role = 'anchor'").select("node_id", "form_id")
    return selection.merge_anchors(bound, bound.where("form_id % 4 = 0").withColumn("node_id", F.lit("g1")))


def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = views.forms(spark, sf_dir)
    daughters = forms.where(F.col("variety_id") != GOLD)
    chosen = selection.choose_concepts(base.benchmark_concepts(spark, sf_dir), "all")
    gold = forms.where(F.col("variety_id") == GOLD).select(F.lit("root").alias("node_id"), "concept_id")
    return selection.benchmark_report(chosen, daughters, gold)


def overlaid_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays that move the boundary one sound to the right; some change a sound, some meet twice."""
    forms, id_ = views.forms(spark, sf_dir), F.col("form_id")
    at = F.array_position("segments", "+").cast("int")
    moved = F.concat(F.slice("segments", F.lit(1), at - 1), F.slice("segments", at + 1, F.lit(1)), F.array(F.lit("+")), F.slice("segments", at + 2, F.size("segments")))
    changed = F.concat(F.array(F.lit("z")), F.slice("segments", F.lit(2), F.size("segments")))
    overlay = forms.where("form_id % 4 = 0").select("form_id", F.when(id_ % 12 == 0, changed).otherwise(moved).alias("segments"))
    overlay = overlay.unionByName(forms.where("form_id % 20 = 0").select("form_id", F.reverse("segments").alias("segments")))
    slices = _memberships(spark, sf_dir).where("scope = 'segment_slice'")
    slices = slices.join(forms.select("form_id", F.size("segments").alias("n")), "form_id").withColumn("segment_indices", F.array(F.col("n") - 1)).drop("n")
    done, judged, errors = selection.apply_overlay(forms, slices, overlay)
    first = done.where("form_id % 4 = 0").join(errors, "form_id", "left").select("form_id", F.concat_ws(" ", "segments").alias("text"), "error")
    second = judged.select("form_id", F.concat_ws(" ", F.transform("segment_indices", lambda i: i.cast("string"))).alias("text"), F.lit("index").alias("error"))
    return first.unionByName(second)


def listed_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to the twelfth concept with a 1 in its id or gloss."""
    forms = views.forms(spark, sf_dir).where("variety_id <> 'Brand#5'")
    concepts = forms.select("concept_id").distinct().withColumns({"gloss": F.concat(F.lit("size "), F.substring("concept_id", 2, 9)), "concepticon_id": F.lit(None).cast("string"), "semantic_field": F.lit("sizes"), "aliases": F.array().cast("array<string>")})
    return selection.list_concepts(forms, concepts, "E 1", 2, 10)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.classify_evidence(views.edges(spark, sf_dir))


def listed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = spark.createDataFrame([("g1",), ("g2",)], "node_id string")
    return selection.list_nodes(evidence(spark, sf_dir), views.forms(spark, sf_dir), prior).drop("leaf_ids")


def committed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = views.rules(spark).select("node_id", "rule_ordinal", "dsl")
    odd = views.trajectories(spark, sf_dir).where("n_no_ops > 0").select("node_id")
    return selection.lookup_committed_rules(commits, odd, evidence(spark, sf_dir))


def resumable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.createDataFrame([("g2",), ("g3",), ("g4",)], "node_id string")
    return selection.resumable_commits(views.trajectories(spark, sf_dir), steps, 3, 1).select("conv_id", "node_id")


def pruned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the leaves of g1, one of g2, and two of g3; one length is not known."""
    edges = views.edges(spark, sf_dir).withColumn("branch_length", F.when(F.col("child_id") != "Brand#11", F.col("branch_length")))
    usable = edges.where("parent_id = 'g1' or child_id in ('Brand#7', 'Brand#11', 'Brand#12')").select(F.col("child_id").alias("leaf_id"))
    return tree.prune_and_collapse(edges, usable)


def tree_subclades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.outgroups(views.edges(spark, sf_dir), "subclade")


def internal_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root's step lists three groups, its trajectory all; the groups have trajectories alone."""
    edges = views.edges(spark, sf_dir)
    own = edges.groupBy("parent_id").agg(F.array_sort(F.collect_list("child_id")).alias("child_ids"))
    steps = own.where("parent_id = 'root'").withColumn("child_ids", F.filter("child_ids", lambda c: c.isin("g1", "g2", "g3")))
    return tree.internal_children(steps, own)


QUERIES = {
    f.__name__: f
    for f in (
        read_wordlist_forms, read_wordlist_memberships, read_wordlist_rejects, read_wordlist_varieties, read_wordlist_concepts, tokenized_forms, collected_memberships,
        payload_round_trip, lineages, anchor_file, event_lines, bad_event_lines, streamed_event_lines, run_directories, trajectory_lines, membership_segments, cognate_sets_of_form, alignment_inputs,
        form_violations, repeated_ids, alignment_violations, beam_violations, leaf_violations, node_ids, binding_violations, anchor_violations, target_leakage,
        selected_evidence, bound_forms, merged_anchors, benchmark_report, overlaid_forms, listed_concepts, evidence, listed_nodes, committed_rules, resumable_commits,
        pruned_tree, tree_subclades, internal_children,
    )
}

_slices = ", ".join(f"'{s}'" for s in views.SLICES)
CLDF = f"""v_csv AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS dataset, regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER AS n,
  list_transform(regexp_extract_all(p_name, '.'), lambda c: CASE WHEN c = ' ' THEN '+' ELSE c END) AS letters, [{_slices}][p_partkey % {len(views.SLICES)} + 1] AS slice, strpos(p_name, ' ') AS gap FROM part),
v_raw AS (SELECT *, CASE WHEN p_partkey % 11 <> 0 THEN letters WHEN p_partkey % 22 = 0 THEN list_transform(letters, lambda c: upper(c)) END AS segments, dataset || ':' || p_partkey AS form_id,
  CASE WHEN p_partkey % 14 = 0 THEN ['i' || substr(p_name, 1, 1), 'j' || substr(p_name, 2, 1)] WHEN p_partkey % 7 = 0 THEN ['i' || substr(p_name, 1, 1)] ELSE [] END AS inl FROM v_csv),
v_lines AS (SELECT *, 1 + row_number() OVER (PARTITION BY dataset ORDER BY p_partkey::VARCHAR) AS source_row FROM v_raw),
v_all AS (SELECT dataset, form_id, dataset || ':cognate-membership:' || p_partkey || 'c' AS membership_id, dataset || ':' || p_size || substr(p_name, 1, 1) AS cognate_set_id, string_split(slice, ' ') AS slices, slice, 'CognateTable' AS source_table,
    1 + row_number() OVER (PARTITION BY dataset ORDER BY p_partkey || 'c') AS source_row, CASE WHEN p_partkey % 10 = 2 THEN ['a', '-', 'b'] ELSE [] END AS alignment FROM v_raw WHERE p_partkey % 5 <> 0
  UNION ALL SELECT dataset, form_id, dataset || ':form-membership:' || p_partkey || ':' || k, dataset || ':' || inl[k], [], '', 'FormTable', source_row, [] FROM (SELECT *, unnest(range(1, len(inl) + 1)) AS k FROM v_lines)),
v_kept AS (SELECT * FROM v_lines WHERE segments IS NOT NULL AND p_partkey % 17 <> 0 AND form_id IN (SELECT form_id FROM v_all)),
v_sets AS (SELECT form_id, count(DISTINCT cognate_set_id) FILTER (slice = '') AS wholes, CASE WHEN count(DISTINCT cognate_set_id) = 1 AND bool_and(slice = '') THEN min(cognate_set_id) END AS sole FROM v_all GROUP BY form_id)"""
_forms = f"WITH {base.FORMS}"
_edges = f"WITH RECURSIVE {base.EDGES}, {base.CLOSURE}"
_leaf = "descendant_id NOT IN (SELECT parent_id FROM v_edges)"

ORACLES = {
    "read_wordlist_forms": f"""WITH {CLDF} SELECT form_id, dataset || ':' || n AS variety_id, CASE WHEN p_size % 3 <> 0 THEN (p_size + 1000)::VARCHAR ELSE dataset || ':' || p_size END AS concept_id, segments, sole AS cognate_set_id,
CASE WHEN p_partkey % 11 <> 0 THEN 'Segments' ELSE 'Phonemic_Segments' END AS segment_source, source_row FROM v_kept JOIN v_sets USING (form_id)""",
    "read_wordlist_memberships": f"""WITH {CLDF}, j AS (SELECT v_all.*, wholes, gap, len(segments) AS l FROM v_all JOIN v_kept USING (form_id) JOIN v_sets USING (form_id) WHERE v_all.slice NOT IN ('3', 'x', '1 1:2'))
SELECT form_id, membership_id, cognate_set_id, CASE WHEN slice = '' THEN 'whole_form' ELSE 'segment_slice' END AS scope, CASE WHEN slice <> '' THEN 'partial_cognate' WHEN wholes > 1 THEN 'alternative_analysis' ELSE 'asserted' END AS interpretation,
CASE slice WHEN '' THEN [] WHEN '1' THEN range(0, gap - 1) WHEN '2' THEN range(gap, l) ELSE list_concat(range(0, gap - 1), range(gap, l)) END::INTEGER[] AS segment_indices, alignment, source_table, source_row FROM j""",
    "read_wordlist_rejects": f"WITH {CLDF} SELECT form_id, membership_id, CASE v_all.slice WHEN '3' THEN 'outside' WHEN 'x' THEN 'malformed' ELSE 'overlapping' END AS error, CASE v_all.dataset WHEN 'alpha' THEN 'alpha' ELSE 'beta/cldf' END || CASE v_all.source_table WHEN 'CognateTable' THEN '/cognates.csv' ELSE '/forms.csv' END AS source_file, v_all.source_row FROM v_all JOIN v_kept USING (form_id) WHERE v_all.slice IN ('3', 'x', '1 1:2')",
    "read_wordlist_varieties": f"""WITH {CLDF} SELECT DISTINCT dataset AS dataset_id, dataset || ':' || n AS variety_id, n::VARCHAR AS source_language_id, p_brand AS name, CASE WHEN n % 6 <> 0 THEN 'glot' || n END AS source_glottocode, 'f' || (n % 3) AS family, n = 25 AS is_historical,
CASE WHEN dataset = 'alpha' AND n = 1 THEN 'code1' WHEN dataset = 'beta' AND n = 2 THEN 'code2' WHEN n % 6 <> 0 THEN 'glot' || n END AS tree_glottocode,
CASE WHEN dataset = 'alpha' AND n = 1 THEN ['r1'] WHEN dataset = 'beta' AND n = 2 THEN ['r2'] WHEN dataset = 'alpha' AND n = 3 THEN ['r3', 'r4'] ELSE [] END AS compatibility_rule_ids, CASE WHEN dataset = 'alpha' AND n = 3 THEN 'several overrides' END AS error FROM v_kept""",
    "read_wordlist_concepts": f"""WITH {CLDF}, c AS (SELECT DISTINCT dataset, p_size, CASE WHEN p_size % 3 <> 0 THEN (p_size + 1000)::VARCHAR ELSE dataset || ':' || p_size END AS concept_id FROM v_raw)
SELECT dataset AS dataset_id, p_size::VARCHAR AS parameter_id, concept_id, CASE WHEN p_size % 3 <> 0 THEN (p_size + 1000)::VARCHAR END AS concepticon_id, 'size ' || p_size AS gloss FROM c
WHERE concept_id IN (SELECT CASE WHEN p_size % 3 <> 0 THEN (p_size + 1000)::VARCHAR ELSE dataset || ':' || p_size END FROM v_kept)""",
    "tokenized_forms": f"WITH {CLDF} SELECT p_partkey::VARCHAR AS ID, coalesce(segments, []) AS segments, CASE WHEN p_partkey % 11 <> 0 THEN 'Segments' WHEN p_partkey % 22 = 0 THEN 'Phonemic_Segments' END AS segment_source FROM v_raw",
    "collected_memberships": f"WITH {CLDF} SELECT dataset AS dataset_id, form_id, membership_id, cognate_set_id, list_filter(slices, lambda s: s <> '') AS slices, source_table FROM v_all",
    "payload_round_trip": f"{_forms} SELECT variety_id, form_id::VARCHAR AS form_id, concept_id, segments, cognate_set_id FROM v_forms",
    "lineages": f"WITH {base.EDGES} SELECT 'Brand#25' AS target_variety_id, 'target' AS role, list(struct_pack(branch_id := 'g' || ceil(n / 5)::INTEGER, descendant_variety_id := child_id, evidence := 'view') ORDER BY 'g' || ceil(n / 5)::INTEGER, child_id) AS relations FROM v_brands WHERE n % 5 <> 0 AND n % 7 <> 0",
    "anchor_file": f"{_forms} SELECT 'g5' AS node_id, form_id::VARCHAR AS form_id, concept_id, segments, 'view' AS provenance FROM v_forms WHERE variety_id = 'Brand#24'",
    "event_lines": "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_id % 50 <> 0 AND event_id % 77 <> 0 GROUP BY 1 UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 50 = 0 OR event_id % 77 = 0",
    "bad_event_lines": """SELECT part, source_row, value FROM (SELECT event_id, event_id % 5 AS part, row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) AS source_row,
CASE WHEN event_id % 50 = 0 THEN left(line, len(line) - 3) ELSE '[1]' END AS value FROM (SELECT event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' AS line FROM events)) WHERE event_id % 50 = 0 OR event_id % 77 = 0""",
    "streamed_event_lines": "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_id % 50 <> 0 AND event_id % 77 <> 0 GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events WHERE event_id % 50 = 0 OR event_id % 77 = 0",
    "run_directories": f"WITH {base.TRAJECTORIES} SELECT 'run-' || run_id AS run, conv_id, node_id, completed, CASE WHEN run_id % 3 <> 0 THEN count(*) OVER (PARTITION BY run_id) END AS n_nodes FROM v_traj",
    "trajectory_lines": f"WITH {base.TRAJECTORIES} SELECT conv_id, run_id, node_id, completed, tool_calls FROM v_traj",
    "membership_segments": f"{_forms}, {MEMBERS} SELECT form_id, membership_id, CASE WHEN len(segment_indices) > 0 THEN segments[1:len(segment_indices)] ELSE segments END AS segments FROM v_members JOIN v_forms USING (form_id)",
    "cognate_sets_of_form": f"{_forms} SELECT form_id, CASE WHEN form_id % 6 = 0 THEN [cognate_set_id, cognate_set_id || 's'] WHEN form_id % 2 = 0 THEN [cognate_set_id] WHEN form_id % 5 <> 0 THEN [cognate_set_id] ELSE [] END AS sets FROM v_forms",
    "alignment_inputs": f"""{_forms}, {MEMBERS}, r AS (SELECT form_id, variety_id, concept_id, m.cognate_set_id, CASE WHEN len(segment_indices) > 0 THEN segments[1:len(segment_indices)] ELSE segments END AS segments FROM v_members m JOIN v_forms USING (form_id) WHERE form_id % 4 <> 0
UNION ALL SELECT form_id, variety_id, concept_id, cognate_set_id, segments FROM v_forms WHERE form_id % 4 = 0) SELECT form_id, variety_id, concept_id, cognate_set_id, list_filter(segments, lambda s: s <> '+') AS segments FROM r""",
    "form_violations": f"""{_forms}, a AS (SELECT form_id, variety_id, len(segments) AS l, list_position(segments, '+') AS gap, 1 + (form_id % 31 = 0)::INTEGER AS copies FROM v_forms), c AS (SELECT a.*, unnest(range(0, copies)) AS k FROM a)
SELECT form_id, 'repeated id' AS violation FROM a WHERE copies > 1 UNION ALL SELECT form_id, 'foreign variety' FROM c WHERE variety_id = 'Brand#7'
UNION ALL SELECT form_id, 'index outside the form' FROM c WHERE form_id % 9 = 0 UNION ALL SELECT form_id, 'slice of boundaries' FROM c WHERE form_id % 21 = 0 AND form_id % 9 <> 0 AND gap = 5
UNION ALL SELECT form_id, 'whole form with indices' FROM a WHERE form_id % 41 = 0 UNION ALL SELECT form_id, 'slice that is not partial' FROM a WHERE form_id % 15 = 0""",
    "repeated_ids": f"""{_forms} SELECT DISTINCT 'variety' AS kind, variety_id AS id, 'repeated id' AS violation FROM v_forms WHERE variety_id LIKE '%1' UNION ALL SELECT DISTINCT 'concept', concept_id, 'repeated id' FROM v_forms WHERE concept_id LIKE '%7'
UNION ALL SELECT 'source', variety_id, 'repeated id' FROM v_forms WHERE form_id % 97 = 0 GROUP BY variety_id HAVING count(*) > 1""",
    "alignment_violations": f"""{_forms}, {base.PADDED}, m AS (SELECT DISTINCT cognate_set_id, form_id FROM v_cols) SELECT cognate_set_id AS alignment_id, 'unequal width' AS violation FROM m GROUP BY 1 HAVING bool_or(form_id % 19 = 0) AND NOT bool_and(form_id % 19 = 0)
UNION ALL SELECT DISTINCT cognate_set_id, 'unknown alignment' FROM v_forms WHERE cognate_set_id NOT IN (SELECT cognate_set_id FROM m)""",
    "beam_violations": f"""{_forms}, {base.LEAF.replace('rank <= 5', 'rank <= 4')}, b AS (SELECT variety_id, concept_id, rank, CASE WHEN concept_id LIKE '%3' AND rank = 1 THEN probability / 2 ELSE probability END AS probability FROM v_leaf),
l AS (SELECT *, lead(probability) OVER (PARTITION BY variety_id, concept_id ORDER BY rank) AS nx FROM b)
SELECT variety_id, concept_id, 'probabilities do not sum to one' AS violation FROM l GROUP BY ALL HAVING abs(sum(probability) - 1) > 1e-8
UNION ALL SELECT variety_id, concept_id, 'not in descending order' FROM l GROUP BY ALL HAVING bool_or(nx > probability) UNION ALL SELECT variety_id, concept_id, 'too wide' FROM l GROUP BY ALL HAVING count(*) > 3""",
    "leaf_violations": f"""WITH {base.EDGES} SELECT child_id AS node_key, 'unlabelled leaf' AS violation FROM v_brands WHERE child_id LIKE '%4' UNION ALL SELECT child_id, 'repeated leaf' FROM v_brands WHERE n IN (11, 12)
UNION ALL SELECT DISTINCT parent_id, 'repeated node' FROM v_edges WHERE parent_id IN ('g2', 'g3')""",
    "node_ids": f"""WITH {base.EDGES}, o AS (SELECT child_id, parent_id, (row_number() OVER (PARTITION BY parent_id ORDER BY child_ordinal, child_id) - 1)::VARCHAR AS k FROM v_edges),
p AS (SELECT 'root' AS node_key, 'root' AS path UNION ALL SELECT child_id, 'root.' || k FROM o WHERE parent_id = 'root' UNION ALL SELECT o.child_id, 'root.' || g.k || '.' || o.k FROM o JOIN o g ON o.parent_id = g.child_id)
SELECT node_key, CASE WHEN node_key LIKE '%4' OR node_key = 'root' THEN 'internal:' || path WHEN node_key = 'Brand#12' THEN 'Brand#11' WHEN node_key = 'g3' THEN 'g2' ELSE node_key END AS node_id FROM p""",
    "binding_violations": f"""{_edges}, {base.FORMS}, {BINDINGS}, src AS (SELECT node_id, concept_id FROM v_bind JOIN v_forms ON variety_id = source_variety_id WHERE role = 'anchor'),
att AS (SELECT ancestor_id, concept_id FROM v_closure JOIN v_forms ON variety_id = descendant_id),
lin AS (SELECT DISTINCT 'b' || (n % 3) AS branch_id, 'g' || ceil(n / 5)::INTEGER AS child FROM v_brands)
SELECT node_id, 'not an internal node' AS violation FROM v_bind WHERE node_id = 'Brand#1'
UNION ALL SELECT DISTINCT node_id, 'concept not attested' FROM src WHERE (node_id, concept_id) NOT IN (SELECT (ancestor_id, concept_id) FROM att)
UNION ALL SELECT DISTINCT 'root', 'branch not under one child' FROM (SELECT branch_id FROM lin GROUP BY 1 HAVING count(*) <> 1)
UNION ALL SELECT DISTINCT 'root', 'branches collapse' FROM (SELECT child FROM lin GROUP BY 1 HAVING count(*) > 1)""",
    "anchor_violations": f"""{_forms}, a AS (SELECT * FROM v_forms WHERE variety_id = 'Brand#24') SELECT form_id, 'unknown node' AS violation FROM a WHERE form_id % 2 <> 0 UNION ALL SELECT form_id, 'unknown concept' FROM a WHERE form_id % 3 = 0
UNION ALL SELECT form_id, 'no provenance' FROM a WHERE form_id % 5 = 0""",
    "target_leakage": f"WITH {base.EDGES}, {BINDINGS} SELECT source_variety_id, 'in the evidence' AS violation FROM v_bind WHERE role = 'target' AND source_variety_id NOT IN ('Brand#17', 'Brand#19') UNION ALL SELECT source_variety_id, 'bound to a leaf' FROM v_bind WHERE role = 'target' AND node_id = 'Brand#1'",
    "selected_evidence": f"{_forms} SELECT form_id, variety_id, concept_id FROM v_forms WHERE variety_id <> 'Brand#25' AND concept_id NOT IN ('c1', 'c2', 'c3')",
    "bound_forms": f"WITH {base.EDGES}, {BINDINGS}, {base.FORMS} SELECT node_id, role, form_id, concept_id, segments FROM v_bind JOIN v_forms ON variety_id = source_variety_id",
    "merged_anchors": f"""WITH {base.EDGES}, {BINDINGS}, {base.FORMS}, b AS (SELECT node_id, form_id FROM v_bind JOIN v_forms ON variety_id = source_variety_id WHERE role = 'anchor')
SELECT node_id, form_id, form_id % 4 = 0 AS repeated FROM b UNION ALL SELECT 'g1', form_id, true FROM b WHERE form_id % 4 = 0""",
    "benchmark_report": f"""{_forms}, d AS (SELECT * FROM v_forms WHERE variety_id <> 'Brand#25') SELECT 'root' AS node_id, (SELECT count(DISTINCT variety_id) FROM d) AS n_daughters, (SELECT count(DISTINCT concept_id) FROM d) AS n_concepts, count(*) AS n_gold_forms
FROM v_forms WHERE variety_id = 'Brand#25' AND concept_id IN (SELECT concept_id FROM d) HAVING count(*) > 0""",
    "overlaid_forms": f"""{_forms}, f AS (SELECT *, list_position(segments, '+') AS pos FROM v_forms), e AS (SELECT *, CASE WHEN form_id % 20 = 0 THEN 'ambiguous' WHEN form_id % 12 = 0 AND segments[1] <> 'z' THEN 'changed' END AS error FROM f)
SELECT form_id, array_to_string(CASE WHEN error IS NOT NULL OR form_id % 12 = 0 THEN segments ELSE list_concat(segments[1:pos - 1], segments[pos + 1:pos + 1], ['+'], segments[pos + 2:]) END, ' ') AS text, error FROM e WHERE form_id % 4 = 0
UNION ALL SELECT form_id, (len(segments) - 1)::VARCHAR, 'index' FROM e WHERE form_id % 3 = 0""",
    "listed_concepts": f"{_forms} SELECT concept_id, count(*) AS n_forms, list_sort(list(DISTINCT variety_id)) AS nodes FROM v_forms WHERE variety_id <> 'Brand#5' AND concept_id LIKE 'c1%' GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 2",
    "evidence": f"""{_edges}, lv AS (SELECT ancestor_id AS node_id, list(descendant_id ORDER BY descendant_id) AS leaf_ids FROM v_closure WHERE {_leaf} GROUP BY 1), i AS (SELECT DISTINCT parent_id FROM v_edges),
s AS (SELECT p.parent_id, n.node_id, n.leaf_ids, n.node_id NOT IN (SELECT parent_id FROM v_edges) AS leaf FROM i p, lv n WHERE p.parent_id <> n.node_id)
SELECT s.parent_id, s.node_id, CASE WHEN leaf THEN 'observed' ELSE 'reconstructed' END AS kind, CASE WHEN e.child_id IS NOT NULL THEN 'active_child' WHEN list_has_all(l.leaf_ids, s.leaf_ids) THEN 'descendant' ELSE 'outgroup' END AS relation, s.leaf_ids
FROM s JOIN lv l ON l.node_id = s.parent_id LEFT JOIN v_edges e ON e.parent_id = s.parent_id AND e.child_id = s.node_id WHERE leaf OR s.parent_id = 'root' OR (s.node_id <> 'root' AND s.node_id < s.parent_id)""",
    "resumable_commits": f"WITH {base.TRAJECTORIES} SELECT conv_id, node_id FROM v_traj WHERE completed AND run_id = 3 AND schema_hash = 1 AND node_id IN ('g2', 'g3', 'g4')",
    "pruned_tree": f"""WITH {base.EDGES} SELECT 'g1' AS parent_id, child_id, child_ordinal, 1.0::DOUBLE AS branch_length FROM v_edges WHERE parent_id = 'g1' UNION ALL SELECT 'root', 'g1', 1, 1.0 WHERE EXISTS (FROM v_edges) UNION ALL SELECT 'root', 'Brand#7', 2, 2.0 WHERE EXISTS (FROM v_edges)
UNION ALL SELECT 'root', 'g3', 3, 1.0 WHERE EXISTS (FROM v_edges) UNION ALL SELECT 'g3', child_id, child_ordinal, CASE WHEN child_id = 'Brand#12' THEN 1.0 END FROM v_edges WHERE child_id IN ('Brand#11', 'Brand#12')""",
    "tree_subclades": f"""{_edges}, k AS (SELECT a.descendant_id AS node_id, e.child_id AS sib FROM v_closure a JOIN v_edges e ON e.parent_id = a.ancestor_id AND a.depth > 0 WHERE NOT EXISTS (SELECT 1 FROM v_closure o WHERE o.ancestor_id = e.child_id AND o.descendant_id = a.descendant_id)),
c AS (SELECT node_id, coalesce(child_id, sib) AS clade_id FROM k LEFT JOIN v_edges ON parent_id = sib) SELECT node_id, clade_id, descendant_id AS leaf_id FROM c JOIN v_closure ON ancestor_id = clade_id WHERE {_leaf}""",
    "internal_children": "SELECT DISTINCT 'root' AS parent_id, 'g' || ceil(regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER / 5)::INTEGER AS child_id FROM part WHERE regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER <= 15",
}
_evidence = ORACLES["evidence"].replace("SELECT s.parent_id, s.node_id, CASE", "ev AS (SELECT s.parent_id, s.node_id, CASE", 1).replace("lv.leaf_ids), s AS", "lv.leaf_ids), s AS")
_evidence = _evidence.replace("p.parent_id <> n.node_id)\nev AS", "p.parent_id <> n.node_id),\nev AS") + ")"
ORACLES["listed_nodes"] = f"""{_evidence}, {base.FORMS}, f AS (SELECT variety_id, count(*) AS n, count(DISTINCT concept_id) AS c FROM v_forms GROUP BY 1)
SELECT parent_id, node_id, kind, relation, coalesce(n, 0) AS n_forms, coalesce(c, 0) AS n_concepts, node_id IN ('g1', 'g2') AS has_hypothesis FROM ev LEFT JOIN f ON variety_id = node_id"""
_dsl = ", ".join(f"('{r[0]}', {r[1]}, '{r[2]}')" for r in views.RULES)
ORACLES["committed_rules"] = f"""{_evidence}, {base.TRAJECTORIES}, r(node_id, k, dsl) AS (VALUES {_dsl}), o AS (SELECT node_id, count(*) AS n FROM v_traj WHERE n_no_ops > 0 GROUP BY 1)
SELECT parent_id, ev.node_id, list(dsl ORDER BY k) AS rules, coalesce(any_value(n), 0) AS n_anomalies, false AS identity FROM ev JOIN r ON r.node_id = ev.node_id LEFT JOIN o ON o.node_id = ev.node_id WHERE kind = 'reconstructed' GROUP BY ALL"""
