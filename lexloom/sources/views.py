"""Comparative-wordlist tables as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.sources.tables import table

# The ordered rules of the example family.
RULES = [
    ("root", 1, "d > t", None, 1.0),
    ("root", 2, "l l > l", None, 0.9),
    ("g1", 1, "i > e / _ n", None, 0.8),
    ("g2", 1, "b > p / # _", None, 0.7),
    ("g3", 1, "r > Ø / _ #", None, 0.6),
    ("g4", 1, "w > v / + _", None, 0.5),
    ("g5", 1, "d > t", None, 0.5),
    ("g5", 2, "d > r / _ a", None, 0.9),
]

#: Slices of the example forms, in morphemes, sound and unsound ones.
SLICES = ["1", "", "2", "", "1 2", "", "1:2", "", "3", "x", "1 1:2", "", ""]


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``form_id, variety_id, concept_id, segments, cognate_set_id``: one form for each part."""
    chars = F.transform(F.regexp_extract_all("p_name", F.lit("(.)"), F.lit(1)), lambda c: F.when(c == " ", "+").otherwise(c))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("form_id"), F.col("p_brand").alias("variety_id"), F.concat(F.lit("c"), "p_size").alias("concept_id"), chars.alias("segments"))
    return part.withColumn("cognate_set_id", F.concat("concept_id", F.lit(":"), F.get("segments", F.lit(0))))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parent_id, child_id, child_ordinal, branch_length``: root, five groups, and the brands below them."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int")
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("child_id"), number.alias("n")).distinct()
    brands = brands.select(F.concat(F.lit("g"), F.ceil(F.col("n") / 5)).alias("parent_id"), "child_id", F.col("n").alias("child_ordinal"), F.lit(1.0).alias("branch_length"))
    groups = brands.select(F.lit("root").alias("a"), F.col("parent_id").alias("b"), F.substring("parent_id", 2, 9).try_cast("int").alias("c"), F.lit(1.0)).distinct()
    return groups.toDF("parent_id", "child_id", "child_ordinal", "branch_length").union(brands)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "node_id string, rule_ordinal int, dsl string, source_child_ids array<string>, confidence double")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each (concept, cognate set) of two or more varieties, padded with nulls to one width."""
    all_ = forms(spark, sf_dir)
    groups = all_.groupBy("concept_id", "cognate_set_id").agg(F.count_distinct("variety_id").alias("n"), F.max(F.size("segments")).alias("width")).where("n >= 2")
    padded = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.get("segments", i))
    return all_.join(groups, ["concept_id", "cognate_set_id"]).select("concept_id", "cognate_set_id", "form_id", "variety_id", padded.alias("aligned"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, event_id, ts, tool, rejected, code, cost, seconds, k``: tool calls of sessions."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    return rows.select(
        F.col("user_id").alias("session_id"), "event_id", "ts", F.col("event_type").alias("tool"), (F.col("event_type") == "error").alias("rejected"),
        F.concat(F.lit("schema:f"), (F.col("k") % 4).cast("string")).alias("code"), F.col("value").alias("cost"), (F.col("k") % 60).cast("double").alias("seconds"), "k",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, kind``: the events of ten nodes."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.concat(F.lit("n"), (F.col("user_id") % 10).cast("string")).alias("node_id"), F.col("event_type").alias("kind"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation: run, node, completion, failure, and counts of what was done."""
    role = lambda r: F.count_if(F.col("role") == r)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("tool_calls"), role("system").alias("protocol_failures"), role("assistant").alias("n_steps"), role("user").alias("users"))
    id_ = F.col("conv_id")
    failure = F.when(id_ % 10 == 0, F.concat(F.lit("timeout: turn "), F.col("tool_calls").cast("string"))).when(id_ % 5 == 0, F.concat(F.lit("stall: "), id_.cast("string")))
    return turns.select(
        "conv_id", (id_ % 7).alias("run_id"), F.concat(F.lit("g"), (1 + id_ % 5).cast("string")).alias("node_id"), (id_ % 5 != 0).alias("completed"),
        "tool_calls", "protocol_failures", (id_ % 3).alias("schema_hash"), F.concat(F.lit("m"), (id_ % 2).cast("string")).alias("model"), failure.alias("failure"),
        (id_ % 4).alias("n_rules"), "n_steps", (id_ % 11 == 0).cast("long").alias("n_no_ops"), (F.col("users") % 3).alias("n_inspections"), F.col("n_steps").alias("n_tests"),
        (id_ % 3).alias("n_cascades"), F.when(id_ % 9 != 0, (id_ % 10) / 10).alias("anomaly_rate"),
    )


def cldf(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four CSV tables of two datasets, alpha and beta, each with the column ``dataset``."""
    part = table(spark, sf_dir, "part").withColumns({"n": F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int"), "dataset": F.when(F.col("p_partkey") % 2 == 0, "alpha").otherwise("beta")})
    text = lambda c: c.cast("string")
    letters = F.array_join(F.transform(F.regexp_extract_all("p_name", F.lit("(.)"), F.lit(1)), lambda c: F.when(c == " ", "+").otherwise(c)), " ")
    first, second = F.substring("p_name", 1, 1), F.substring("p_name", 2, 1)
    inline = F.when(F.col("p_partkey") % 14 == 0, F.concat(F.lit("i"), first, F.lit("; j"), second)).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("i"), first))
    slices = F.element_at(F.array(*map(F.lit, SLICES)), (F.col("p_partkey") % len(SLICES) + 1).cast("int"))
    return {
        "languages": part.select("dataset", text(F.col("n")).alias("ID"), F.col("p_brand").alias("Name"), F.when(F.col("n") % 6 != 0, F.concat(F.lit("glot"), text(F.col("n")))).alias("Glottocode"), F.concat(F.lit("f"), text(F.col("n") % 3)).alias("Family"), F.when(F.col("n") == 25, "Yes").alias("historical")).distinct(),
        "parameters": part.select("dataset", text(F.col("p_size")).alias("ID"), F.concat(F.lit("size "), text(F.col("p_size"))).alias("Name"), F.when(F.col("p_size") % 3 != 0, text(F.col("p_size") + 1000)).alias("Concepticon_ID"), F.lit(None).cast("string").alias("Concepticon_Gloss")).distinct(),
        "forms": part.select("dataset", text(F.col("p_partkey")).alias("ID"), text(F.col("n")).alias("Language_ID"), F.when(F.col("p_partkey") % 17 != 0, text(F.col("p_size"))).alias("Parameter_ID"), F.when(F.col("p_partkey") % 11 != 0, letters).alias("Segments"), F.when(F.col("p_partkey") % 22 == 0, F.upper(letters)).alias("Phonemic_Segments"), inline.alias("Cognateset_ID")),
        "cognates": part.where("p_partkey % 5 <> 0").select("dataset", F.concat(text(F.col("p_partkey")), F.lit("c")).alias("ID"), text(F.col("p_partkey")).alias("Form_ID"), F.concat(text(F.col("p_size")), first).alias("Cognateset_ID"), F.nullif(slices, F.lit("")).alias("Segment_Slice")),
    }
