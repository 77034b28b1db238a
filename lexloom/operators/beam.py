"""Scored candidates: merging, pruning, normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Scores are rounded to so many places where they are compared.
PLACES = 12


def merge_prune_normalize(raw: DataFrame, keys: list[str], k: int | Column) -> DataFrame:
    """``keys, segments, log_score`` rows to ``keys, segments, log_score, rank, probability``.

    Equal segments merge by log-sum-exp; the k best by score, then segments, stay; empty forms and
    non-finite scores drop out. ``log_score`` is not normalised, ``probability`` is, over what stays.
    """
    good = raw.where((F.size("segments") > 0) & F.col("log_score").isNotNull() & ~F.isnan("log_score") & (F.abs("log_score") != float("inf")))
    top = Window.partitionBy(*keys, "segments")
    merged = good.withColumn("_m", F.max("log_score").over(top)).groupBy(*keys, "segments", "_m").agg(F.sum(F.exp(F.col("log_score") - F.col("_m"))).alias("_s"))
    merged = merged.select(*keys, "segments", (F.col("_m") + F.log("_s")).alias("log_score"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("log_score", PLACES)), "segments"))).where(F.col("rank") <= k)
    every = Window.partitionBy(*keys)
    weight = F.exp(F.col("log_score") - F.max("log_score").over(every))
    return ranked.withColumn("_w", weight).withColumn("probability", F.col("_w") / F.sum("_w").over(every)).drop("_w")


def candidate_id() -> Column:
    """Twelve hexadecimal digits that name a candidate's segments."""
    return F.substring(F.sha2(F.array_join("segments", "\u241f"), 256), 1, 12)


def counted(forms: DataFrame) -> DataFrame:
    """Different forms, and how often each occurs: ``variety_id, concept_id, segments, copies``."""
    copies = F.sum("copies") if "copies" in forms.columns else F.count("*")
    return forms.groupBy("variety_id", "concept_id", "segments").agg(copies.alias("copies"))


def leaf_beam(forms: DataFrame, k: int | Column) -> DataFrame:
    """Observed forms of each (variety, concept), at minus log of their number each; equal ones are counted first.

    A form of :func:`counted` stands for its copies.
    """
    n = F.sum("copies").over(Window.partitionBy("variety_id", "concept_id"))
    scored = counted(forms).select("variety_id", "concept_id", "segments", (-F.log(n) + F.log("copies")).alias("log_score"))
    return merge_prune_normalize(scored, ["variety_id", "concept_id"], k)


def tie_count(candidates: DataFrame, keys: list[str], within: float = 1e-9) -> DataFrame:
    """Per key: candidates, and whether the two best lie within ``within``."""
    order = Window.partitionBy(*keys).orderBy("rank")
    first = candidates.withColumns({"_next": F.lead("log_score").over(order), "n_candidates": F.count("*").over(Window.partitionBy(*keys))}).where("rank = 1")
    return first.select(*keys, "n_candidates", F.coalesce(F.col("log_score") - F.col("_next") < within, F.lit(False)).alias("tied"))


def best_lexicon(candidates: DataFrame) -> DataFrame:
    """The candidate of rank 1 of each variety and concept."""
    return candidates.where("rank = 1").select("variety_id", "concept_id", "segments")
