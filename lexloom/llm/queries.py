"""Queries of this subpackage: each applies one operator to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.llm import bit_sliced, collocations, decontaminate, divergence, hnsw, jaccard_join, mixing, quality, repeats, secrets, sharding, token_files, url_filter
from lexloom.plans.scratch import Scratch
from lexloom.sources.tables import table

#: Rules of the URL query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Pages whose text holds runs of such marks are junk; their canonical URLs are the list.
JUNK_MARKS = r"%%%|###|[*]{3}"
SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Mixing: the budget in input sizes, and the entropy aimed at, as a share of the largest.
MIX = {"budget": 1.0, "entropy": 0.97}


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark).root}/tokens"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, path)


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.xxhash64("text"))
    return mixing.positions(mixing.mix(docs, **MIX), digest="digest").select("doc_id", "source", "pass", "n_tokens", "position")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = pages.where(F.col("html").rlike(JUNK_MARKS)).select("url")
    return url_filter.judge(pages, rules, listed).drop("listed")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.place(docs, ["doc_id"], SHARDS).select("doc_id", "slot", "shard")


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400, keep="none")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), min_count=30, top=2000, absorb=80)


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_token_files, op3_temperature_mixing, op4_secret_scan, op5_decontaminate, op6_url_filter, op7_sharding,
        op8_bit_sliced_top_k, op9_quality_classifier, op10_repeats, op11_nearest_neighbours, op12_source_divergence, op13_collocations,
    )
}
