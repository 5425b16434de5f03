"""One registered query for each operator of the training-data pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, gif, mixing, neardup, neighbours, packing, phrases, pii, quality, repeats, secrets, shards, sql, trie
from .common import table


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), packing.vocabulary(), with_ids=False)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", *[count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.round(F.array_min(F.transform("spans", lambda s: s["cost"])), 6).alias("least_guesses_log10"),
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    return found.select("doc_id", *[count_of(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op8_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.language_scores(table(spark, sf_dir, "documents"))


def op9_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shards.shard(table(spark, sf_dir, "documents"), shards=40)
    columns = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"]
    return placed.select(*columns)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_mix_sources, op3_minhash_near_dedup, op4_best_fit_packing, op5_suffix_array_dedup, op6_secret_scan, op7_personal_data, op8_context_tree_scores, op9_gif_columns, op10_nearest_neighbours, op11_phrase_collocations, op12_virtual_slots, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": sql.MIX, "op11_phrase_collocations": sql.PHRASES, "op13_prefix_trie": sql.TRIE}
