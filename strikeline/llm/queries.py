"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm import (
    exact_dedup,
    hard_negatives,
    jaccard_join,
    line_dedup,
    packing,
    periodic_runs,
    pii,
    sentencepiece_agenda,
    sharding,
    syncmers,
    toxicity,
    url_trust,
    warc,
)
from strikeline.llm.common import table
from strikeline.session import shared_dir


def op1_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens", "part",
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_agenda.encode(table(spark, sf_dir, "documents"), model)


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_test(table(spark, sf_dir, "documents"))


def op6_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), shared_dir(spark))
    return warc.read(manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, longest=2048, end_id=1)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.verdicts(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.find_runs(docs))


def op12_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"), at_least=10)
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_vector_shards,
        op2_sentencepiece,
        op3_counterfactual_toxicity,
        op4_weak_supervision_pii,
        op5_closed_syncmers,
        op6_heavy_light_jaccard,
        op7_warc_round_trip,
        op8_power_of_two_packing,
        op9_exact_dedup,
        op10_url_trust,
        op11_periodic_runs,
        op12_anchor_tree_negatives,
        op13_line_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op7_warc_round_trip": warc.READ_BACK_SQL,
    "op9_exact_dedup": exact_dedup.REPORT_SQL,
    "op10_url_trust": url_trust.VERDICT_SQL,
    "op12_anchor_tree_negatives": hard_negatives.MINED_SQL,
    "op13_line_dedup": line_dedup.LINES_SQL,
}
