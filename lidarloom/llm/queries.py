"""One query for each operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, archives, mixing, negatives, oracles, packing, pii, quality, quotes, rules, simhash, suffixes, urls, whitening
from .common import table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_conversations(table(spark, sf_dir, "conversations"))


def op8_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archives.convert_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.rule_report(table(spark, sf_dir, "documents"))
    return out.drop("posterior")


def op11_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(e.withColumn("label", turned))


def op13_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_permutation_index, op2_pareto_mixing, op3_simhash_trie, op4_bwt_merge, op5_concatenate_and_cut, op6_quadratic_discriminant,
        op7_quotation_linking, op8_association_rules, op9_arc_to_warc, op10_weak_supervision,
        op11_refined_whitening, op12_shared_list_negatives, op13_weak_pii,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
