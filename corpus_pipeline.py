"""A training corpus from documents: quality rules, near-duplicates, repeated strings, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lidarloom.llm import mixing, packing, rules, simhash_near, suffixes
from lidarloom.llm.common import one_run, staged, table


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go. Null, empty and short texts fail the base rule and go; repeated
    rows stay or go together; texts are judged whole, however long; an empty table stays empty; columns may have any
    names. So it is in the other stages, where they say nothing else."""
    return rules.keep_good(docs)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that links of five-word similarity 0.8 or more hold together: that with the smallest
    doc_id, null last. SimHash fingerprints of five words propose the links, the texts decide. Null, empty and blank texts
    are one group; repeated rows are copies."""
    return simhash_near.keep_one(docs)


@staged
def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier in the corpus go. Null texts stay null; a null doc_id counts as the largest;
    rows with one doc_id count as one place."""
    return suffixes.cut_repeats(docs)


@staged
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' weights ask for. Texts without words are taken as often as their source's others
    on average, at no cost; a null source is one of its own, the last."""
    return mixing.mixed_documents(docs)


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. Null texts count as empty and are one token; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", repeat_removal),
    ("source_mixing", source_mixing),
    ("packing", packing_stage),
]

#: Similarities, suffixes and tokens have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each stage's result is written, and goes when the next one's is; what is left, for the
    rows returned, goes with the application."""
    docs = table(spark, sf_dir, "documents")
    with one_run() as tables:
        for _, stage in STAGES[:-1]:
            docs = tables.keep(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
