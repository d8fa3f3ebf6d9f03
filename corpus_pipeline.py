"""From raw documents to packed sequences: each stage works on what the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Nulls, empty tables, repeated rows
and further columns are handled as the operators say; a stage reads only doc_id, text and, for quality rules, lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, line_dedup, near_copies, packing, quality
from ledgerline.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cut-off reject go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stood in an earlier document, or earlier in the same one, go up to both their ends; n_chars follows the text."""
    cut = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_deleted_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id. Links are those of op1 (fingerprints within
    three bits) and those of five-word shingles at similarity 0.8."""
    return near_copies.keep_one(docs, fingerprints=True)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_overlaps),
    ("best-fit packing", packed_sequences),
]

#: Fingerprints, tokens and cut-offs are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
