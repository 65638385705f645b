"""Documents to training sequences: five stages, each written as Parquet before the next.

Toxic documents go; lines that repeat across the corpus stay once; of each class of near
copies one document stays; documents that hold a benchmark item go; what is left is encoded.
Each stage takes ``(spark, docs, sf_dir)`` and reads all rows of the one before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm import (decontamination, line_dedup, near_dedup, sentencepiece_lattice,
                            toxicity)
from polderlake.llm.common import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark, docs, **line_dedup.EVERY_LINE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(spark, docs, benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``piece_ids`` and ``n_pieces``, and ``decodes``: the ids give the text back."""
    table = sentencepiece_lattice.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentencepiece_lattice.encode(docs, table)
    return coded.withColumns({
        "n_pieces": F.size("piece_ids").cast("long"),
        "decodes": sentencepiece_lattice.decodes(table)})


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines),
          ("near_dedup", drop_near_copies), ("decontamination", decontaminate),
          ("sentencepiece", encode)]

ORACLE_SQL = None  # edit distances, similarity classes and the encoder are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
