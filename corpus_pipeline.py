"""From raw documents to packed training sequences: quality, language, repeated lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of
documents; the last returns the packed pieces. ``run`` writes each stage's result to the shared
folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlattice.llm import language_id, line_dedup, minhash_dedup, packing, quality_rank
from voltlattice.llm.common import fresh, materialize, prepare, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker accepts; it learns from all labelled ones among them."""
    prepare(spark)
    model = quality_rank.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(quality_rank.score_column(model) >= quality_rank.ACCEPT)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the given ones."""
    prepare(spark)
    model = language_id.train(docs)
    told = fresh(docs, "_language")
    return docs.withColumn(told, language_id.predict_column(spark, model, F.col("text"))).filter(f"`{told}`.accepted").drop(told)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of runs of lines."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows with an id that stays all stay; so do null ids.
    """
    prepare(spark)
    gone, key = minhash_dedup.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct(), fresh(docs, "_gone")
    gone = gone.withColumnRenamed("doc_id", key)
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens."""
    prepare(spark)
    return packing.packed_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("pack", pack)]

#: Fitted models, min-hashes and a tokenizer decide the rows; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
