"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after each run of ASCII white space is replaced by one
space; null counts as empty. Everything is DataFrame functions.

1. One pass over the texts counts (length, prefix hash). The counts are aggregated before they
   move, so a group of copies costs one row per task.
2. Lengths with one text are settled; of the rest, prefixes with one text are settled.
3. Only the texts of surviving (length, prefix) groups are read in full and hashed. Spark shuffles
   nothing but their rows: the semi join is on the two narrow keys, and at scale its runtime filter
   drops other rows before the exchange. Classes are built by partial aggregation, so that a group
   with a third of all rows is never in one task.

Cases: an empty table gives an empty result. Null and empty texts are one class. Rows with the
same id and text are members of the same class, and each gets its own row. A null id never stays
when its class has an id; a class with null ids only has a null ``keep_id`` and keeps all its rows.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltlattice.llm.common import materialize, text_of

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 64


def normalized(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), normalized(text_col).alias("norm")).select(
        "id", "norm", F.octet_length("norm").alias("length"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The (length, prefix) groups that may hold equal texts."""
    counts = materialize(
        _keyed(docs, id_col, text_col).groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")), "dedup-counts")
    crowded = counts.groupBy("length").agg(F.sum("n").alias("rows")).filter("rows > 1").select("length")
    return counts.filter("n > 1").join(crowded, "length", "left_semi").select("length", "prefix")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): the rows of surviving groups with their full hash, and the classes of two or more rows."""
    alive = materialize(survivors(docs, id_col, text_col), "dedup-survivors")
    rows = materialize(
        _keyed(docs, id_col, text_col).join(alive, ["length", "prefix"], "left_semi")
        .select("id", "length", "prefix", F.unhex(F.sha2("norm", 256)).alias("digest")), "dedup-rows")
    groups = (rows.groupBy("digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
              .filter("size > 1"))
    return rows, groups


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and the class's text_sha256.

    The digest of a settled row isn't needed for its class; it is computed for the result as the
    row is read, in the same task.
    """
    _, groups = classes(docs, id_col, text_col)
    every = _keyed(docs, id_col, text_col).select("id", F.unhex(F.sha2("norm", 256)).alias("digest"))
    return every.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("size").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
