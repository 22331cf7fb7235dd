"""Connected components by alternating large-star and small-star steps on DataFrames.

Each step is two aggregations and joins on the edges, whose number never grows; the edges are
written between steps, so the lineage stays short and lost executors cost one step. A vertex with
very many edges is counted per task before it moves, and its join can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltlattice.llm.common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges`` (u > v). Large: all larger neighbours of a vertex go to its least neighbour. Small: the smaller ones and itself do."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges if small else edges.union(flipped)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex of the edges (u, v) but the least of its component, with that least one."""
    now = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "components")
    told = None
    while True:
        now = materialize(_star(_star(now, small=False), small=True), "components")
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if row == told:
            return now
        told = row
