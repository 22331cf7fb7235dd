"""Small helpers the operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltlattice.session import apply_recommended, materialize, shared_dir

__all__ = ["Bitmap", "crc_fold", "fresh", "let", "materialize", "partitions", "prepare", "read_table", "shared_dir", "text_of"]

#: Rows of one Arrow batch: bounds the memory of a Python worker when texts are very long.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    apply_recommended(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, also where ``use`` needs it for every element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(-1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Bitmap:
    """A filter of fixed size for the values of a column: no row with one of them is dropped.

    It has ``2 ** BITS`` bits (4 MB), whatever the number of values: more of them let more other rows pass,
    which costs work and changes no result. Its words are combined by Spark before they are collected.
    """

    BITS = 25

    def __init__(self, df: DataFrame, column: str):
        bit = F.pmod(F.xxhash64(column), F.lit(2**self.BITS))
        words = (df.select(bit.alias("bit")).selectExpr("bit div 64 AS word", "shiftleft(1L, int(bit % 64)) AS bits")
                 .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas())
        self._words = np.zeros(2 ** (self.BITS - 6), np.int64)
        self._words[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        self._shared = df.sparkSession.sparkContext.broadcast(self._words)

    def test(self):
        """A function of an array of the values' ``xxhash64``, for use in tasks."""
        shared, size = self._shared, 2**self.BITS

        def told(hashes: np.ndarray) -> np.ndarray:
            bit = hashes % size
            return (shared.value[bit >> 6] >> (bit & 63)) & 1 == 1

        return told
