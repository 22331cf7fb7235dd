"""Exact top-k inner products by a uniform threshold in three phases.

Vectors are integers, ``floor(scale * x)``. Their dimensions are cut into ``lists`` slices; the inner
products of one slice are the score list of that slice, and a vector's score is the sum over the lists.
Queries go in slices of bounded size, broadcast to the vectors, which stay where they are: they are
written once as rows of bytes and never move. For each slice of queries:

1. Every task gathers, for each query and list, its ``k`` vectors with the highest entries, resolves
   the scores of those, and reports the ``k`` best. Over all tasks the k-th best of them is a score that
   at least ``k`` vectors reach, so it is a safe cutoff, one number for a query.
2. The cutoffs are broadcast. If a score reaches the cutoff, an entry of at least one list reaches the
   cutoff divided by the number of lists (whatever the signs). Only vectors with such an entry are collected.
3. The scores of those are resolved exactly from all lists; what reaches the cutoff, at most ``k`` for a
   query and task, is sent, and ranked.

Products are taken in the narrowest number that holds every partial sum exactly: 4-byte floats up to
2^24, 8-byte floats up to 2^53, else Python integers; bounds come from the vectors' lengths.

Cases: vectors that are null or hold null or non-finite components take no part; nor do null ids as
queries, while a candidate with a null id comes last among ties. Every row that is a query gets its own
ranks; all rows with the query's id count as its own row. Repeated rows are candidates each. A shorter
vector counts as filled up with zeros. Components and scores beyond a long become the nearest long. With
fewer candidates than ``k``, all are returned; an empty table gives an empty result. Columns other than
id and vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltlattice.llm.common import materialize, partitions, shared_dir

#: Bytes of queries that one job broadcasts; more queries are more jobs.
SLICE_BYTES = 16 << 20
#: Vectors that a task multiplies at once, and queries.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
LONG = (-(2**63), 2**63 - 1)
LISTED = "query int, vec_id long, score long"


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null for a vector that takes no part."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))

    def whole(v):
        y = F.lit(float(scale)) * v.cast("double")
        return F.when(y >= 2.0**63, F.lit(LONG[1])).when(y < -(2.0**63), F.lit(LONG[0])).otherwise(F.floor(y).cast("long"))

    return F.when(x.isNull() | bad, None).otherwise(F.transform(x, whole))


def prepared(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, ints): the vectors that take part, dealt evenly and written once."""
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(vector_col, scale).alias("ints")).filter("ints IS NOT NULL")
    n = max(partitions(vectors.sparkSession), vectors.sparkSession.sparkContext.defaultParallelism)
    return materialize(kept.repartition(n), "search-vectors")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, cut or filled up with zeros to ``width``."""
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = col < width
    out[row[inside], col[inside]] = values[inside]
    return out


def _norm(rows: np.ndarray) -> float:
    return float(np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))


def _kind(a: np.ndarray, b_norm: float):
    """The narrowest type in which every partial sum of a product is exact: |sum| is at most the product of lengths."""
    most = _norm(a) * b_norm * 1.001
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


class _Best:
    """The k best (score, id) of each query so far: higher scores first, ties to smaller ids, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, query: np.ndarray, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        # One sort for all queries; a query's first k are the only ones that can stay.
        order = np.lexsort((ids, nulls, ~scores, query))
        query, ids, nulls, scores = query[order], ids[order], nulls[order], scores[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        top = place < self.k
        for q, i, null, s in zip(query[top].tolist(), ids[top].tolist(), nulls[top].tolist(), scores[top].tolist()):
            self.found[q].append((-int(s), null, i))
        for q in set(query[top].tolist()):
            self.found[q] = sorted(self.found[q])[: self.k]

    def table(self) -> pa.RecordBatch:
        rows = [(q, None if null else i, -s) for q, best in enumerate(self.found) for s, null, i in best]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "vec_id", "score"])


def _products(block: np.ndarray, queries: np.ndarray, lists: list[slice], kind) -> list[np.ndarray]:
    """The score lists of a block: for each slice of dimensions, entries of (query, row)."""
    return [queries[:, s].astype(kind) @ block[:, s].T.astype(kind) for s in lists]


def _scan(shared, k: int, lists: int, cutoffs=None):
    """What one task does over its vectors: phase 1 without cutoffs, phases 2 and 3 with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, queries = shared.value
        width = queries.shape[1]
        bounds = np.linspace(0, width, lists + 1).astype(int)
        slices = [slice(a, b) for a, b in zip(bounds, bounds[1:]) if b > a] or [slice(0, 0)]
        floor = cutoffs.value if cutoffs else None
        best, norms = _Best(len(queries), k), [_norm(queries[at:at + BLOCK_QUERIES]) for at in range(0, len(queries), BLOCK_QUERIES)]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                block = _matrix(part.column(1), width)
                nulls = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                for n, first in enumerate(range(0, len(queries), BLOCK_QUERIES)):
                    some, own = queries[first:first + BLOCK_QUERIES], own_ids[first:first + BLOCK_QUERIES]
                    entries = _products(block, some, slices, _kind(block, norms[n]))
                    mine = (own[:, None] == ids[None, :]) & ~nulls[None, :]
                    if floor is None:
                        rows, cols = _listed(entries, mine, k)
                    else:
                        cut = floor[first:first + BLOCK_QUERIES, None]
                        reach = np.zeros(mine.shape, bool)
                        for entry in entries:
                            reach |= (len(slices) * entry.astype(np.float64 if entry.dtype != object else object) >= cut).astype(bool)
                        reach |= cut == LONG[0]
                        rows, cols = np.nonzero(reach & ~mine)
                    scores = _resolved(entries, rows, cols)
                    if floor is not None:
                        enough = scores >= floor[first + rows]
                        rows, cols, scores = rows[enough], cols[enough], scores[enough]
                    if len(rows):
                        best.add(rows + first, ids[cols], nulls[cols], scores)
        yield best.table()

    return run


def _resolved(entries: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The scores of some pairs: the sums of their entries in all lists."""
    parts = [entry[rows, cols] for entry in entries]
    if parts[0].dtype == object:
        return np.array([min(max(int(sum(x)), LONG[0]), LONG[1]) for x in zip(*parts)], np.int64)
    return sum(part.astype(np.int64) for part in parts)


def _listed(entries: list[np.ndarray], mine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k highest entries of each list, each pair once."""
    chosen = np.zeros(mine.shape, bool)
    most = min(k + 1, mine.shape[1])  # one more, as the query's own row may be among them
    for entry in entries:
        if entry.dtype == object:
            top = np.argsort(-entry, axis=1, kind="stable")[:, :most]
        else:
            top = np.argpartition(entry, mine.shape[1] - most, axis=1)[:, -most:]
        np.put_along_axis(chosen, top, True, axis=1)
    return np.nonzero(chosen & ~mine)


def search(vectors: DataFrame, is_query: Column, k: int = 5, lists: int = 2, scale: int = 256,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    table = prepared(vectors, id_col, vector_col, scale)
    width = table.agg(F.max(F.size("ints"))).first()[0] or 0
    asked = materialize(table.filter(is_query & F.col("vec_id").isNotNull()), "search-queries")
    count = asked.count()
    # Queries are dealt to as many slices as their bytes need; a slice is a bounded set of rows.
    slices = -(-count * max(width, 1) * 8 // SLICE_BYTES)
    numbered = materialize(asked.withColumn("slice", (F.rand(17) * slices).cast("int")), "search-slices") if slices > 1 else asked.withColumn("slice", F.lit(0))
    out = shared_dir(spark, "search-ranks")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for n in range(slices):
        some = numbered.filter(F.col("slice") == n).select("vec_id", "ints").toArrow()
        if some.num_rows:
            _search_slice(table, some, width, k, lists).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _search_slice(table: DataFrame, some: pa.Table, width: int, k: int, lists: int) -> DataFrame:
    """The ranks of one slice of queries."""
    spark = table.sparkSession
    some = some.combine_chunks()
    ids = some.column(0).to_numpy().astype(np.int64)
    queries = _matrix(some.column(1).combine_chunks() if some.column(1).num_chunks != 1 else some.column(1).chunk(0), width)
    shared = spark.sparkContext.broadcast((ids, queries))
    gathered = table.mapInArrow(_scan(shared, k, lists), LISTED)
    # At most k numbers from a task, and only the k-th best leaves the aggregation.
    cuts = gathered.groupBy("query").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("cut")).toArrow()
    floor = np.full(len(ids), LONG[0], np.int64)
    known = cuts.column("cut").is_valid().to_numpy()
    floor[cuts.column("query").to_numpy()[known]] = cuts.column("cut").drop_null().to_numpy()
    cutoffs = spark.sparkContext.broadcast(floor)
    resolved = table.mapInArrow(_scan(shared, k, lists, cutoffs), LISTED)
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = resolved.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "query_id": ids}))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")
