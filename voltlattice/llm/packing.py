"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its own items best-fit, largest first, and is done with the bins that are
nearly full. The others become items of the next round, whose tasks each take the bins of
``FAN_IN`` tasks before, until one task takes the rest or its bound would be passed. A task holds
at most about ``ITEMS_PER_TASK`` (id, size) pairs, never token ids. An item's sequence and offset
follow from the bins it went through, by one narrow join per round.

Cases: a document without tokens of its own still has the end id, so it is one piece of length 1.
Repeated rows are packed as separate documents, null ids are kept. An empty table gives an empty
result. Only longer documents than a sequence are cut; the rest of the division comes first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voltlattice.llm.common import materialize, partitions, text_of
from voltlattice.llm.tokens import encoder

SEQUENCE = 2048
#: Free tokens up to which a bin counts as nearly full.
SLACK = 8
FAN_IN = 16
ITEMS_PER_TASK = 2_000_000
#: Items that are worth a task of their own in the first round.
LEAST_ITEMS = 1_000
#: Bits of a row number in a key, below the task's number.
_ID_BITS = 40


def cut_lengths(tokens: int, size: int) -> list[int]:
    """Piece lengths of a document: whole sequences, before them the rest of the division."""
    rest = tokens % size
    return [rest] * (rest > 0) + [size] * (tokens // size)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SEQUENCE,
                    id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per piece: piece_key, doc_id, piece, start, length, ids (little-endian uint32).

    With ``digest``, ids_crc32 in place of ids, taken where they are made.
    """
    name, told = ("ids_crc32", zlib.crc32) if digest else ("ids", bytes)
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path).encode
        key = TaskContext.get().partitionId() << _ID_BITS
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + end
                start = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, size)):
                    rows.append((key, doc, k, start, n, told(ids[4 * start:4 * (start + n)])))
                    key, start = key + 1, start + n
            yield pd.DataFrame(rows, columns=["piece_key", "doc_id", "piece", "start", "length", name]).astype({"doc_id": batch["doc_id"].dtype})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
            .mapInPandas(pieces, f"piece_key long, doc_id {kind}, piece int, start long, length long, {name} {'long' if digest else 'binary'}"))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the size of each bin; the largest items are placed first."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    filled: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r tokens of room
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[item], offsets[item] = b, filled[b]
        filled[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(filled, np.int64)


def _round(items: DataFrame, number: int, capacity: int, slack: int) -> DataFrame:
    """(id, bin, offset, bin_size, open) for the (id, size) rows of each partition."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            ids.append(batch["id"].to_numpy(np.int64))
            sizes.append(batch["size"].to_numpy(np.int64))
        every, size = np.concatenate(ids), np.concatenate(sizes)
        by = np.argsort(every, kind="stable")
        every, size = every[by], size[by]
        bins, offsets, filled = best_fit(size, capacity)
        base = (number << 58) + (TaskContext.get().partitionId() << _ID_BITS)
        for k in range(0, len(every), 100_000):
            s = slice(k, k + 100_000)
            yield pd.DataFrame({"id": every[s], "bin": base + bins[s], "offset": offsets[s], "bin_size": filled[bins[s]],
                                "open": filled[bins[s]] < capacity - slack})

    return items.mapInPandas(packed, "id long, bin long, offset long, bin_size long, open boolean")


def pack(pieces: DataFrame, key: str = "piece_key", length: str = "length", capacity: int = SEQUENCE,
         slack: int = SLACK) -> DataFrame:
    """(key, sequence_id, offset) for every piece; keys must be unique."""
    items = pieces.select(F.col(key).alias("id"), F.col(length).alias("size"))
    left = items.count()
    tasks = max(1, math.ceil(left / ITEMS_PER_TASK), min(partitions(pieces.sparkSession), left // LEAST_ITEMS))
    items, placed = items.repartition(tasks, "id"), None
    for number in range(1, 16):
        done = materialize(_round(items, number, capacity, slack), "packing-round")
        step = done.select(F.col("id").alias("_id"), "bin", "offset")
        if placed is None:
            placed = done.select(F.col("id").alias("piece_key"), "bin", "offset")
        else:
            placed = placed.join(step.select(F.col("_id").alias("bin"), F.col("bin").alias("up"), F.col("offset").alias("more")), "bin", "left").select(
                "piece_key", F.coalesce("up", "bin").alias("bin"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
        # One item of a bin is at its start: that row stands for the bin.
        items = done.filter("open AND offset = 0").select(F.col("bin").alias("id"), F.col("bin_size").alias("size"))
        if tasks == 1:
            break
        left = items.count()
        fewer = max(math.ceil(tasks / FAN_IN), math.ceil(left / ITEMS_PER_TASK))
        if not left or fewer >= tasks:
            break
        tasks = fewer
        items = items.repartition(tasks, "id")
    return placed.select(F.col("piece_key").alias(key), F.col("bin").alias("sequence_id"), "offset")


def pieces_table(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = SEQUENCE,
                 id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """The pieces, written once: every later step reads only the columns it needs."""
    return materialize(tokenize_pieces(docs, tokenizer_path, end_id, size, id_col, text_col, digest), "packing-pieces")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = SEQUENCE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids, sequence_id and offset."""
    written = pieces_table(docs, tokenizer_path, end_id, size, id_col, text_col)
    return written.join(pack(written, capacity=size), "piece_key").drop("piece_key")


def packed_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = SEQUENCE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with the crc32 of their ids, sequence_id and offset. The ids themselves are neither written nor shuffled."""
    written = pieces_table(docs, tokenizer_path, end_id, size, id_col, text_col, digest=True)
    return written.join(pack(written, capacity=size), "piece_key").drop("piece_key")
