"""Token ids as flat binary files with 64-bit document offsets, written and read by blocks of documents.

A folder holds, for each block of documents in ascending id order,

* ``tokens-B.bin``: the ids of its documents one after the other, as little-endian unsigned
  integers of 16 bits if all ids of the tokenizer fit, else 32;
* ``offsets-B.bin``: little-endian signed 64-bit integers, the place of each document's first id in the
  whole corpus, and after the last document the place of the next block's first;
* ``index``: a Parquet table (block, row, doc_id, n_tokens).

Documents are range-partitioned by id, and those of one id by how their texts begin, once; each partition encodes its texts and streams one
tokens file. Block bases are prefix sums of the block totals, one number per block. Files are
written under a temporary name and then moved, and their content depends on the block alone, so a
task that is run again or twice leaves the same files. Readers map the files into memory where the
folder is a mounted path, and read the block's bytes from any other store.

Cases: null and empty texts have the end id only. Null ids come first; rows with equal ids follow
each other by text, repeated rows in any order. An empty table gives an empty folder and result.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voltlattice.llm.common import partitions, text_of
from voltlattice.llm.tokens import encoder

_OFFSET = np.dtype("<i8")
#: Bytes of texts in a block, about, and characters of a text by which rows of one id are dealt to blocks.
BLOCK_BYTES, PREFIX_CHARS = 64 << 20, 64


def _store(path: str):
    """pyarrow's file system for a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return parts.path if parts.scheme in ("", "file") else None


class _Writer:
    """A file that appears under its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.store, root = _store(folder)
        self.store.create_dir(root, recursive=True)
        context = TaskContext.get()
        self.final = f"{root}/{name}"
        self.temporary = f"{root}/_{name}.{context.taskAttemptId()}"
        self.stream = self.store.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.temporary, self.final)


def read_array(folder: str, name: str, kind: np.dtype) -> np.ndarray:
    local = _local(folder)
    if local is not None:
        return np.memmap(f"{local}/{name}", kind, "r") if os.path.getsize(f"{local}/{name}") else np.zeros(0, kind)
    store, root = _store(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def id_kind(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 2**16 else "<u4")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, kind: np.dtype,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files of all documents to ``folder``, which every executor must reach."""
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, row = TaskContext.get().partitionId(), 0
        first = next(batches, None)
        if first is None or not len(first):
            return
        encode = encoder(tokenizer_path).encode
        out = _Writer(folder, f"tokens-{block:06d}.bin")
        for batch in itertools.chain([first], batches):
            counts = []
            for text in batch["text"]:
                ids = np.frombuffer(encode(text) + end, "<u4")
                out.write(ids.astype(kind).tobytes())
                counts.append(len(ids))
            yield pd.DataFrame({"block": block, "row": np.arange(row, row + len(batch)), "doc_id": batch["doc_id"], "n_tokens": counts})
            row += len(batch)
        out.close()

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # Blocks are as many as the bytes need; an id of many rows is spread over several, in the order of its texts.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(partitions(spark), -(-size // BLOCK_BYTES))
    placed = rows.repartitionByRange(blocks, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, PREFIX_CHARS)).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    placed.mapInPandas(encoded, f"block int, row long, doc_id {key}, n_tokens long").write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    totals = index.groupBy("block").agg(F.sum("n_tokens").alias("tokens"))
    # One row per block: a prefix sum over as many rows as there are blocks.
    bases = totals.select("block", (F.sum("tokens").over(Window.orderBy("block")) - F.col("tokens")).alias("base"))

    def offsets(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        starts = int(group["base"].iloc[0]) + np.concatenate([[0], np.cumsum(group["n_tokens"].to_numpy(np.int64))])
        block = int(group["block"].iloc[0])
        out = _Writer(folder, f"offsets-{block:06d}.bin")
        out.write(starts.astype(_OFFSET).tobytes())
        out.close()
        return pd.DataFrame({"block": [block], "base": [int(starts[0])]})

    (index.select("block", "row", "n_tokens").join(bases, "block").groupBy("block").applyInPandas(offsets, "block int, base long")
     .write.parquet(f"{folder}/bases"))


def read(spark: SparkSession, folder: str, kind: np.dtype) -> DataFrame:
    """(doc_id, start, n_tokens, ids): all documents, from the files."""
    index = spark.read.parquet(f"{folder}/index").select("block", "row", "doc_id")
    key = index.schema["doc_id"].dataType.simpleString()

    def loaded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tokens, starts = None, None, None
        for batch in batches:
            out = []
            for block, row, doc in zip(batch["block"].tolist(), batch["row"].tolist(), batch["doc_id"]):
                if block != at:
                    at, tokens, starts = block, read_array(folder, f"tokens-{block:06d}.bin", kind), read_array(folder, f"offsets-{block:06d}.bin", _OFFSET)
                a, b = int(starts[row]), int(starts[row + 1])
                base = int(starts[0])
                out.append((doc, a, b - a, tokens[a - base:b - base].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": batch["doc_id"].dtype})

    return index.mapInPandas(loaded, f"doc_id {key}, start long, n_tokens long, ids binary")
