"""Flat binary files in a folder that every executor reaches, written by tasks and mapped into memory where that is possible."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

import numpy as np
from pyarrow import fs
from pyspark import TaskContext


def _store(folder: str):
    """pyarrow's file system for a folder, and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)


def write_blob(folder: str, name: str, data: bytes) -> None:
    """A file that appears under its name when it is whole; a task that runs again leaves the same file."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    context = TaskContext.get()
    temporary = f"{root}/_{name}.{context.taskAttemptId() if context else os.getpid()}"
    with store.open_output_stream(temporary) as stream:
        stream.write(data)
    store.move(temporary, f"{root}/{name}")


def read_blob(folder: str, name: str, kind: np.dtype) -> np.ndarray:
    """The file as an array: mapped where the folder is a mounted path, read whole from any other store."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        path = f"{parts.path}/{name}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    store, root = _store(folder)
    with store.open_input_file(f"{root}/{name}") as stream:
        return np.frombuffer(stream.read(), kind)


def read_range(folder: str, name: str, start: int, length: int) -> bytes:
    """Some bytes of a file, from any store."""
    store, root = _store(folder)
    with store.open_input_file(f"{root}/{name}") as stream:
        return stream.read_at(length, start) if length else b""
