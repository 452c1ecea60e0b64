"""Helpers of the training-data operators: tables, worker state, shared files."""

from __future__ import annotations

import hashlib
import os
import sys
import types
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage, shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid4().hex}"


def held(key, make):
    """The model that the Python worker holds under ``key``, made if it holds another one.

    The package's functions travel by value, so its own globals would be new in each task. A worker holds
    one model at a time: it outlives the stage that made it, and several would add up.
    """
    name = "_askance_worker_state"
    state = vars(sys.modules.setdefault(name, types.ModuleType(name)))
    if state.get("key") != key:
        state["key"], state["model"] = None, None
        state["model"] = make()
        state["key"] = key
    return state["model"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def write_shared(path: str, chunks) -> int:
    """Write byte chunks to a shared file; the name appears only when the file is whole.

    A repeated or rival attempt writes the same bytes under another name first, so a lost executor
    or a speculative copy never leaves half a file behind.
    """
    size, temporary = 0, f"{path}.{uuid4().hex}.part"
    local = _local(path)
    if local is not None:
        temporary = _local(temporary)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(temporary, "wb") as out:
            for chunk in chunks:
                out.write(chunk)
                size += len(chunk)
        os.replace(temporary, local)
        return size
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path)
    part = fs.FileSystem.from_uri(temporary)[1]
    with files.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(part, inner)
    return size


def open_shared(path: str):
    """A seekable reader of a shared file; a memory map where the file system allows one."""
    import pyarrow as pa

    local = _local(path)
    if local is not None:
        return pa.memory_map(local, "r") if os.path.getsize(local) else pa.BufferReader(b"")
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path)
    return files.open_input_file(inner)


def groups(texts, size: int):
    """(start, length) slices of some ``size`` bytes of text each, or one text."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, to - at
        at = to
