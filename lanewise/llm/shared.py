"""Files and tables in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import gc
import mmap
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from lanewise.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder (as a URI) below ``spark.checkpoint.dir``; other folders are never used."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a lineage cut."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Hadoop's one-slash ``file:/`` form included."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, parts) -> None:
    """Write the byte strings ``parts`` to ``uri``; a retried task replaces the file in one step."""
    store, path = open_fs(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex[:8]}.draft"
    with store.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    store.move(draft, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """Memory-map an array file. A store without local paths is copied to a file that is
    unlinked at once, so nothing stays behind in the worker's own folder."""
    store, path = open_fs(uri)
    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype) if size else np.zeros(0, dtype)
    with store.open_input_stream(path, compression=None) as src, tempfile.TemporaryFile() as f:
        while chunk := src.read(8 << 20):
            f.write(chunk)
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype) if f.tell() else np.zeros(0, dtype)


def hand_back() -> None:
    """Return this process's freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def trimmed(run):
    """``run`` for ``mapInArrow``, after which the worker hands freed memory back to the system.

    Workers live on between tasks and stages; without this each keeps the most that any of its tasks took.
    """

    def whole(batches):
        yield from run(batches)
        hand_back()

    return whole
