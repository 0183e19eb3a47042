"""Files that the driver and all executors share, and size-checked broadcasts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from weftline.storage import cut, drop_cut, shared_root, small

__all__ = ["KEPT", "cut", "drop_cut", "drop_kept", "few_parts", "filesystem", "get_bytes", "map_array", "put_bytes", "release", "released", "released_group", "shared_dir", "shared_root", "small", "small_batches"]

def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of fewer rows than the default, which would hold tens of MB; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def few_parts(spark: SparkSession, items: int) -> int:
    """Partitions for so many independent pieces of work: one each while they are few, then 64 to a partition."""
    return max(1, min(items, 4 * spark.sparkContext.defaultParallelism + items // 64))


#: What a worker keeps between tasks: name to a function that drops it.
KEPT: dict[str, Callable[[], None]] = {}


def drop_kept(but: str | None) -> None:
    """Drop what this worker keeps between tasks for other operators."""
    for name in [n for n in KEPT if n != but]:
        KEPT.pop(name)()


def release() -> None:
    """Give the memory that numpy and Arrow buffers held back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run, keeps: str | None = None):
    """run(batches), which drops what the worker kept for operators other than `keeps` when it starts, and gives the memory that its
    numpy and Arrow buffers held back to the system when it ends.

    Workers are used again, and what they keep counts against the executor while others work.
    """

    def held(batches):
        from weftline.llm import shared  # the worker's own module, not a copy that came with this function

        shared.drop_kept(keeps)
        try:
            yield from run(batches)
        finally:
            shared.release()

    return held


def released_group(run):
    """run(group) for applyInArrow, with what released() does before and after each group."""

    def held(group: pa.Table) -> pa.Table:
        from weftline.llm import shared

        shared.drop_kept(None)
        try:
            return run(group)
        finally:
            shared.release()

    return held


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or plain path."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, chunks) -> int:
    """Write the byte chunks to uri by way of a private name, so that a repeated task replaces whole files only."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own, n = f"{path}.{uuid.uuid4().hex[:8]}", 0
    with fs.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    try:
        fs.move(own, path)
    except OSError:  # some file systems don't replace
        fs.delete_file(path)
        fs.move(own, path)
    return n


def map_array(uri: str, dtype) -> np.ndarray:
    """The array in a file: memory-mapped if the path is mounted here, else read."""
    fs, path = filesystem(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def get_bytes(uri: str):
    """The whole file as a buffer: memory-mapped if mounted here, else read."""
    return memoryview(map_array(uri, np.uint8))
