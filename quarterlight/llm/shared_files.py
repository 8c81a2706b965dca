"""Files of plain arrays on shared storage: written whole by one task each, memory-mapped by all workers."""

from __future__ import annotations

import os
import tempfile
from urllib.parse import urlparse
from uuid import uuid4


def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return parts.path if parts.scheme in ("", "file") else None


def write(folder: str, name: str, arrays: list) -> None:
    """Any task may write a file again: the last full copy takes its place at once."""
    parts = [a.tobytes() for a in arrays]
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        new = f"{path}/.{name}-{uuid4().hex}"
        with open(new, "wb") as f:
            f.writelines(parts)
        os.replace(new, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    new = f"{path}/.{name}-{uuid4().hex}"
    with store.open_output_stream(new) as f:
        for p in parts:
            f.write(p)
    store.move(new, f"{path}/{name}")


def mapped(folder: str, name: str):
    """The file's bytes, memory-mapped. From a store that can't be mapped, through a copy that has no name on the
    local disk, so it is gone with the worker."""
    import numpy as np

    if (path := _local(folder)) is not None:
        return np.memmap(f"{path}/{name}", np.uint8, "r") if os.path.getsize(f"{path}/{name}") else np.empty(0, np.uint8)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as f:
        while block := f.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, np.uint8, "r") if copy.tell() else np.empty(0, np.uint8)


def remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
