"""Arrays that tasks write to, and memory-map from, the folder the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any
from urllib.parse import unquote, urlparse

import numpy as np


def _local(folder: str) -> str | None:
    """The folder's path where it is mounted (no scheme, or file:), else None."""
    parts = urlparse(folder)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Writes under a name of its own and renames, so that a task that runs twice leaves one whole file."""
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        draft = f"{local}/.{name}-{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.write(np.ascontiguousarray(values).data)
        os.replace(draft, f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(np.ascontiguousarray(values).data)
    store.move(draft, f"{path}/{name}")


def map_array(folder: str, name: str, kind: str) -> np.ndarray:
    """A read-only memory map of a written array; its pages belong to the page cache, not to the worker.

    From a store that isn't mounted the file is copied to a nameless local file first, which goes with the map.
    """
    local = _local(folder)
    if local is not None:
        path = f"{local}/{name}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as f:
        while part := f.read(1 << 24):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, kind, "r") if copy.tell() else np.zeros(0, kind)


class Kept(dict):
    """Maps by name, of which the first `most` stay and any other goes after its use: a map holds an open file and a region of
    memory, and a process may have few of either. Files that are gone through in the same order again and again would push one
    another out of a list of the last used."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def of(self, name: str, make: Callable[[], Any]) -> Any:
        if name in self:
            return self[name]
        made = make()
        if len(self) < self.most:
            self[name] = made
        return made
