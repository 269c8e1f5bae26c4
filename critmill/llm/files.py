"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs as pafs


def local_path(uri: str) -> str | None:
    """The path of a mounted folder, or None for another store."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def write(uri: str, blocks) -> None:
    """Writes blocks under a name of its own, then renames: a repeated or speculative attempt leaves one whole file."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for b in blocks:
                f.write(b)
        os.replace(part, path)
        return
    fs, path = pafs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        for b in blocks:
            f.write(b)
    fs.move(part, path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is mounted, read once elsewhere."""
    if path := local_path(uri):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
