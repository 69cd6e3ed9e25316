"""Whole files on the shared file system, from executors and the driver."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def write_whole(uri: str, parts: list[bytes]) -> None:
    """Write a file under another name and rename it: a task that is lost or run twice never leaves half a file."""
    tmp = f"{uri}.{uuid.uuid4().hex}.part"
    if (path := _local(tmp)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.writelines(parts)
        os.replace(path, _local(uri))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(tmp)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        for p in parts:
            f.write(p)
    store.move(path, fs.FileSystem.from_uri(uri)[1])


def read_range(uri: str, start: int = 0, size: int | None = None) -> bytes:
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read() if size is None else f.read(size)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)
