"""Files that executors write and read in the shared folder, by URI."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme == "file" else uri if not u.scheme else None


class Out:
    """A file that appears under its name only when it is complete.

    Every attempt of a task writes a name of its own; the rows that the attempt which counts returns name the files
    which count, so files of lost attempts are never read.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        self.size = 0
        path = _local(self.uri)
        if path:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self._f, self._end = open(path + ".part", "wb"), lambda: os.replace(path + ".part", path)
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.uri)
            store.create_dir(os.path.dirname(path), recursive=True)
            self._f, self._end = store.open_output_stream(path), lambda: None

    def write(self, data: bytes) -> None:
        self._f.write(data)
        self.size += len(data)

    def close(self) -> str:
        self._f.close()
        self._end()
        return self.uri


def open_in(uri: str):
    """A seekable reader."""
    path = _local(uri)
    if path:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
