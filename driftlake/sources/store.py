"""Writing whole files to local or remote folders."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def put(uri: str, data: bytes) -> str:
    """The file appears under its name when it is complete."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        path = unquote(u.path) if u.scheme else uri
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return uri
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as f:
        f.write(data)
    return uri
