"""Opening files by URI inside tasks: local and shared folders directly, other stores through Arrow's file systems."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, else None."""
    parsed = urlparse(uri)
    if parsed.scheme == "file":
        return unquote(parsed.path)
    return uri if not parsed.scheme else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_to_read(uri: str):
    """A readable binary stream."""
    if (path := local_path(uri)) is not None:
        return open(path, "rb")
    store, path = _store(uri)
    return store.open_input_stream(path)


class NewFile:
    """A file that appears under its name only when finished: written aside, then renamed."""

    def __init__(self, uri: str):
        self.uri, self.aside = uri, uri + ".part"
        if (path := local_path(self.aside)) is not None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            self.stream = open(path, "wb")
        else:
            store, path = _store(self.aside)
            store.create_dir(os.path.dirname(path), recursive=True)
            self.stream = store.open_output_stream(path)

    def finish(self) -> None:
        self.stream.close()
        if (path := local_path(self.aside)) is not None:
            os.replace(path, local_path(self.uri))
        else:
            store, path = _store(self.aside)
            store.move(path, path.removesuffix(".part"))
