"""File access on executors, to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs

from ..store import fresh, shared_dir, unused, written

__all__ = ["filesystem", "fresh", "new_file", "shared_dir", "unused", "written"]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """For code on executors: the store of a URI (file, s3, gs, hdfs where its library is installed) and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A stream to a file that is there whole or not at all: a second attempt of the same task replaces it by equal bytes."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)
