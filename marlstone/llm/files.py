"""Files in the shared folder, written and read from tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager


def filesystem(url: str):
    """(file system, path) of a URL or plain path: local, or any store that pyarrow knows."""
    from pyarrow import fs

    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


@contextmanager
def replacing(url: str) -> Iterator:
    """A stream to a new file that takes its name only when complete, so a task that runs twice leaves one whole file."""
    store, path = filesystem(url)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, path)


def open_input(url: str):
    store, path = filesystem(url)
    return store.open_input_file(path)
