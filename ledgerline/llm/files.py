"""Files in the shared folder, by URI: any store that pyarrow's file systems reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def new_file(uri: str) -> Iterator:
    """A stream that becomes the file at uri when all is written; a retried task replaces it whole."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, path)


def open_file(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
