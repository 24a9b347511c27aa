"""Files that tasks write and read themselves, below a shared URI, with whatever file system pyarrow has for its scheme."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def new_name(folder: str, part: int, ending: str) -> str:
    """Never the same twice: what a lost or repeated task left behind is not read, as no manifest names it."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{ending}"


def create(uri: str) -> BinaryIO:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def read_from(uri: str):
    """A seekable file and its size."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path), store.get_file_info(path).size
